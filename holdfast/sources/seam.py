"""Sources of observations by name: `spark.read.format("observations")` and others of the same kind.

A source says what its parts are and fetches the rows of one; Spark deals the parts to tasks. The options `build_id` and
`device_name` say what is asked for and are handed down to both. Filters of a query aren't: Spark keeps those that a
Python source takes with the loaded table, so two filters over one table would change each other's rows. One's own source is a
subclass, registered with `register`.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.csv as csv
from pyarrow import fs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StringType, StructType

from .observations import COLUMNS

#: Bytes of a file that are parsed at a time; a row has to fit.
BLOCK = 16 << 20


@dataclass
class Part(InputPartition):
    """What one task reads: whatever the source needs to find it again."""

    value: object


class Traces(DataSource):
    """Observations from somewhere: all columns are text without nulls, the six fixed ones among them.

    A subclass has a `name`, and `columns` if there are more than the fixed ones; `parts` lists what tasks read, and
    `fetch` gives a part's rows as Arrow batches. Both are told the build and the device that are asked for (None: all)
    and may leave others out early; those left in are filtered here.
    """

    def columns(self) -> list[str]:
        return COLUMNS

    def parts(self, build: str | None, device: str | None) -> list:
        raise NotImplementedError

    def fetch(self, part, build: str | None, device: str | None) -> Iterator[pa.RecordBatch]:
        raise NotImplementedError

    def schema(self) -> StructType:
        names = self.columns()
        missing = [c for c in COLUMNS if c not in names]
        if missing:
            raise ValueError(f"no column {', '.join(missing)} in {self.name()}")
        out = StructType()
        for name in names:
            out.add(name, StringType())
        return out

    def reader(self, schema: StructType) -> DataSourceReader:
        return TraceReader(self, schema.names)


class TraceReader(DataSourceReader):
    def __init__(self, source: Traces, names: list[str]):
        self.source, self.names = source, names
        self.wanted = {c: source.options[c] for c in ("build_id", "device_name") if c in source.options}

    def asked(self) -> tuple[str | None, str | None]:
        return self.wanted.get("build_id"), self.wanted.get("device_name")

    def partitions(self) -> list[Part]:
        # Without parts Spark would read one that is none.
        return [Part(p) for p in self.source.parts(*self.asked())] or [Part(None)]

    def read(self, partition: Part) -> Iterator[pa.RecordBatch]:
        if partition.value is None:
            return
        for batch in self.source.fetch(partition.value, *self.asked()):
            batch = batch.select(self.names)
            for name, value in self.wanted.items():
                batch = batch.filter(pc.equal(batch.column(name), value))
            if batch.num_rows:
                yield batch


class CsvTraces(Traces):
    """CSV files at `path`, a file or a folder; a task reads a file, in blocks. Like `read_observations`."""

    @classmethod
    def name(cls) -> str:
        return "observations"

    def parts(self, build: str | None = None, device: str | None = None) -> list[str]:
        system, path = fs.FileSystem.from_uri(self.options["path"])
        if system.get_file_info(path).type == fs.FileType.File:
            return [path]
        found = system.get_file_info(fs.FileSelector(path, recursive=True))
        hidden = lambda f: any(p.startswith(("_", ".")) for p in f.path[len(path) :].split("/"))
        return sorted(f.path for f in found if f.type == fs.FileType.File and f.size and not hidden(f))

    def opened(self, path: str, types: dict | None = None) -> csv.CSVStreamingReader:
        system, _ = fs.FileSystem.from_uri(self.options["path"])
        convert = csv.ConvertOptions(column_types=types, strings_can_be_null=False, quoted_strings_can_be_null=False)
        return csv.open_csv(system.open_input_stream(path), csv.ReadOptions(block_size=BLOCK), csv.ParseOptions(newlines_in_values=True), convert)

    def columns(self) -> list[str]:
        for path in self.parts():
            return self.opened(path).schema.names
        raise ValueError(f"no files in {self.options['path']}")

    def fetch(self, part: str, build: str | None, device: str | None) -> Iterator[pa.RecordBatch]:
        types = dict.fromkeys(self.opened(part).schema.names, pa.string())
        for batch in self.opened(part, types):
            cells = [pc.utf8_trim(batch.column(c), " ") if c in COLUMNS else batch.column(c) for c in batch.schema.names]
            yield pa.RecordBatch.from_arrays(cells, batch.schema.names)


class SyntheticTraces(Traces):
    """`n` observations of a `build` and a `device` that go round the pairs of `sites`, "blocked blocking" separated by commas."""

    ROWS = 1 << 20

    @classmethod
    def name(cls) -> str:
        return "synthetic_observations"

    def parts(self, build: str | None, device: str | None) -> list[int]:
        if build not in (None, self.options["build"]) or device not in (None, self.options["device"]):
            return []
        return list(range(0, int(self.options["n"]), self.ROWS))

    def fetch(self, part: int, build: str | None, device: str | None) -> Iterator[pa.RecordBatch]:
        pairs = [p.split() for p in self.options["sites"].split(",")]
        n = min(self.ROWS, int(self.options["n"]) - part)
        pair = pa.array([(part + i) % len(pairs) for i in range(n)])
        same = lambda text: pa.array([text]).take(pa.array([0] * n))
        sites = [pa.array([p[side] for p in pairs]).take(pair) for side in (0, 1)]
        yield pa.RecordBatch.from_arrays([same(self.options["build"]), same(self.options["device"]), *sites, same(""), same("")], COLUMNS)


def register(spark: SparkSession, *sources: type[Traces]) -> None:
    """Makes the two sources here, and `sources`, known to the session by their names."""
    for source in (CsvTraces, SyntheticTraces, *sources):
        spark.dataSource.register(source)
