"""Results of the analyses as files: JSON lines, and a columnar protocol-buffers dump that tasks write in pieces."""

from __future__ import annotations

import gzip as gz
from collections.abc import Iterable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.relational import dictionary, numbered
from ..storage import open_shared, written
from .observations import write_json

# Fixed values of the dump: fields of its message, in the order of their numbers; strings have number 1.
COLUMNS = ("class", "method", "source_file", "lock", "line")
#: Evidence shown of each finding.
SHOWN = 5


def varint(n: int) -> bytes:
    out = bytearray()
    while n > 0x7F:
        out.append(n & 0x7F | 0x80)
        n >>= 7
    return bytes([*out, n])


def delimited(field: int, payload: bytes) -> bytes:
    return varint(field << 3 | 2) + varint(len(payload)) + payload


def packed(field: int, values: Iterable[int]) -> bytes:
    return delimited(field, b"".join(map(varint, values)))


def in_order(points: DataFrame) -> DataFrame:
    """Lock points by class, method, line (unknown first) and lock."""
    return points.orderBy("class", "method", F.col("line").asc_nulls_first(), "lock")


def write_points_json(points: DataFrame, path: str, gzip: bool = False) -> None:
    rows = in_order(points).select("class", "method", F.col("source_file").alias("file"), "line", "lock")
    write_json(rows, path, gzip)


def write_points_columns(points: DataFrame, path: str, slices: int | None = None, gzip: bool = False) -> DataFrame:
    """A message with a pool of strings (number 0 is empty) and five parallel columns; an unknown line is 0.

    Parts of a message one after the other are the message, by the rules of the format. So each task writes the
    part of its rows, and the files in the order of their names, joined, are the dump; each is a message by
    itself. With `gzip` each is a gzip member, so joined members are a gzip file of the dump. Strings are numbered by the first row and column that they stand in. Returns part and path.
    """
    order = ["class", "method", "_line", "lock", "source_file"]
    text = F.coalesce("source_file", F.lit("")).alias("source_file")
    rows = points.select("class", "method", text, "lock", F.coalesce("line", F.lit(0)).alias("line"), F.coalesce("line", F.lit(-1)).alias("_line"))
    # Equal rows are one key with a count, so that numbers are unique and stable.
    rows = written(numbered(rows.groupBy(*order, "line").agg(F.count("*").alias("_times")), order, "_row"), "points")
    n = slices or int(points.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    empty = rows.limit(1).select(F.lit("").alias("value"), F.lit(0).cast("long").alias("id"))
    pool = dictionary(rows.select("_row", *[F.when(F.col(c) != "", F.col(c)).alias(c) for c in COLUMNS[:4]]), "_row", list(COLUMNS[:4]))
    pool = written(pool.unionByName(empty), "strings")
    for c in COLUMNS[:4]:
        rows = rows.join(pool.select(F.col("value").alias(c), F.col("id").alias(f"_{c}")), c)
    rows = rows.select("_row", *[f"_{c}" for c in COLUMNS[:4]], "line", F.explode(F.sequence(F.lit(1), F.col("_times").cast("int"))).alias("_time"))

    def write(kind: str, encode):
        def run(batches):
            held = [row for batch in batches for row in batch.to_pylist()]
            if held:
                name = f"{path}/{kind}-{held[0]['_at']:015d}.pb{'.gz' if gzip else ''}"
                with open_shared(name, "w") as out:
                    out.write(gz.compress(encode(held), mtime=0) if gzip else encode(held))
                yield pa.RecordBatch.from_pydict({"part": [f"{kind}-{held[0]['_at']:015d}"], "path": [name]})

        return run

    def strings(held: list[dict]) -> bytes:
        return b"".join(delimited(1, r["value"].encode()) for r in held)

    def columns(held: list[dict]) -> bytes:
        names = [*(f"_{c}" for c in COLUMNS[:4]), "line"]
        return b"".join(packed(i, (r[name] for r in held)) for i, name in enumerate(names, 2))

    a = pool.withColumn("_at", F.col("id")).repartitionByRange(n, "_at").sortWithinPartitions("_at")
    b = rows.withColumn("_at", F.col("_row").cast("long")).repartitionByRange(n, "_at", "_time").sortWithinPartitions("_at", "_time")
    schema = "part string, path string"
    out = a.mapInArrow(write("1-strings", strings), schema).unionByName(b.mapInArrow(write("2-columns", columns), schema))
    return written(out, "dump-parts").orderBy("part")


def varints(data: np.ndarray) -> np.ndarray:
    """The numbers that bytes hold one after the other: seven bits a byte, the low ones first, the top bit set where more follow."""
    last = np.flatnonzero(data < 0x80)
    if len(data) and (len(last) == 0 or last[-1] != len(data) - 1):
        raise ValueError("a number of the dump is cut off")
    first = np.concatenate(([0], last[:-1] + 1)).astype(np.int64)[: len(last)]
    if not len(last):
        return np.zeros(0, np.int64)
    place = np.arange(len(data)) - np.repeat(first, last - first + 1)
    return np.add.reduceat((data & 0x7F).astype(np.int64) << 7 * place, first)


def fields_of(content: bytes) -> tuple[list[str], list[np.ndarray]]:
    """Strings and columns of a message, or of joined ones, whatever the order of their fields; gzip members are opened."""
    if content[:2] == b"\x1f\x8b":
        content = gz.decompress(content)
    strings, columns, at, end = [], [[] for _ in COLUMNS], 0, len(content)

    def number() -> int:
        nonlocal at
        start = at
        while at < end and content[at] > 0x7F:
            at += 1
        at += 1
        return int(varints(np.frombuffer(content[start:at], np.uint8))[0])

    while at < end:
        tag, size = number(), number()
        field = tag >> 3
        if tag & 7 != 2 or not 1 <= field <= len(COLUMNS) + 1 or at + size > end:
            raise ValueError(f"no dump: field {field} of {size} bytes at {at} of {end}")
        payload, at = content[at : at + size], at + size
        if field == 1:
            strings.append(payload.decode())
        else:
            columns[field - 2].append(varints(np.frombuffer(payload, np.uint8)))
    return strings, [np.concatenate(c) if c else np.zeros(0, np.int64) for c in columns]


def read_points_columns(spark: SparkSession, path: str) -> DataFrame:
    """The lock points of a columnar dump: its parts below `path`, plain or gzip, or files of joined parts.

    A task reads a file, so a file has to fit one. Strings are numbered through all files in the order of their names, and
    joined to rows by number. An unknown line and file are null again. Rows are in no order; a damaged dump is an error.
    """
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.pb*").load(path).select("path", "content")

    def parse(batches):
        for batch in batches:
            for file, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                strings, columns = fields_of(content)
                if len({len(c) for c in columns}) > 1:
                    raise ValueError(f"columns of {file} differ in length: {[len(c) for c in columns]}")
                cells = [pa.array([file]), pa.array([strings], pa.list_(pa.string())), *[pa.array([c], pa.list_(pa.int64())) for c in columns]]
                yield pa.RecordBatch.from_arrays(cells, ["path", "strings", *COLUMNS])

    parsed = written(files.mapInArrow(parse, "path string, strings array<string>, " + ", ".join(f"`{c}` array<bigint>" for c in COLUMNS)), "dump-read")
    # One row a file: how many strings stand in the files before it.
    before = Window.orderBy("path").rowsBetween(Window.unboundedPreceding, -1)
    bases = parsed.select("path", F.size("strings").cast("long").alias("n")).select("path", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    pool = parsed.select("path", F.posexplode("strings").alias("i", "value")).join(bases, "path").select((F.col("base") + F.col("i")).alias("id"), "value")
    pool = written(pool, "dump-strings")
    rows = parsed.select(F.explode(F.arrays_zip(*COLUMNS)).alias("r")).select("r.*")
    for c in COLUMNS[:4]:
        named = pool.select(F.col("id").alias(c), F.col("value").alias("_value"))
        # A number without a string would be lost here otherwise.
        rows = rows.join(named, c, "left").withColumn(c, F.coalesce("_value", F.raise_error(F.lit(f"a {c} of the dump has no string")))).drop("_value")
    return rows.select("class", "method", F.when(F.col("source_file") != "", F.col("source_file")).alias("source_file"), F.when(F.col("line") != 0, F.col("line").cast("int")).alias("line"), "lock")


def write_calls_under_lock(calls: DataFrame, path: str) -> None:
    write_json(calls, path)


def write_races(rows: DataFrame, path: str) -> None:
    """Findings with the first SHOWN places where the guard is held; all where it isn't."""
    write_json(rows.withColumn("guarded_at", F.slice("guarded_at", 1, SHOWN)).drop("n_unguarded"), path)
