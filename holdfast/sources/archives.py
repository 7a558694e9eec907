"""Members of zip archives as rows, for readers of what is inside."""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Archives within archives, opened to this depth.
DEPTH = 8
# What a class file and an archive begin with, and names that can hold either.
CLASS_FILE, ARCHIVE = b"dex\n", b"PK\x03\x04"
# A fixed value too: the folder whose archives alone are read where a build has it.
PREFERRED = "soong/system_server_dexjars"
ZIPPED = (".jar", ".apk", ".zip", ".apex", ".capex")


def members(name: str, content: bytes, depth: int = 0) -> Iterator[tuple[str, bytes]]:
    """Class files in a file, told by their first bytes and else by their names."""
    if content[:4] == CLASS_FILE:
        yield name, content
    elif depth < DEPTH and (content[:4] == ARCHIVE or name.endswith(ZIPPED)):
        if not zipfile.is_zipfile(io.BytesIO(content)):
            return  # named like an archive, but none
        with zipfile.ZipFile(io.BytesIO(content)) as inside:
            for item in inside.namelist():
                base = item.rsplit("/", 1)[-1]
                if base.endswith((".dex", *ZIPPED)) or base.startswith("classes"):
                    yield from members(f"{name}!{item}", inside.read(item), depth + 1)


def class_files(spark: SparkSession, path: str, scope: str = "*") -> DataFrame:
    """path, ordinal, member and content of all class files in the archives below `path`, in the order of paths."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", scope).option("recursiveFileLookup", True).load(path)

    def unpack(batches):
        for batch in batches:
            for file, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                found = list(members(file.rsplit("/", 1)[-1], content))
                columns = [file] * len(found), range(len(found)), [m for m, _ in found], [c for _, c in found]
                kinds = pa.string(), pa.int32(), pa.string(), pa.binary()
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["path", "ordinal", "member", "content"])

    return files.select("path", "content").mapInArrow(unpack, "path string, ordinal int, member string, content binary").orderBy("path", "ordinal")


def listing(spark: SparkSession, root: str, builds: list[str], scope: str = "*") -> DataFrame:
    """path, build and kind (0 preferred, 1 own, 2 zip) of the files of builds below `root`; contents aren't read.

    Files are met with builds by each folder that they lie in, and by their names where those end in .zip.
    """
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(root)
    whole = hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(hadoop).toString()
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root).select("path")
    parts = F.split(F.expr("below"), "/")
    above = F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda n: F.array_join(F.slice(parts, 1, n), "/"))
    folders = F.when(F.size(parts) > 1, above).otherwise(F.array().cast("array<string>"))
    name = F.element_at(parts, -1)
    zipped = F.when(F.endswith("below", F.lit(".zip")), F.array(F.expr("left(below, length(below) - 4)"))).otherwise(F.array().cast("array<string>"))
    rows = files.withColumn("below", F.expr(f"substring(path, {len(whole) + 2})")).select("path", "below", name.alias("name"), F.explode(F.concat(folders, zipped)).alias("build"))
    asked = spark.createDataFrame([(b,) for b in builds], "build string")
    inside = F.expr("substring(below, length(build) + 2)")
    pattern = "".join({"*": ".*", "?": "."}.get(c) or re.escape(c) for c in scope)
    wanted = F.rlike("name", F.lit(f"^(?:{pattern})$"))
    rows = rows.join(asked, "build").withColumn("inside", inside)
    kind = F.when(F.col("below") == F.concat("build", F.lit(".zip")), 2).when((inside == F.concat(F.lit(f"{PREFERRED}/"), "name")) & F.endswith("name", F.lit(".jar")) & wanted, 0).otherwise(1)
    return rows.select("path", "build", kind.alias("kind"))


def chosen(spark: SparkSession, root: str, builds: list[str], scope: str = "*") -> dict[str, str]:
    """What holds each build's archives: its preferred folder if archives of the scope are there, else its own, else its one zip, else `root`."""
    from pyspark.errors import AnalysisException

    try:
        kinds = listing(spark, root, builds, scope).groupBy("build").agg(F.min("kind").alias("kind")).collect()
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        kinds = []
    own = {r.build: (f"/{r.build}/{PREFERRED}", f"/{r.build}", f"/{r.build}.zip")[r.kind] for r in kinds}
    return {b: root + own.get(b, "") for b in builds}


def versions(files: DataFrame) -> DataFrame:
    """A hash of the contents of each path: the version of what is derived from them."""
    return files.groupBy("path").agg(F.sha2(F.array_join(F.sort_array(F.collect_list(F.sha2("content", 256))), ""), 256).alias("version"))
