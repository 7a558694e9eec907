"""Observed source sites resolved to the locks taken there."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.names import UNRESOLVED, basename, path_matches, relative_path, site
from ..operators.relational import lookup
from ..storage import join_counted

SITE_INDEX = "build_id string, relpath string, method string, line int, lock string"


def site_index(points: DataFrame, build: str) -> DataFrame:
    """The columns of lock points that lookups need; a table partitioned by build."""
    path = relative_path(F.col("class"))
    return points.select(F.lit(build).alias("build_id"), path.alias("relpath"), "method", "line", "lock")


def resolve_sites(sites: DataFrame, index: DataFrame, fuzz: int = 0, sole: bool = False, method: str | None = None) -> DataFrame:
    """build_id, text and resolved for distinct sites (build_id, text). Texts that are no sites have no rows."""
    asked = sites.distinct().withColumn("at", site(F.col("text"))).where("at is not null")
    asked = asked.select("build_id", "text", F.col("at.file").alias("file"), F.col("at.line").alias("line"), basename(F.col("at.file")).alias("base"))
    index = index.where("line is not null").withColumn("base", basename(F.col("relpath"))).withColumn("line", F.col("line").cast("long"))
    if method:
        index = index.where(F.contains("method", F.lit(method)))
    found = lookup(asked, index, ["build_id", "base"], "line", "lock", fuzz, sole, path_matches(F.col("q.file"), F.col("x.relpath")), ("file", "relpath"))
    return found.select("build_id", "text", "resolved")


def resolve(observations: DataFrame, index: DataFrame, fuzz: int = 0, sole: bool = False) -> DataFrame:
    """Observations with both lock columns, set or overwritten in place; N/A where nothing is found.

    Each distinct site of a build is looked up once. A build without an index has N/A throughout.
    """
    texts = F.explode(F.array("blocked_src", "blocking_src")).alias("text")
    found = resolve_sites(observations.select("build_id", texts), index, fuzz, sole)
    out = observations
    for source, column in (("blocked_src", "resolved_blocked_lock"), ("blocking_src", "resolved_blocking_lock")):
        names = found.select("build_id", F.col("text").alias(source), F.col("resolved").alias("_found"))
        out = join_counted(out, names, ["build_id", source], "left").withColumn(column, F.coalesce("_found", F.lit(UNRESOLVED))).drop("_found")
    order = [*observations.columns, *[c for c in ("resolved_blocked_lock", "resolved_blocking_lock") if c not in observations.columns]]
    return out.select(*order)


def index_of_builds(spark, builds: list[str], artifacts: str, cache: str | None = None, scope: str = "*", at_once: int = 4) -> DataFrame:
    """The site index of all builds; each is derived from its artifacts unless `cache` has it, `at_once` builds at a time.

    What is kept is named by the build, the scope and a hash of the artifacts' contents, so other artifacts
    never meet an old index. A build whose artifacts aren't there, or whose contents can't be read, is left out with a
    warning, so its sites are unresolved; a job that fails for another reason (a lost executor, a full disk) fails here too.
    """
    import logging
    from multiprocessing.pool import ThreadPool

    from py4j.protocol import Py4JError
    from pyspark import inheritable_thread_target
    from pyspark.errors import PySparkException

    from ..sources.archives import chosen

    folders = chosen(spark, artifacts, builds, scope)

    @inheritable_thread_target(spark)
    def index(build: str) -> DataFrame | None:
        try:
            return index_of_build(spark, build, folders[build], cache, scope)
        except (PySparkException, Py4JError, ValueError) as e:
            if not unreadable(e):
                raise
            logging.getLogger(__name__).warning("no index of build %s: %s", build, e)

    out = spark.createDataFrame([], SITE_INDEX)
    if builds:
        with ThreadPool(min(at_once, len(builds))) as pool:
            for own in pool.map(index, builds, 1):
                out = out if own is None else out.unionByName(own)
    return out


def index_of_build(spark, build: str, folder: str, cache: str | None, scope: str) -> DataFrame:
    """The site index of the build whose archives are in `folder`, taken from `cache` or written there."""
    import hashlib

    from ..sources.archives import class_files, versions
    from ..sources.bytecode import class_facts
    from ..storage import shared_dir
    from .naming import lock_points

    # The scope is one of archives in a folder; the one archive of a build is taken whole.
    files = class_files(spark, folder, "*" if folder.endswith(".zip") else scope)
    # One row an archive: a hash of its name and contents.
    parts = versions(files).select(F.concat_ws(" ", "path", "version").alias("v")).agg(F.sha2(F.array_join(F.sort_array(F.collect_list("v")), "\n"), 256)).first()[0]
    version = hashlib.sha256(f"{scope} {parts}".encode()).hexdigest()[:16]
    path = f"{cache or shared_dir(spark) + '/site-index'}/{safe_name(build)}-{version}"
    if not finished(spark, path):
        # Also where a job failed half way: what it left has no mark.
        site_index(lock_points(class_facts(files)[1]), build).write.mode("overwrite").parquet(path)
    return spark.read.schema(SITE_INDEX).parquet(path).withColumn("build_id", F.lit(build))


def unreadable(e: Exception) -> bool:
    """Whether an error tells of artifacts that aren't there or of their contents: a reader in a task raised it."""
    from pyspark.errors import AnalysisException, PythonException

    if isinstance(e, ValueError | PythonException):
        return True
    if isinstance(e, AnalysisException):
        return e.getCondition() == "PATH_NOT_FOUND"
    # Below a failed write the reader's error is a cause of the job's.
    return "org.apache.spark.api.python.PythonException" in f"{e} {getattr(e, '_stackTrace', '')}"


def finished(spark, path: str) -> bool:
    """Whether a write to `path` has come to its end: only then Spark leaves its mark there."""
    mark = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    return mark.getFileSystem(spark._jsc.hadoopConfiguration()).exists(mark)


def safe_name(build: str) -> str:
    """A build's name as a file name."""
    import re

    return re.sub(r"[^A-Za-z0-9._-]", "_", build)
