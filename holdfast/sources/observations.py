"""Contention observations: CSV tables, synthetic ones, filters, and the ways to write results."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# The columns that every table of observations has.
COLUMNS = ["build_id", "device_name", "blocked_src", "blocking_src", "short_blocked_method", "short_blocking_method"]
RESOLVED = ["resolved_blocked_lock", "resolved_blocking_lock"]


def read_observations(spark: SparkSession, path: str) -> DataFrame:
    """All columns as text; the six fixed ones, which must be there, trimmed. Others pass through."""
    rows = spark.read.csv(path, header=True, mode="FAILFAST", multiLine=True, quote='"', escape='"', inferSchema=False)
    missing = [c for c in COLUMNS if c not in rows.columns]
    if missing:
        raise ValueError(f"no column {', '.join(missing)} in {path}")
    return rows.fillna("").withColumns({c: F.trim(c) for c in COLUMNS})


def selected(rows: DataFrame, build: str | None = None, device: str | None = None, limit: int = 0) -> DataFrame:
    """Rows of a build and a device, the first `limit` in the order of files and of rows in them (0: all)."""
    if build:
        rows = rows.where(F.col("build_id") == build)
    if device:
        rows = rows.where(F.col("device_name") == device)
    if not limit:
        return rows
    placed = rows.withColumns({"__file": F.input_file_name(), "__at": F.monotonically_increasing_id()})
    return placed.orderBy("__file", "__at").limit(limit).select(*rows.columns)


def synthetic(spark: SparkSession, build: str, device: str, sites: list[tuple[str, str]], n: int) -> DataFrame:
    """n observations that go round the pairs of sites (blocked, blocking)."""
    pairs = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a, b in sites])
    pair = F.element_at(pairs, (F.col("id") % len(sites) + 1).cast("int"))
    return spark.range(n).select(
        F.lit(build).alias("build_id"), F.lit(device).alias("device_name"), pair["a"].alias("blocked_src"), pair["b"].alias("blocking_src"),
        F.lit("").alias("short_blocked_method"), F.lit("").alias("short_blocking_method"),
    )


def compact(rows: DataFrame) -> DataFrame:
    """Counts of resolved pairs, the most frequent first."""
    keys = [*RESOLVED, "short_blocked_method", "short_blocking_method"]
    return rows.groupBy(*keys).agg(F.count("*").alias("traces")).orderBy(F.desc("traces"), *keys)


def write_csv(rows: DataFrame, path: str, gzip: bool = False) -> None:
    rows.write.mode("overwrite").option("header", True).option("escape", "\"").option("compression", "gzip" if gzip else "none").csv(path)


def write_build(rows: DataFrame, path: str, gzip: bool = False) -> None:
    """Resolved rows of some builds into the folders `build_id=...` below `path`; those of other builds stay as they are.

    So results can be read, and a stopped run repeated, build by build; the column build_id is in the folder's name.
    """
    out = rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("build_id")
    out.option("header", True).option("escape", "\"").option("compression", "gzip" if gzip else "none").csv(path)


def write_json(rows: DataFrame, path: str, gzip: bool = False) -> None:
    """One object a line, with nulls."""
    rows.write.mode("overwrite").option("ignoreNullFields", False).option("compression", "gzip" if gzip else "none").json(path)
