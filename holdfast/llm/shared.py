"""What the operators share: the cluster's shared folder, written tables, skew-safe joins."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..storage import join_counted as join_checked
from ..storage import shared_dir, written

__all__ = ["documents", "free_name", "hash_place", "join_checked", "join_groups", "n_buckets", "n_words", "running_sum", "shared_dir", "tasks", "written"]

#: Words are runs of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
#: At most this many groups are ever broadcast; each has a bounded key and a few numbers.
HOT_GROUPS = 2000


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def free_name(df: DataFrame, stem: str) -> str:
    """A name that no column of `df` has, in whatever case."""
    taken = {c.lower() for c in df.columns}
    while stem.lower() in taken:
        stem += "_"
    return stem


def tasks(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def n_words(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(WORD)).cast("long")


def join_groups(rows: DataFrame, groups: DataFrame, key: str, size: str) -> DataFrame:
    """Inner join of `rows` with `groups`, of which each has one row and the count `size` of its rows.

    A group with more than a HOT_GROUPS-th of all rows would land in one task; there are fewer
    than HOT_GROUPS of these whatever the input, so they, and only they, are broadcast. `groups`
    should be a written table, as it is read three times.
    """
    total = groups.agg(F.sum(size)).first()[0] or 0
    limit = max(200, math.ceil(total / HOT_GROUPS))
    hot = groups.where(F.col(size) > limit)
    keys = F.broadcast(hot.select(key))
    rest = rows.join(keys, key, "left_anti").join(groups.where(F.col(size) <= limit), key)
    return rest.unionByName(rows.join(F.broadcast(hot), key).select(rest.columns))


def hash_place(*key) -> Column:
    """A stable, even order of rows by a hash of `key`."""
    return F.xxhash64(F.lit("place"), *key)


def n_buckets(n_rows: int, rows_per_bucket: int = 20_000) -> int:
    return max(256, n_rows // rows_per_bucket)


def running_sum(rows: DataFrame, by: list[str], place: str, ties: list[str], value: str, out: str, buckets: int) -> DataFrame:
    """Adds `out`: the sum of `value` over the rows before this one, in the order of `place`, among those equal in `by`.

    Two levels: within equal ranges of the hash `place`, and over these ranges' sums, so that no
    group of `by` needs to fit a task. `by` and `value` hold no nulls.
    """
    bucket = F.floor((F.col(place).cast("double") / F.lit(2.0**64) + 0.5) * buckets).cast("long")
    rows = rows.withColumn("_bucket", F.least(bucket, F.lit(buckets - 1)))
    sums = rows.groupBy(*by, "_bucket").agg(F.sum(value).alias("_sum"))
    before = Window.partitionBy(*by).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select(*by, "_bucket", F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_base"))
    within = Window.partitionBy(*by, "_bucket").orderBy(place, *ties).rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("_inner", F.coalesce(F.sum(value).over(within), F.lit(0)))
    return rows.join(sums, [*by, "_bucket"]).withColumn(out, F.col("_base") + F.col("_inner")).drop("_bucket", "_base", "_inner")

