"""Mixing sources to target weights along a time-varying curriculum, in DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import HOT_GROUPS, hash_place, join_groups, n_buckets, n_words, running_sum, written

#: Weights of the sources in order of code points, null last, repeating.
WEIGHTS = (5, 2, 1)
#: No source, and so no document, is taken more often.
MOST_REPEATS = 3


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST_REPEATS) -> DataFrame:
    """From source, source_size: adds weight and target.

    The targets share the sum of all sizes by weight and stop at `most` times the source's size;
    what is above is shared again by weight. That ends at one level x with target
    = min(cap, weight * x): sources are capped in order of cap / weight, so the level follows
    from running sums in that order. One row a source goes through these windows.
    """
    order = Window.orderBy(F.col("source").isNull(), "source")
    weight = F.element_at(F.array(*map(F.lit, weights)), ((F.row_number().over(order) - 1) % len(weights)) + 1)
    rows = sizes.withColumn("weight", weight.cast("long")).withColumn("cap", most * F.col("source_size"))
    every = Window.partitionBy(F.lit(0))
    by_level = every.orderBy(F.col("cap") / F.col("weight"), F.col("source").isNull(), "source")
    before = by_level.rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("all", F.sum("source_size").over(every)).withColumn("all_weight", F.sum("weight").over(every))
    left = F.col("all") - F.coalesce(F.sum("cap").over(before), F.lit(0))
    left_weight = F.col("all_weight") - F.coalesce(F.sum("weight").over(before), F.lit(0))
    # This source and all after it in that order share `left` by weight unless it is capped first.
    rows = rows.withColumn("left", left).withColumn("left_weight", left_weight)
    rows = rows.withColumn("capped", F.col("left") * F.col("weight") > F.col("cap") * F.col("left_weight"))
    # Of the uncapped ones the first in that order has the level: its left_weight is the largest.
    level = F.max(F.when(~F.col("capped"), F.struct("left_weight", "left"))).over(every)
    rows = rows.withColumn("level", level)
    share = F.col("weight") * F.col("level.left") / F.col("level.left_weight")
    target = F.when(F.col("capped"), F.col("cap").cast("double")).otherwise(share)
    return rows.select("source", "source_size", "n_rows", "weight", target.alias("target"))


def curriculum_time(demand: Column, slope: Column) -> Column:
    """The time in [0, 1] at which the cumulative demand, as a share of the source's, is reached.

    A source's weight at time t is target * (1 + slope * (2 t - 1)); its integral is
    target * ((1 - slope) * t + slope * t^2), which is inverted here.
    """
    a, b = slope, 1 - slope
    return F.when(F.abs(a) < 1e-9, demand).otherwise((-b + F.sqrt(b * b + 4 * a * demand)) / (2 * a))


def with_slopes(targets: DataFrame, weights: tuple[int, ...], steepest: float) -> DataFrame:
    """Adds `slope`: how the weight of each source changes over training, heavy sources first.

    The slopes' mean, weighted by target, is 0, so all sources together are asked for evenly: a time in [0, 1] is
    also the share of the joint stream that comes before it. None is steeper than `steepest`.
    """
    every = Window.partitionBy(F.lit(0))
    rows = targets.withColumn("lean", 1 - 2 * (F.col("weight") - min(weights)) / F.lit(float(max(1, max(weights) - min(weights)))))
    total = F.sum("target").over(every)
    mean = F.when(total > 0, F.sum(F.col("lean") * F.col("target")).over(every) / total).otherwise(F.lit(0.0))
    rows = rows.withColumn("lean", F.col("lean") - mean)
    most = F.max(F.abs("lean")).over(every)
    return rows.withColumn("slope", F.lit(steepest) * F.col("lean") / F.greatest(F.lit(1.0), most)).drop("lean")


def mix_sources(docs: DataFrame, id_col: str = "doc_id", text: str = "text", source: str = "source", weights: tuple[int, ...] = WEIGHTS, most: int = MOST_REPEATS, steepest: float = 0.8, row: str | None = None) -> DataFrame:
    """How many words of each document the mix takes, and when: sorted by position.

    Size is the number of words (null text: 0). Documents of a source stand in the order of
    a hash of their id. The source's stream of `target` words goes through them again and again:
    each full pass takes all words, the last one ends within a document, so the words taken of
    a source are its target, cut to whole words. The weight of a source changes linearly over
    training; heavy sources come early, and all together are even. The cumulative demand is inverted to give
    each document a place in the joint stream for each pass that takes it: `positions`, shares of
    all words in [0, 1]. `position` is the first (null if none is taken), and the result is sorted by it.

    Running sums go over buckets of the hash, first within a bucket, then over the buckets'
    sums, so no source needs to fit a task. Null ids and sources are values like others, repeated
    rows are documents of their own, an empty table gives an empty result, sources of no
    words have target 0. `row` names a column of unique numbers that is returned too, to find the rows again.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.col(source).alias("source"), n_words(F.col(text)).alias("size"), *([F.col(row).alias("row")] if row else []))
    # A key that is never null: the null source is one like others.
    key = F.when(F.col("source").isNull(), F.lit("-")).otherwise(F.concat(F.lit("+"), F.col("source").cast("string")))
    rows = written(rows.withColumn("place", hash_place("id")).withColumn("key", key), "mix-sizes")
    sums = rows.groupBy("key", "source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n_rows"))
    targets = source_targets(sums.drop("key"), weights, most)
    targets = with_slopes(targets, weights, steepest).withColumn("key", key)
    targets = written(targets.select("key", "source_size", "n_rows", "target", "slope"), "mix-targets")
    n_rows = targets.agg(F.sum("n_rows")).first()[0] or 0
    rows = running_sum(rows, ["key"], "place", ["id", "size", *(["row"] if row else [])], "size", "start", n_buckets(n_rows))
    few = targets.count() <= HOT_GROUPS
    rows = rows.join(F.broadcast(targets), "key") if few else join_groups(written(rows, "mix-starts"), targets, "key", "n_rows")
    words = F.floor("target").cast("long")
    passes = F.when(F.col("source_size") > 0, F.floor(words / F.greatest("source_size", F.lit(1)))).otherwise(0).cast("long")
    rows = rows.withColumn("passes", passes)
    last = words - F.col("passes") * F.col("source_size") - F.col("start")
    rows = rows.withColumn("last", F.greatest(F.lit(0), F.least("size", last)).cast("long"))
    taken = F.col("passes") * F.col("size") + F.col("last")
    demand = lambda k: F.least(F.lit(1.0), (F.col("start") + k * F.col("source_size")) / F.greatest("target", F.lit(1.0)))
    n_times = F.when(F.col("size") > 0, F.col("passes") + (F.col("last") > 0).cast("long")).otherwise(0)
    times = F.when(n_times > 0, F.sequence(F.lit(0).cast("long"), n_times - 1)).otherwise(F.array().cast("array<long>"))
    rows = rows.withColumn("positions", F.transform(times, lambda k: curriculum_time(demand(k), F.col("slope")))).withColumn("taken", taken)
    return rows.select(
        F.col("id").alias(id_col), F.col("source").alias(source), "size", "source_size", "target", "taken", F.get("positions", F.lit(0)).alias("position"), "positions", *([F.col("row").alias(row)] if row else [])
    ).orderBy(F.col("position").asc_nulls_last(), id_col)
