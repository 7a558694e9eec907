"""Aggregates whose tasks stay small as tables grow, and numbering in one sort."""

from __future__ import annotations

from pyspark.sql import functions as F

from holdfast.operators import relational


def test_must_intersection_deals_rows_out(spark, monkeypatch):
    monkeypatch.setattr("holdfast.storage.ROWS_EACH", 10)
    sites = [(s % 7, s) for s in range(90)] + [(0, 0), (8, None)]
    held = [(k, s, item) for k, s in sites[:90] for item in ("all", *(["odd"] if s % 2 else [])) for _ in range(2)] + [(3, 3, "once")]
    out = relational.must_intersection(spark.createDataFrame(sites, "k long, site long"), spark.createDataFrame(held, "k long, site long, item string"), ["k"], "site", "item")
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert f", {-(-len(held) // 10)})" in plan
    assert sorted(map(tuple, out.collect())) == [(k, "all") for k in range(7)]


def test_numbers_without_a_second_shuffle_of_the_rows(spark):
    rows = spark.range(1000).select((F.col("id") * 7 % 1000).alias("n"), F.repeat(F.lit("x"), 50).alias("wide"))
    out = relational.numbered(rows, ["n"], "number", 5)
    # What is left are the partitions' sizes: no window over the rows themselves.
    assert out._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning(_part") <= 1
    assert out.where("number <> n + 5").count() == 0 and out.count() == 1000
    assert out.columns == ["n", "wide", "number"]


def test_pairs_are_dealt_out(spark, monkeypatch):
    monkeypatch.setattr(relational, "BLOCK", 10)
    monkeypatch.setattr(relational, "PAIRS_EACH", 500)
    left = [(0, f"a{i}") for i in range(60)] + [(1, "b"), (2, "none"), (None, "null")]
    right = [(0, i) for i in range(70)] + [(1, i) for i in range(25)] + [(3, 9), (None, 1)]
    out = relational.paired(spark.createDataFrame(left, "k long, x string").coalesce(1), spark.createDataFrame(right, "k long, y long").coalesce(1), "k")
    assert sorted(map(tuple, out.collect())) == sorted((k, x, y) for k, x in left for j, y in right if k is not None and k == j)
    # A key with 4,200 pairs is made in many tasks.
    sizes = [r["count"] for r in out.where("k = 0").groupBy(F.spark_partition_id()).count().collect()]
    assert len(sizes) >= 3 and max(sizes) < 3_000
