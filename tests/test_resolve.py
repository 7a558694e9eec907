"""Observations to locks, against known answers."""

import pytest
from pyspark.sql import functions as F

from holdfast.functions import names
from holdfast.plans.resolve import SITE_INDEX, resolve, resolve_sites
from holdfast.sources import observations
from holdfast.streaming import resolve_stream

# Two files of one name in two packages, a nested class, two locks on one line, a lock without a line; another build.
YARD = [
    ("n7", "org/yard/Crane.java", "org.yard.Crane.lift:(I)V", 104, "org.yard.Crane.mHook"),
    ("n7", "org/yard/Crane.java", "org.yard.Crane.lower:()V", 118, "org.yard.Crane.mCable"),
    ("n7", "org/yard/Crane.java", "org.yard.Crane.lower:()V", 118, "org.yard.Crane.mBrake"),
    ("n7", "org/yard/Crane.java", "org.yard.Crane$Arm$1.turn:()Z", 131, "org.yard.Crane$Arm.mJoint"),
    ("n7", "org/yard/Crane.java", "org.yard.Crane.idle:()V", None, "org.yard.Crane.mUnseen"),
    ("n7", "org/yard/rail/Crane.java", "org.yard.rail.Crane.roll:()V", 120, "org.yard.rail.Crane.class"),
    ("n7", "org/yard/rail/Gate.java", "org.yard.rail.Gate.open:()V", 9, "org.yard.rail.Gate"),
    ("n7", "org/yard/rail/Gate.java", "org.yard.rail.Gate.shut:()V", 33, "org.yard.rail.Gate"),
    ("n8", "org/yard/rail/Gate.java", "org.yard.rail.Gate.open:()V", 11, "org.yard.rail.Gate.mBolt"),
]
BOTH = "org.yard.Crane.mBrake, org.yard.Crane.mCable"


@pytest.mark.parametrize(
    ("text", "fuzz", "method", "sole", "want"),
    [
        # On the line: a bare name finds all packages, a path only files that end in it.
        ("Crane.java:104", 0, None, False, "org.yard.Crane.mHook"), ("Crane.java:131", 0, None, False, "org.yard.Crane$Arm.mJoint"),
        ("Crane.java:118", 0, None, False, BOTH), ("Crane.java:120", 0, None, False, "org.yard.rail.Crane.class"),
        ("rail/Crane.java:118", 0, None, False, "N/A"), ("out/src/org/yard/rail/Crane.java:120", 0, None, False, "org.yard.rail.Crane.class"),
        # Near it: the nearest line, the lower one of two, and none beyond the bound.
        ("Crane.java:111", 7, None, False, "org.yard.Crane.mHook"), ("Crane.java:111", 6, None, False, "N/A"), ("Crane.java:119", 3, None, False, BOTH),
        ("Crane.java:125", 6, None, False, "org.yard.rail.Crane.class"), ("Crane.java:127", 4, None, False, "org.yard.Crane$Arm.mJoint"), ("Crane.java:127", 3, None, False, "N/A"),
        # The only name: of a file with several lines, of one method; not if there are more.
        ("Gate.java:500", 2, None, True, "org.yard.rail.Gate"), ("Gate.java:500", 2, None, False, "N/A"), ("Crane.java:500", 2, None, True, "N/A"),
        ("Crane.java:500", 0, "Crane.lift", True, "org.yard.Crane.mHook"), ("Crane.java:500", 0, "Crane.lower", True, "N/A"), ("Winch.java:104", 9, None, True, "N/A"),
    ],
)
def test_lookup(spark, text, fuzz, method, sole, want):
    index = spark.createDataFrame(YARD, SITE_INDEX)
    asked = spark.createDataFrame([("n7", text)], "build_id string, text string")
    assert [r.resolved for r in resolve_sites(asked, index, fuzz, sole, method).collect()] == [want]


def test_sites(spark):
    good = {"Foo.java:12": ("Foo.java", 12), "com/example/pkg/Foo.java:9": ("com/example/pkg/Foo.java", 9), " a:b: 7 ": ("a:b", 7), "a:+3": ("a", 3)}
    bad = ["Foo.java", "Foo.java:abc", ":12", "Foo.java:<lambda>:3", "", None, "a:", "a:1_0", "a:99999999999999999999"]
    rows = spark.createDataFrame([(t,) for t in [*good, *bad]], "t string").select("t", names.site(F.col("t")).alias("s"))
    assert {r.t: r.s and tuple(r.s) for r in rows.collect()} == good | dict.fromkeys(bad)


def test_names(spark):
    row = spark.range(1).select(
        names.relative_path(F.lit("a.b.C$D$1")).alias("path"), names.dotted(F.lit("La/b$C;")).alias("dotted"), names.dotted(F.lit("[I")).alias("same"),
        names.parameters(F.lit("(Lcom/foo/Bar;I[[J[La/B;D)V")).alias("parameters"), names.short_name(F.lit("a.b.C.mLock")).alias("short"),
        names.flag(F.lit(0x18), names.STATIC).alias("static"), names.flag(F.lit(0x18), names.PRIVATE).alias("private"),
        names.line_at(F.expr("array(named_struct('offset', 2, 'line', 5), named_struct('offset', 6, 'line', 9))"), F.lit(5)).alias("line"),
        names.line_at(F.expr("array(named_struct('offset', 2, 'line', 5))"), F.lit(1)).alias("before"),
    ).first()
    assert tuple(row) == ("a/b/C.java", "a.b$C", "[I", ["Lcom/foo/Bar;", "I", "[[J", "[La/B;", "D"], "C.mLock", True, False, 5, None)


HEADER = "build_id,device_name,extra,blocked_src,blocking_src,short_blocked_method,short_blocking_method\n"


def test_resolve_csv(spark, tmp_path):
    path = tmp_path / "in.csv"
    path.write_text(HEADER + 'B1,demo,"x, ""y""\n z",Svc.java:10, Svc.java:20,a,b\nB1,demo,,Svc.java:20,Svc.java:10,b,a\nB2,demo,,Svc.java:10,nothing,a,\n')
    index = spark.createDataFrame([("B1", "demo/Svc.java", "m", 10, "demo.Svc.mLock"), ("B1", "demo/Svc.java", "m", 20, "demo.Other.mGuard")], SITE_INDEX)
    rows = observations.read_observations(spark, str(path))
    out = resolve(rows, index)
    assert out.columns == [*rows.columns, *observations.RESOLVED]
    got = {(r.build_id, r.blocked_src): (r.extra, *r[-2:]) for r in out.collect()}
    assert got == {
        ("B1", "Svc.java:10"): ('x, "y"\n z', "demo.Svc.mLock", "demo.Other.mGuard"), ("B1", "Svc.java:20"): ("", "demo.Other.mGuard", "demo.Svc.mLock"),
        ("B2", "Svc.java:10"): ("", "N/A", "N/A"),
    }
    # Resolved columns that are there are overwritten in place.
    assert resolve(out, index).columns == out.columns
    observations.write_csv(out, str(tmp_path / "out"))
    assert spark.read.csv(str(tmp_path / "out"), header=True, multiLine=True, escape='"').count() == 3
    path.write_text("build_id,device_name\nB,d\n")
    with pytest.raises(ValueError, match="blocked_src"):
        observations.read_observations(spark, str(path))


def test_synthetic_compact(spark):
    rows = observations.synthetic(spark, "B", "d", [("Svc.java:10", "Svc.java:20")], 5)
    index = spark.createDataFrame([("B", "x/Svc.java", "m", 10, "one"), ("B", "x/Svc.java", "m", 20, "two")], SITE_INDEX)
    (row,) = observations.compact(resolve(rows, index)).collect()
    assert (row.resolved_blocked_lock, row.resolved_blocking_lock, row.traces) == ("one", "two", 5)
    first = observations.selected(rows.repartition(3).withColumn("n", F.monotonically_increasing_id()), "B", "d", 2)
    assert first.count() == 2 and first.columns == [*rows.columns, "n"] and observations.selected(rows, "C").count() == 0


def test_stream_is_like_a_table(spark, tmp_path):
    rows = observations.synthetic(spark, "B", "d", [("Svc.java:10", "Svc.java:20"), ("Svc.java:20", "no")], 6)
    index = spark.createDataFrame([("B", "x/Svc.java", "m", 10, "one"), ("B", "x/Svc.java", "m", 20, "two")], SITE_INDEX)
    rows.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = resolve_stream(stream, index, str(tmp_path / "out"), str(tmp_path / "state"))
    q.processAllAvailable()
    q.stop()
    got = spark.read.parquet(str(tmp_path / "out")).select(*observations.RESOLVED).collect()
    assert sorted(map(tuple, got)) == sorted([("one", "two")] * 3 + [("two", "N/A")] * 3)


def test_archives(spark, tmp_path):
    import io
    import zipfile

    from holdfast.sources.archives import class_files

    inner = io.BytesIO()
    with zipfile.ZipFile(inner, "w") as z:
        z.writestr("classes.dex", b"dex\n035 inner")
        z.writestr("readme.txt", b"no")
    with zipfile.ZipFile(tmp_path / "a.apk", "w") as z:
        z.writestr("classes2.dex", b"dex\n035 outer")
        z.writestr("lib/x.jar", inner.getvalue())
    (tmp_path / "b.dex").write_bytes(b"dex\n035 plain")
    (tmp_path / "c.jar").write_bytes(b"no archive at all")
    got = [(r.ordinal, r.member, bytes(r.content)) for r in class_files(spark, str(tmp_path)).collect()]
    assert got == [(0, "a.apk!classes2.dex", b"dex\n035 outer"), (1, "a.apk!lib/x.jar!classes.dex", b"dex\n035 inner"), (0, "b.dex", b"dex\n035 plain")]
