"""Sources by name, listings of builds, and bounded evidence."""

import zipfile

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from holdfast.sources import observations
from holdfast.sources.archives import chosen
from holdfast.sources.seam import Traces, register

HEADER = "build_id,device_name,extra,blocked_src,blocking_src,short_blocked_method,short_blocking_method\n"


def test_csv_by_name(spark, tmp_path):
    register(spark)
    folder = tmp_path / "in"
    (folder / "_old").mkdir(parents=True)
    (folder / "_old" / "x.csv").write_text("not,these\n1,2\n")
    (folder / "a.csv").write_text(HEADER + 'B1, demo,"x, ""y""\n z",Svc.java:10, Svc.java:20,a,b\nB2,demo,,Svc.java:20,,b,a\n')
    (folder / "b.csv").write_text(HEADER + "B1,other,1,Svc.java:1,NA,null,\n")
    (folder / "empty.csv").write_text("")
    read = lambda path: spark.read.format("observations").load(str(path))
    rows = read(folder)
    plain = observations.read_observations(spark, str(folder / "[ab].csv"))
    assert rows.columns == plain.columns and sorted(map(tuple, rows.collect())) == sorted(map(tuple, plain.collect()))
    asked = lambda **options: sorted((r.build_id, r.device_name) for r in spark.read.format("observations").options(**options).load(str(folder)).collect())
    assert asked(build_id="B1") == [("B1", "demo"), ("B1", "other")] and asked(build_id="B1", device_name="other") == [("B1", "other")]
    assert asked(device_name="demo") == [("B1", "demo"), ("B2", "demo")] and asked(build_id="B3") == []
    # Two filters over one table.
    both = rows.where("build_id = 'B1'").unionByName(rows.where("build_id = 'B2'"))
    assert sorted((r.build_id, r.device_name) for r in both.collect()) == [("B1", "demo"), ("B1", "other"), ("B2", "demo")]
    assert read(folder / "b.csv").count() == 1
    (tmp_path / "bad.csv").write_text("build_id,device_name\nB,d\n")
    with pytest.raises(Exception, match="blocked_src"):
        read(tmp_path / "bad.csv").collect()


def test_what_is_asked_reaches_the_source(spark):
    class Harbour(Traces):
        """A source of one's own: a part for each build, the rows of one of them."""

        @classmethod
        def name(cls):
            return "harbour"

        def parts(self, build, device):
            return [b for b in ("n1", "n2", "n3") if build in (None, b)]

        def fetch(self, part, build, device):
            texts = [[part] * 2, ["d1", "d2"], ["Pier.java:4"] * 2, ["Quay.java:9"] * 2, ["a"] * 2, ["b"] * 2]
            yield pa.RecordBatch.from_arrays([pa.array(t) for t in texts], observations.COLUMNS)

    register(spark, Harbour)
    rows = spark.read.format("harbour").load()
    assert rows.count() == 6 and rows.rdd.getNumPartitions() == 3
    one = spark.read.format("harbour").options(build_id="n2", device_name="d1").load()
    assert one.rdd.getNumPartitions() == 1 and [tuple(r)[:2] for r in one.collect()] == [("n2", "d1")]
    assert spark.read.format("harbour").option("build_id", "n9").load().count() == 0


def test_synthetic_by_name(spark):
    register(spark)
    rows = spark.read.format("synthetic_observations").options(build="B", device="d", n="1048579", sites="A.java:1 B.java:2,C.java:3 D.java:4").load()
    want = observations.synthetic(spark, "B", "d", [("A.java:1", "B.java:2"), ("C.java:3", "D.java:4")], 1048579)
    count = lambda r: sorted(map(tuple, r.groupBy(*observations.COLUMNS).count().collect()))
    assert count(rows) == count(want)


def test_listing(spark, tmp_path):
    """The preferred folder before the build's own, that before its one zip, that before the root."""

    def jar(path):
        path.parent.mkdir(parents=True, exist_ok=True)
        with zipfile.ZipFile(path, "w") as z:
            z.writestr("classes.dex", b"dex\n035")

    jar(tmp_path / "both" / "soong" / "system_server_dexjars" / "services.jar")
    jar(tmp_path / "both" / "lib" / "other.jar")
    jar(tmp_path / "own" / "a.jar")
    jar(tmp_path / "own" / "soong" / "system_server_dexjars" / "deep" / "b.jar")
    jar(tmp_path / "one.zip")
    jar(tmp_path / "a" / "b" / "c.jar")
    root = str(tmp_path)
    assert chosen(spark, root, ["both", "own", "one", "none", "a/b"]) == {
        "both": f"{root}/both/soong/system_server_dexjars", "own": f"{root}/own", "one": f"{root}/one.zip", "none": root, "a/b": f"{root}/a/b",
    }
    # A scope that no archive of the preferred folder has leaves the build's own folder.
    assert chosen(spark, root, ["both"], "oth*") == {"both": f"{root}/both"}
    assert chosen(spark, f"{root}/nothing", ["x"]) == {"x": f"{root}/nothing"}


def test_bounded_evidence(spark):
    """The first accesses by the order of evidence; what each task shuffles of a hot field is bounded."""
    from holdfast.plans.race import evidence

    n = 1_000_000
    access = F.struct(F.format_string("m%07d", (F.col("id") * 7919) % n).alias("method"), F.lit("F").alias("file"), F.col("id").cast("int").alias("line"), F.lit(True).alias("write"), F.array().cast("array<string>").alias("held"), F.lit(False).alias("concurrent"))
    hot = spark.range(n).select(F.lit("hot").alias("field"), F.when(F.col("id") % 3 == 0, "guarded").otherwise("open").alias("side"), access.alias("access"))
    few = hot.limit(2).withColumn("field", F.lit("few"))
    first = evidence(hot.unionByName(few), {"guarded": 5, "open": 7})
    assert "WindowGroupLimit" in first._jdf.queryExecution().toString()
    rows = {r.field: r for r in first.collect()}
    want = sorted((f"m{i * 7919 % n:07d}", i, i % 3 == 0) for i in range(n))
    for name, guarded, k in (("guarded_at", True, 5), ("unguarded", False, 7)):
        assert [(a.method, a.line) for a in rows["hot"][name]] == [w[:2] for w in want if w[2] == guarded][:k]
    assert len(rows["few"].guarded_at) + len(rows["few"].unguarded) == 2
    all_ = evidence(few, {"guarded": None, "open": 1}).first()
    assert len(all_.guarded_at) == 1 and len(all_.unguarded) == 1
