"""The command line over small archives and programs, end to end."""

import json
import zipfile

import programs
import pytest
from pyspark.errors import AnalysisException
from test_bytecode import locks

from holdfast import __main__ as command
from holdfast.plans.resolve import index_of_builds, safe_name, unreadable


@pytest.fixture(scope="module")
def jars(tmp_path_factory):
    root = tmp_path_factory.mktemp("builds")
    for build in ("B1", "B2"):
        (root / build).mkdir()
    with zipfile.ZipFile(root / "B1" / "a.jar", "w") as z:
        z.writestr("classes.dex", locks().bytes())
    (root / "B2" / "bad.jar").write_bytes(b"PK\x03\x04 broken")
    return root


def test_resolve(spark, jars, tmp_path):
    head = "build_id,device_name,blocked_src,blocking_src,short_blocked_method,short_blocking_method\n"
    (tmp_path / "in.csv").write_text(head + "B1,d,Crate.java:5,Crate.java:7,a,b\nB2,d,Crate.java:5,Crate.java:6,a,b\nB1,d,Crate.java:5,Crate.java:7,a,b\n")
    run = lambda *more: command.main(["resolve", str(tmp_path / "in.csv"), "--artifacts", str(jars), "--cache", str(tmp_path / "cache"), "-o", str(tmp_path / "out"), *more])
    read = lambda: spark.read.csv(str(tmp_path / "out"), header=True)
    run()
    assert sorted((r.build_id, r.resolved_blocked_lock, r.resolved_blocking_lock) for r in read().collect()) == [("B1", "quay.Crate.lid", "N/A")] * 2 + [("B2", "N/A", "N/A")]
    assert [p.name.split("-")[0] for p in (tmp_path / "cache").iterdir()] == ["B1"]
    run("--source", "observations", "--build", "B2")
    assert [(r.build_id, r.resolved_blocked_lock, r.resolved_blocking_lock) for r in read().collect()] == [("B2", "N/A", "N/A")]
    run("--fuzz", "1", "--build", "B1", "--compact-counts")
    assert [(r.resolved_blocking_lock, r.traces) for r in read().collect()] == [("quay.Crate.seal", "2")]
    # Build by build: a folder each, and a later run over one build leaves the other's rows.
    out = str(tmp_path / "parts")
    for more in ([], ["--build", "B1", "--fuzz", "1"]):
        run("--by-build", *more, "-o", out)
    rows = spark.read.csv(out, header=True).collect()
    assert sorted((r.build_id, r.resolved_blocked_lock, r.resolved_blocking_lock) for r in rows) == [("B1", "quay.Crate.lid", "quay.Crate.seal")] * 2 + [("B2", "N/A", "N/A")]


def test_one_archive_a_build(spark, jars, tmp_path):
    """A build's archives in one zip, taken whole whatever the scope; damaged contents leave the build out, other failures don't pass."""
    with zipfile.ZipFile(tmp_path / "B7.zip", "w") as z:
        z.write(jars / "B1" / "a.jar", "out/framework/a.jar")
    (tmp_path / "B8").mkdir()
    (tmp_path / "B8" / "classes.dex").write_bytes(b"dex\n035\x00 cut off")
    index = index_of_builds(spark, ["B7", "B8"], str(tmp_path), scope="services*")
    assert {(r.build_id, r.lock) for r in index.collect()} == {("B7", f"quay.Crate.{n}") for n in ("class", "lid", "seal")}
    assert not unreadable(RuntimeError("no space left on device"))
    with pytest.raises(AnalysisException) as wrong:
        spark.range(1).select("nothing")
    assert not unreadable(wrong.value)
    with pytest.raises(AnalysisException) as absent:
        spark.read.text(str(tmp_path / "absent"))
    assert unreadable(absent.value)


def test_dump(spark, jars, tmp_path):
    command.main(["dump", str(jars / "B1"), "--format", "json", "-o", str(tmp_path / "points")])
    assert sorted(r.lock for r in spark.read.json(str(tmp_path / "points")).collect()) == ["quay.Crate.class", "quay.Crate.lid", "quay.Crate.seal"]
    command.main(["dump", str(jars / "B1"), "-o", f"file://{tmp_path}/columns"])
    assert list((tmp_path / "columns").glob("*.pb"))


def write_tables(spark, program, path) -> str:
    for name, table in zip(("classes", "methods", "field_flags"), program.tables(spark), strict=True):
        (table.drop("method_id", "key") if name == "methods" else table).write.parquet(f"{path}/{name}")
    return str(path)


def test_index_and_questions(spark, tmp_path, capsys):
    facts = write_tables(spark, programs.trains(), tmp_path / "facts")
    command.main(["index", facts, "--facts", "parquet", "-o", str(tmp_path / "index")])
    ask = lambda *asked: command.main(["ask", str(tmp_path / "index"), *asked]) or capsys.readouterr().out
    found = json.loads(ask("--at", "Train.java:7", "--lock", "hook", "--cycles", "--remote", "--json"))
    (test,) = found[0]["methods"]
    path = [f"yard.Train.{m}:()V" for m in ("couple", "check", "test")]
    assert test["key"] == path[-1] and test["may_hold"] == [{"lock": "yard.Train.hook", "dist": 2, "path": path}]
    assert {r["method"] for r in found[1]["sites"]} == {path[0], "yard.Train.blow:()V"} and [r["to"] for r in found[1]["after"]] == ["yard.Train.valve"]
    assert [len(c) for c in found[2]["cycles"]] == [3, 2, 2] and len(found[2]["ungated"]) == 1 and found[3]["calls"] == []
    text = ask("--method", "vent", "--at", "Train.java:7", "--lock", "horn", "--cycles")
    for line in ("  holds yard.Train.valve", "  may hold yard.Train.hook at distance 2", "taken in yard.Train.blow:()V (Train.java:9): yard.Train.horn", "cycle of 3: Train.hook, Train.horn, Train.valve", "Train.lamp and Train.sign in both orders, 1 and 1 times"):
        assert line in text.splitlines(), line
    with pytest.raises(SystemExit):
        ask()


def test_remote_and_races(spark, tmp_path):
    facts = write_tables(spark, programs.tower(), tmp_path / "tower")
    command.main(["remote", facts, "--facts", "parquet", "-o", str(tmp_path / "remote")])
    assert spark.read.json(str(tmp_path / "remote")).count() == 2
    facts = write_tables(spark, programs.vault(), tmp_path / "vault")
    command.main(["races", facts, "--facts", "parquet", "-o", str(tmp_path / "races")])
    assert [(r.field, len(r.guarded_at)) for r in spark.read.json(str(tmp_path / "races")).orderBy("field").collect()] == [("bank.Vault.count", 5), ("bank.Vault.notes", 5)]


def test_file_names():
    assert safe_name("a/b:c d-1.2_x") == "a_b_c_d-1.2_x"
