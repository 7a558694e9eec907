"""Lock analyses over small programs with known answers."""

import json

import programs
import pytest
from pyspark.sql import functions as F

from holdfast.plans.held import calls_under_lock, effects, walked
from holdfast.plans.index import Index, build
from holdfast.plans.naming import lock_points
from holdfast.plans.race import races
from holdfast.plans.report import answer
from holdfast.sources.sketches import Program


def test_lock_points(spark):
    _, methods, _ = programs.winch().tables(spark)
    got = {r.method.split(".")[-1].split(":")[0]: (r.line, r.lock, r.source_file) for r in lock_points(methods).collect()}
    want = {
        "reel": (33, "pier.Winch.drum"), "brake": (40, "pier.Dock.shared"), "hold": (None, "pier.Winch"), "audit": (52, "pier.Dock.class"),
        "splice": (60, "pier.Rope"), "odd": (66, "?@pier.Winch.odd:()V+0001"),
    }
    assert got == {k: (*v, "Winch.java") for k, v in want.items()}


def test_passed_and_returned_locks(spark):
    _, methods, _ = programs.passed_keys().tables(spark)
    # One maker through two constructors names the field; two makers leave it its own name; a getter's result is followed.
    assert {(r.line, r.lock) for r in lock_points(methods).collect()} == {(4, "pier.Dock.shared"), (9, "pier.Boat.key"), (12, "pier.Bell.cord")}


def test_calls_under_lock(spark):
    classes, methods, _ = programs.tower().tables(spark)
    got = [(r.method, r.file, r.line, r.held, r.callee) for r in calls_under_lock(classes, methods).collect()]
    # Both callers of relay hold the desk; one caller of shout holds nothing.
    assert got == [
        ("port.Tower.hail:()V", "Tower.java", 72, ["port.Tower.desk"], "port.Radio.send"), ("port.Tower.relay:()V", "Tower.java", 80, ["port.Tower.desk"], "port.Link.ping"),
    ]
    index = build(classes, methods)
    keys = {r.method_id: r.key.split(".")[-1].split(":")[0] for r in index.methods.collect()}
    assert sorted((keys[r.caller], r.lock, r.dist) for r in index.remote_calls().collect()) == [
        ("hail", "port.Tower.desk", 0), ("relay", "port.Tower.desk", 1), ("relay", "port.Tower.mast", 1), ("shout", "port.Tower.desk", 1),
    ]


@pytest.fixture(scope="module")
def index(spark):
    classes, methods, _ = programs.trains().tables(spark)
    return build(classes, methods)


def test_index(spark, index, tmp_path):
    keys = {r.method_id: r.key.split(".")[-1].split(":")[0] for r in index.methods.collect()}
    of = lambda *names: [f"yard.Train.{n}" for n in names]
    (hook,) = of("hook")
    assert {(keys[r.method_id], r.lock, r.dist) for r in index.may_held.collect()} == {("check", hook, 1), ("test", hook, 2)}
    orders = {(r["from"], r["to"]): r.dist for r in index.orders.collect()}
    ring = {("hook", "valve"): 2, ("valve", "horn"): 0, ("horn", "hook"): 0}
    pairs = dict.fromkeys([("lamp", "sign"), ("sign", "lamp"), ("bell", "siren"), ("siren", "bell"), ("guard", "bell"), ("guard", "siren")], 0)
    assert orders == {tuple(of(*k)): d for k, d in (ring | pairs).items()}
    assert [r.locks for r in index.cycles().collect()] == [of("hook", "horn", "valve"), of("bell", "siren"), of("lamp", "sign")]
    assert [(r["from"], r["to"], r.gate) for r in index.inversions().collect()] == [(*of("lamp", "sign"), None), tuple(of("bell", "siren", "guard"))]
    assert [(keys[r.method_id], r.held) for r in index.at("any/Train.java", 5).collect()] == [("couple", [hook])]
    assert {(keys[r.method_id], r.lock): [keys[m] for m in r.path] for r in index.witness(8).collect()}["test", hook] == ["couple", "check", "test"]
    near = index.distance("Train.", "hook").collect()
    assert {(keys[r.method_id], r.dist) for r in near} == {("check", 1), ("test", 2)}
    assert [(keys[r.caller], keys[r.target]) for r in index.callers_of("Train.check:").collect()] == [("couple", "check")]
    index.write(str(tmp_path))
    assert sorted(map(tuple, Index.read(spark, str(tmp_path)).orders.collect())) == sorted(map(tuple, index.orders.collect()))


def test_index_laid_out(spark, tmp_path):
    """Many files and locks: answers are those of the index that was never written, from a few of its files."""
    names = [f"Yard{i}.java" for i in range(12)]
    classes, methods, _ = programs.yards(12).tables(spark)
    index = build(classes, methods)
    index.write(str(tmp_path), methods_each=2)
    laid = Index.read(spark, str(tmp_path))
    for kind, text in (("at", f"{names[3]}:4"), ("at", "None.java:4"), ("method", "Yard7.shut"), ("method", "nothing"), ("lock", "Yard5.bar"), ("lock", "Yard1"), ("lock", "no"), ("cycles", None), ("remote", None)):
        got, want = answer(laid, kind, text), answer(index, kind, text)
        assert json.dumps(got, sort_keys=True) == json.dumps(want, sort_keys=True), (kind, text)
    assert answer(laid, "at", f"{names[3]}:4")["methods"][0]["may_hold"][0]["path"] == [f"port.Yard3.{m}:()V" for m in ("open", "shut")]
    whole = len(laid.methods.inputFiles())
    assert whole > 5 and len(laid.in_file(names[3]).inputFiles()) == 1 and len(laid.with_lock("may_held", "Yard5.bar").inputFiles()) == 1
    assert len(laid.of("spans", laid.in_file(names[3])).inputFiles()) == 1
    # A write that was stopped: its tables are there, the mark that names them isn't.
    (tmp_path / "tables-half" / "methods").mkdir(parents=True)
    assert Index.read(spark, str(tmp_path)).methods.count() == index.methods.count()


def test_empty_index(spark, tmp_path):
    classes, methods, _ = programs.trains().tables(spark)
    build(classes.limit(0), methods.limit(0)).write(str(tmp_path))
    laid = Index.read(spark, str(tmp_path))
    assert answer(laid, "at", "A.java:1")["methods"] == [] and answer(laid, "lock", "x")["sites"] == []


def test_control_flow(spark):
    classes, methods, _ = programs.saw().tables(spark)
    known = effects(methods)
    bolt = ["mill.Saw.bolt"]
    assert {r.key.split(".")[-1].split(":")[0]: (r.takes, r.gives) for r in known.collect()} == {"hold": (bolt, []), "fix": (bolt, []), "free": ([], bolt)}
    held = {r.name.split(".")[-1].split(":")[0]: r.held for r in walked(methods, known).where("kind = 'call'").collect()}
    want = dict.fromkeys(("plain", "first", "rescue", "inside", "risky"), ["mill.Saw.blade"]) | {"fixed": bolt, "changing": ["mill.Saw.plan.write"]}
    want |= {name: [] for name in ("freed", "joined", "done", "after", "changed", "loose")}
    assert {name: held[name] for name in want} == want
    index = build(classes, methods)
    keys = {r.method_id: r.key for r in index.methods.collect()}
    under = {keys[r.method_id] for r in index.may_held.collect() if r.lock == "mill.Saw.blade"}
    # Work that the callee does, or hands on to one that does, is done under the lock; queued work isn't.
    assert {"mill.Rip.go:()V", "mill.Plane.go:()V"} <= under and "mill.Sand.go:()V" not in under


def test_races(spark):
    rows = races(*programs.vault().tables(spark)).collect()
    assert [(r.field, r.guard, r.guarded, r.total) for r in rows] == [(f"bank.Vault.{f}", "bank.Vault.door", 5, 6) for f in ("count", "notes")]
    assert [[(u.method, u.line, u.concurrent) for u in r.unguarded] for r in rows] == [[("bank.Vault.run:()V", 21, True)], [("bank.Clerk.run:()V", 30, True)]]


def test_merge_keeps_the_first_copy(spark):
    p = Program()
    for artifact, names in enumerate((["kit.Hose"], ["kit.Pump", "kit.Hose"], ["kit.Pump", "kit.Tap"])):
        for name in names:
            p.cls(name, artifact=artifact)
            p.method(f"from{artifact}:()V", ["return"])
    classes, methods, _ = p.tables(spark)
    assert [(r.artifact_ord, r["class"]) for r in classes.orderBy("artifact_ord", "class_ord").collect()] == [(0, "kit.Hose"), (1, "kit.Pump"), (2, "kit.Tap")]
    assert [r.key for r in methods.orderBy("method_id").collect()] == ["kit.Hose.from0:()V", "kit.Pump.from1:()V", "kit.Tap.from2:()V"]


def test_methods_are_walked_once(spark, monkeypatch):
    from holdfast.plans import held

    p, lock = Program(), "java.util.concurrent.locks.ReentrantLock"
    p.cls("t.A")
    p.method("take:()V", ["iget 0 3 t.A.mL", f"virtual 0 {lock}.lock:()V", "return"], lines=1)
    p.method("span:()V", ["direct 3 t.A.take:()V", "iget 1 3 t.A.mX", "return"], lines={0: 2, 1: 3})
    for j in range(6):
        p.method(f"plain{j}:()V", ["iget 0 3 t.A.mA", "enter 0", f"direct 3 t.A.plain{(j + 1) % 6}:()V", "exit 0", "return"], lines=10 + j)
    classes, methods, _ = p.tables(spark)
    want = sorted(map(str, walked(methods, effects(methods)).collect()))
    sizes, kept = [], held.mapped
    monkeypatch.setattr(held, "mapped", lambda rows, make, ddl: sizes.append(rows.count()) or kept(rows, make, ddl))
    known, events = held.effects_and_events(methods)
    assert sorted(map(str, events.collect())) == want
    assert {r.key: r.takes for r in known.collect()} == {"t.A.take:()V": ["t.A.mL"], "t.A.span:()V": ["t.A.mL"]}
    # All eight for both; the one caller of a method with an effect again for its effect and for its events.
    sizes.clear()
    build(classes, methods)
    assert sum(sizes) <= 8 + 2


def test_programs_and_walks_are_dealt_out(spark, monkeypatch):
    """A program for each of some rows of one file, and methods by what they call: few bytes, much work, so never a single task."""
    from holdfast.plans.naming import called_keys, with_callees
    from holdfast.sources import sketches

    p = Program()
    p.cls("t.A{k}")
    p.method("a:()V", ["iget 0 3 t.A{k}.m", "enter 0", "virtual 3 t.A{k}.b:()V", "exit 0", "return"], lines=1)
    p.method("b:()V", ["return"], lines=2)
    parts, kept = {}, sketches.written
    monkeypatch.setattr(sketches, "written", lambda df, name: (parts.setdefault(name, df.rdd.getNumPartitions()), kept(df, name))[1])
    rows = spark.range(40).select(F.col("id").alias("k")).coalesce(1)
    classes, methods, _ = p.spread(rows, "k")
    assert parts["methods"] >= 4 and methods.count() == 80
    # Numbers go by artifact, class and method, and are those of no other method.
    got = [r["class"] + r.key[-5] for r in methods.orderBy("method_id").collect()]
    assert got == [f"t.A{k}{m}" for k in range(40) for m in "ab"] and methods.select("method_id").distinct().count() == 80
    effect = called_keys(methods).select("key", F.lit(1).alias("x"))
    sizes = with_callees(methods, effect, "effects").groupBy(F.spark_partition_id()).count().collect()
    assert len(sizes) >= 4 and sum(r["count"] for r in sizes) == 80


def test_methods_are_read_once_for_all_they_tell(spark, monkeypatch):
    """Walk and facts are of one way through the methods; only callers of getters and of methods with an effect are read again."""
    from holdfast.plans import held, naming

    p = Program()
    p.cls("t.A")
    p.method("get:()Ljava/lang/Object;", ["iget 0 3 t.A.m", "return 0"], lines=1)
    p.method("via:()V", ["virtual 3 t.A.get:()Ljava/lang/Object;", "move_result 0", "enter 0", "exit 0", "return"], lines=2)
    for j in range(6):
        p.method(f"plain{j}:()V", ["iget 0 3 t.A.n", "enter 0", "exit 0", "return"], lines=10 + j)
    classes, methods, _ = p.tables(spark)
    read = []
    for module in (held, naming):
        monkeypatch.setattr(module, "mapped", lambda rows, make, ddl, kept=module.mapped: read.append(rows.count()) or kept(rows, make, ddl))
    index = build(classes, methods)
    assert sum(read) == 8 + 1
    assert {(r.lock, r.enter) for r in index.spans.collect()} == {("t.A.m", 2)} | {("t.A.n", 10 + j) for j in range(6)}


def test_facts_of_repeated_keys_are_those_of_the_first(spark):
    """A key that comes twice: the first has no facts, the second locks; names and getters go by the first and the last as before."""
    p = Program()
    p.cls("t.A")
    p.method("twice:()V", ["return"], lines=1)
    p.method("twice:()V", ["iget 0 3 t.A.m", "enter 0", "exit 0", "return"], lines=2)
    p.method("once:()V", ["iget 0 3 t.A.m", "enter 0", "exit 0", "return"], lines=3)
    _, methods, _ = p.tables(spark)
    assert [(r.method, r.line) for r in lock_points(methods).collect()] == [("t.A.once:()V", 3)]


def test_first_lines():
    from holdfast.plans.methods import first_lines

    events = [
        ("acquire", None, "a", None, ["e"], None), ("field", 1, "f", None, ["x"], None), ("release", 4, "b", 3, [], None), ("release", 4, "y", None, [], None),
        ("call", 5, "k", None, ["a", "c"], None), ("acquire", 6, "c", None, ["a", "b"], None),
    ]
    assert first_lines(events) == {"a": 0, "e": 0, "b": 3, "c": 5}


def test_what_was_walked_stays_where_it_is(spark, monkeypatch):
    """Of events and facts only those of methods that are walked again are written again, and an index writes no accesses of fields."""
    from holdfast.plans import held, naming

    p, lock = Program(), "java.util.concurrent.locks.ReentrantLock"
    p.cls("t.A")
    p.method("take:()V", ["iget 0 3 t.A.mL", f"virtual 0 {lock}.lock:()V", "return"], lines=1)
    p.method("span:()V", ["direct 3 t.A.take:()V", "iget 1 3 t.A.mX", "return"], lines={0: 2, 1: 3})
    p.method("get:()Ljava/lang/Object;", ["iget 0 3 t.A.m", "return 0"], lines=4)
    p.method("via:()V", ["virtual 3 t.A.get:()Ljava/lang/Object;", "move_result 0", "enter 0", "exit 0", "return"], lines=5)
    for j in range(6):
        p.method(f"plain{j}:()V", ["iget 0 3 t.A.n", "enter 0", "exit 0", "return"], lines=10 + j)
    classes, methods, _ = p.tables(spark)
    keys = {r.method_id: r.key for r in methods.collect()}
    tables = []
    for module in (held, naming):
        monkeypatch.setattr(module, "written", lambda df, name, kept=module.written: tables.append((name, kept(df, name))) or tables[-1][1])
    index = build(classes, methods)
    told = {name: {keys[r.method_id] for r in t.select("method_id").collect()} for name, t in tables if name.startswith(("events", "facts", "summaries"))}
    assert set().union(*told.values()) <= {"t.A.span:()V", "t.A.via:()V"}
    assert not [r for name, t in tables if name == "survey" for r in t.where("kind = 'field'").collect()]
    assert {(r.lock, r.enter) for r in index.spans.collect()} == {("t.A.mL", 1), ("t.A.mL", 2), ("t.A.m", 5)} | {("t.A.n", 10 + j) for j in range(6)}


def test_methods_are_taken_apart_piece_by_piece():
    """Pieces of a batch, of which some have no lists at all, give what the whole gives."""
    import pyarrow as pa

    from holdfast.plans.methods import methods_in

    insns = [[{"offset": k, "args": [k, k + 1] if k % 2 else None} for k in range(n)] for n in (2, 0, 3, 0, 0, 1)] + [None]
    batch = pa.RecordBatch.from_pylist([{"method_id": j, "insns": i, "positions": [{"offset": j}], "catches": []} for j, i in enumerate(insns)])
    want = [{"method_id": j, "insns": [{"offset": i["offset"], "args": i["args"] or []} for i in own or []], "positions": [{"offset": j}], "catches": []} for j, own in enumerate(insns)]
    for size in (1, 2, 3, 100):
        assert list(methods_in(iter([batch, batch.slice(1, 3)]), size)) == want + want[1:4]


def test_all_overrides_are_linked(spark, tmp_path):
    """However many classes override what is called: links, locks on entry, ways, callbacks and questions know them all."""
    from holdfast.plans.report import entry_paths, points

    n = 40
    classes, methods, _ = programs.loft(n).tables(spark)
    index = build(classes, methods)
    short = {r.method_id: r.key.split("loft.")[1].split(":")[0] for r in index.methods.collect()}
    calls = {r.call_id: short[r.caller] for r in index.calls.collect()}
    links = [(calls[r.call_id], short[r.target], r.how) for r in index.targets.collect()]
    beats, carries = [f"Wing{k}.beat" for k in range(n)], [f"Wing{k}.carry" for k in range(n)]
    want = [(c, "Wing.beat", "class") for c in ("Loft.fly", "Loft.run")] + [("Loft.drop", "Wing.carry", "class")]
    want += [(c, b, "override") for c in ("Loft.fly", "Loft.run") for b in beats] + [("Loft.drop", c, "override") for c in carries]
    # A bell that is handed to any wing is rung by each of them.
    want += [(c, "Bell.ring", "class") for c in carries] + [(c, "Chime.ring", "formal") for c in carries]
    assert sorted(links) == sorted(want)
    assert sorted((short[r.src], short[r.dst]) for r in index.call_edges().collect()) == sorted((a, b) for a, b, _ in want)
    held = {(short[r.method_id], r.dist, short[r.pred]) for r in index.may_held.collect()}
    first = {("Wing.beat", 1, "Loft.fly"), ("Wing.carry", 1, "Loft.drop")} | {(b, 1, "Loft.fly") for b in beats} | {(c, 1, "Loft.drop") for c in carries}
    assert held - first == {(f"{bell}.ring", 2, "Wing0.carry") for bell in ("Bell", "Chime")} and first <= held
    got = index.link_statistics().first()
    assert (got.calls, got.linked, got.callbacks, got.unlinked, got.external) == (n + 3, n + 3, n, 0, 0)
    index.write(str(tmp_path))
    laid = Index.read(spark, str(tmp_path))
    assert sorted(short[r.caller] for r in laid.callers_of("Wing39.beat").collect()) == ["Loft.fly", "Loft.run"]
    assert [[short_key.split("loft.")[1] for short_key in r.path] for r in entry_paths(laid, points(laid, "method", "Wing39.carry"), 4).collect()] == [["Loft.drop:()V", "Wing39.carry:(Lloft/Bell;)V"]]


def test_calls_of_many_overrides_stay_few_rows(spark, monkeypatch):
    """No table of an index has a row for each call and override."""
    from holdfast.plans import index as made

    n, sizes = 30, {}
    classes, methods, _ = programs.loft(n, callers=n).tables(spark)
    monkeypatch.setattr(made, "written", lambda df, name, kept=made.written: (lambda t: sizes.__setitem__(name, max(sizes.get(name, 0), t.count())) or t)(kept(df, name)))
    index = build(classes, methods)
    assert index.targets.where("how = 'override'").count() == n * (n + 3)
    assert max(sizes.values()) < n * n


def test_races_through_any_of_many_overrides(spark):
    """A thread that calls a method with forty overrides reaches each of them, and so does an accessor's caller."""
    n = 40
    rows = races(*programs.loft(n).tables(spark), min_guarded=3, min_ratio=0.5).collect()
    # Each wing's speed is guarded in three glides; `beat` holds the door by way of fly, so what it writes isn't open.
    assert rows == []
    rows = races(*programs.loft(n, under=False).tables(spark), min_guarded=3, min_ratio=0.5).collect()
    assert sorted((r.field, r.guard, r.guarded, r.total) for r in rows) == sorted((f"loft.Wing.speed{k}", "loft.Loft.door", 3, 4) for k in range(n))
    assert all([(u.line, u.concurrent) for u in r.unguarded] == [(10, True)] for r in rows)


def test_accessors_behind_many_overrides(spark):
    """An override without lines is an accessor: what it does counts for all that call it."""
    rows = races(*programs.loft(20, under=False, lines=0).tables(spark), min_guarded=3, min_ratio=0.5).collect()
    assert sorted((r.field, r.guarded, r.total, [(u.method, u.line, u.concurrent) for u in r.unguarded]) for r in rows) == sorted(
        (f"loft.Wing.speed{k}", 3, 4, [("loft.Loft.run:()V", 22, True)]) for k in range(20)
    )
