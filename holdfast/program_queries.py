"""The lock analyses over a program with a depot for each supplier, and their answers in SQL.

Depot k of nation n takes its locks mA, mB and mL in the ways that each of the analyses is about; which ways it has
depends on its number, its nation and its balance. Helpers, base classes and remote ports belong to nations: each of a
nation's depots brings a copy of them, and the first counts.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .queries import query, table
from .sources.sketches import Program
from .storage import is_written, written

#: What depots of nation n pass to their helper: one key for all of them, or one by number in every third nation.
KEYS = "CASE WHEN s_nationkey % 3 = 0 THEN s_suppkey % 2 ELSE s_nationkey + 10 END"
DEPOTS = f"""WITH d AS (SELECT s_suppkey AS k, s_nationkey AS n, {KEYS} AS x, s_acctbal > 5000 AS rich, 'w.D' || s_suppkey AS c FROM supplier),
    own AS (SELECT n, min(k) AS k, count(*) AS depots, count(DISTINCT x) AS keys, min(x) AS x FROM d GROUP BY n)"""


def sketch() -> Program:
    p, d, h = Program(), "w.D{k}", "w.Helper{n}"
    static, private, abstract = 0x8, 0x2, 0x400
    p.cls("android.os.IInterface")
    p.cls("w.IPort{n}", interfaces=("android.os.IInterface",))
    p.method("ping:()V", access=abstract)
    p.cls("w.Act")
    p.method("go:()V", access=abstract)
    p.cls("w.Base{n}")
    p.method("spin{n}:()V", ["return"], lines=3)
    p.cls(h)
    p.method("<init>:(Ljava/lang/Object;)V", [f"iput 3 2 {h}.mLock", "return"], ins=2, lines=4)
    p.method("work:()V", [f"iget 0 3 {h}.mLock", "enter 0", "exit 0", "return"], lines=5)
    p.cls("w.L{k}", interfaces=("w.Act",))
    p.method("go:()V", ["return"], lines=6)
    p.cls(d, super_="w.Base{n}", interfaces=("java.lang.Runnable",))
    a, b = [f"iget 0 3 {d}.mA", "enter 0"], [f"iget 1 3 {d}.mB", "enter 1"]
    ping = [f"iget 2 3 {d}.mPort w.IPort{{n}}", "interface 2 w.IPort{n}.ping:()V"]
    # Names: a formal bound by all makers of a helper, a getter's result, a locked parameter.
    p.method("make:()V", ["sget 0 w.Keys.key{x}", f"new 1 {h}", f"direct 1,0 {h}.<init>:(Ljava/lang/Object;)V", "return"], lines=10)
    p.method("getLock:()Ljava/lang/Object;", [f"iget 0 3 {d}.mA", "return 0"], lines=11)
    p.method("viaGetter:()V", [f"virtual 3 {d}.getLock:()Ljava/lang/Object;", "move_result 0", "enter 0", "exit 0", "return"], lines=12)
    p.method("typed:(Lw/Helper{n};)V", ["enter 3", "exit 3", "return"], ins=2, lines=13)
    p.method("callTyped:()V", ["sget 0 w.Keys.typed{n}", f"virtual 3,0 {d}.typed:(Lw/Helper{{n}};)V", "return"], lines=14, only="k % 2 = 0")
    # Remote calls: under a lock, in a private helper that is called with locks, between helpers that take and give back.
    p.method("near:()V", [*a, *ping, "exit 0", "return"], lines=15)
    call = f"direct 3 {d}.helper:()V"
    p.method("outer:()V", [*a, *b, call, "exit 1", "exit 0", "return"], lines=20, only="k % 4 = 0")
    p.method("outer:()V", [*a, call, "exit 0", "return"], lines=20, only="k % 4 <> 0")
    p.method("again:()V", [*a, *b, call, "exit 1", "exit 0", "return"], lines=21, only="k % 2 = 0")
    p.method("again:()V", [call, "return"], lines=21, only="k % 2 <> 0")
    p.method("helper:()V", [*ping, "return"], access=private, lines=25)
    lock = "java.util.concurrent.locks.ReentrantLock"
    p.method("span:()V", [f"direct 3 {d}.take:()V", *ping, f"direct 3 {d}.drop:()V", *ping, "return"], lines={0: 30, 1: 31, 3: 32, 4: 33})
    p.method("take:()V", [f"iget 0 3 {d}.mL", f"virtual 0 {lock}.lock:()V", "return"], access=private, lines=40, only="k % 3 <> 0")
    p.method("take:()V", ["branch 3", f"iget 0 3 {d}.mL", f"virtual 0 {lock}.lock:()V", "return"], access=private, lines=40, only="k % 3 = 0")
    p.method("drop:()V", [f"iget 0 3 {d}.mL", f"virtual 0 {lock}.unlock:()V", "return"], access=private, lines=41)
    p.method("swapped:()V", [*b, *a, "exit 0", "exit 1", "return"], lines=22, only="k % 3 = 1")
    # Links: overrides, a known receiver, a class outside, a missing method, a callback.
    p.method("spin{n}:()V", ["return"], lines=60)
    p.method("turn:()V", [f"iget 0 3 {d}.mBase", "virtual 0 w.Base{n}.spin{n}:()V", "return"], lines=61)
    p.method("known:()V", [f"new 0 {d}", "virtual 0 w.Base{n}.spin{n}:()V", "return"], lines=62, only="rich")
    p.method("out:()V", ["virtual 3 java.lang.Object.notify:()V", "return"], lines=63, only="n % 2 = 0")
    p.method("lost:()V", [f"static {d}.missing:()V", "return"], access=static, ins=0, lines=64, only="k % 3 = 1")
    p.method("each:(Lw/Act;)V", ["interface 3 w.Act.go:()V", "return"], ins=2, lines=65)
    p.method("runs:()V", ["new 1 w.L{k}", f"virtual 3,1 {d}.each:(Lw/Act;)V", "return"], lines=66, only="k % 5 <> 3")
    # A field that three to five methods guard and the thread doesn't.
    for j in range(5):
        p.method(f"guarded{j}:()V", [*a, f"iput 1 3 {d}.mCount" if j % 2 else f"iget 1 3 {d}.mCount", "exit 0", "return"], lines=50 + j, only=f"k % 3 >= {j - 2}")
    p.method("run:()V", [f"iput 1 3 {d}.mCount", "return"], lines=59)
    p.flags.append(f"{d}.mCount")
    return p


def depots(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    rows = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("k"), F.col("s_nationkey").alias("n"), F.expr(KEYS).alias("x"), F.expr("s_acctbal > 5000").alias("rich"))
    return tuple(t if is_written(t) else written(t, "depots") for t in sketch().spread(rows, "k", "k % 5 = 0"))


POINTS = """sites(method, line, lock, has) AS (
        SELECT c || '.viaGetter:()V', 12, c || '.mA', true FROM d
        UNION ALL SELECT c || '.typed:(Lw/Helper' || n || ';)V', 13, CASE WHEN k % 2 = 0 THEN 'w.Keys.typed' || n ELSE 'w.Helper' || n END, true FROM d
        UNION ALL SELECT c || '.near:()V', 15, c || '.mA', true FROM d
        UNION ALL SELECT c || '.outer:()V', 20, c || '.mA', true FROM d UNION ALL SELECT c || '.outer:()V', 20, c || '.mB', k % 4 = 0 FROM d
        UNION ALL SELECT c || '.again:()V', 21, c || '.mA', k % 2 = 0 FROM d UNION ALL SELECT c || '.again:()V', 21, c || '.mB', k % 2 = 0 FROM d
        UNION ALL SELECT c || '.take:()V', 40, c || '.mL', true FROM d
        UNION ALL SELECT c || '.swapped:()V', 22, c || '.mA', k % 3 = 1 FROM d UNION ALL SELECT c || '.swapped:()V', 22, c || '.mB', k % 3 = 1 FROM d
        UNION ALL SELECT c || '.guarded' || j || ':()V', CAST(50 + j AS INTEGER), c || '.mA', k % 3 >= j - 2 FROM d, range(5) t(j)
        UNION ALL SELECT 'w.Helper' || n || '.work:()V', 5, CASE WHEN keys = 1 THEN 'w.Keys.key' || x ELSE 'w.Helper' || n || '.mLock' END, true FROM own)"""


@query(f"{DEPOTS}, {POINTS} SELECT split_part(method, ':', 1) AS method, line, lock FROM sites WHERE has")
def lock_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sites by canonical names: bound formals, aliases of fields, getters, declared types of parameters."""
    from .plans.naming import lock_points

    return lock_points(depots(spark, sf_dir)[1]).select(F.substring_index("method", ":", 1).alias("method"), "line", "lock")


@query(f"""{DEPOTS} SELECT c || '.take:()V' AS key, c || '.mL' AS takes, '' AS gives FROM d WHERE k % 3 <> 0
    UNION ALL SELECT c || '.drop:()V', '', c || '.mL' FROM d UNION ALL SELECT c || '.span:()V', '', c || '.mL' FROM d WHERE k % 3 = 0""")
def helper_effects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Locks that methods leave held or give back for their callers; a lock taken on one way only isn't left held."""
    from .plans.held import effects

    return effects(depots(spark, sf_dir)[1]).select("key", *[F.array_join(c, ", ").alias(c) for c in ("takes", "gives")])


@query(f"""{DEPOTS} SELECT c || '.helper:()V' AS key, CASE WHEN k % 4 = 0 THEN c || '.mA, ' || c || '.mB' ELSE c || '.mA' END AS entry FROM d WHERE k % 2 = 0
    UNION ALL SELECT c || '.drop:()V', c || '.mL' FROM d WHERE k % 3 <> 0""")
def entry_locks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Locks held at every call of a private method."""
    from .plans import held

    methods = depots(spark, sf_dir)[1]
    known, events = held.effects_and_events(methods)
    return held.entry_locks(methods, known, events=events).select("key", F.array_join("entry", ", ").alias("entry"))


@query(f"""{DEPOTS} SELECT c || '.near:()V' AS method, 'D' || k || '.java' AS file, 15 AS line, c || '.mA' AS held, 'w.IPort' || n || '.ping' AS callee FROM d
    UNION ALL SELECT c || '.helper:()V', 'D' || k || '.java', 25, CASE WHEN k % 4 = 0 THEN c || '.mA, ' || c || '.mB' ELSE c || '.mA' END, 'w.IPort' || n || '.ping' FROM d WHERE k % 2 = 0
    UNION ALL SELECT c || '.span:()V', 'D' || k || '.java', 31, c || '.mL', 'w.IPort' || n || '.ping' FROM d WHERE k % 3 <> 0""")
def remote_under_lock(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Calls of remote interfaces with a lock held, within the method or at every call of it."""
    from .plans.held import calls_under_lock

    classes, methods, _ = depots(spark, sf_dir)
    return calls_under_lock(classes, methods).withColumn("held", F.array_join("held", ", "))


@query(f"""{DEPOTS}, g AS (SELECT *, 3 + k % 3 AS guarded FROM d WHERE k % 5 <> 0)
    SELECT c || '.mCount' AS field, c || '.mA' AS guard, guarded, guarded + 1 AS total, 1 AS n_unguarded, c || '.run:()V D' || k || '.java 59 true [] true' AS unguarded,
        (SELECT string_agg(c || '.guarded' || j || ':()V D' || k || '.java ' || (50 + j) || ' ' || (j % 2 = 1) || ' [' || c || '.mA] false', '; ' ORDER BY j) FROM range(guarded) t(j)) AS guarded_at
    FROM g WHERE guarded >= 4""")
def race_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fields that most accesses guard and a thread writes without the guard; volatile ones don't count."""
    from .plans.race import races

    held = lambda a: F.concat(F.lit("["), F.array_join(a["held"], ", "), F.lit("]"))
    shown = lambda a: F.concat_ws(" ", a["method"], a["file"], a["line"], a["write"], held(a), a["concurrent"])
    listed = [F.array_join(F.transform(c, shown), "; ").alias(c) for c in ("unguarded", "guarded_at")]
    return races(*depots(spark, sf_dir)).select("field", "guard", "guarded", "total", "n_unguarded", *listed)


@query(f"""{DEPOTS}, {POINTS}, answers(question, subject, answer, number) AS (
        SELECT 'target', c || '.turn', 'w.Base' || n || '.spin' || n || ' class', NULL FROM d
        UNION ALL SELECT 'target', a.c || '.turn', b.c || '.spin' || a.n || ' override', NULL FROM d a JOIN d b USING (n)
        UNION ALL SELECT 'target', c || '.known', c || '.spin' || n || ' receiver', NULL FROM d WHERE rich
        UNION ALL SELECT 'target', c || '.each', 'w.Act.go class', NULL FROM d
        UNION ALL SELECT 'target', c || '.each', 'w.L' || k || '.go formal', NULL FROM d WHERE k % 5 <> 3
        UNION ALL SELECT 'target', c || '.make', 'w.Helper' || n || '.<init> class', NULL FROM d
        UNION ALL SELECT 'target', c || '.viaGetter', c || '.getLock class', NULL FROM d
        UNION ALL SELECT 'target', c || '.callTyped', c || '.typed class', NULL FROM d WHERE k % 2 = 0
        UNION ALL SELECT 'target', c || m, 'w.IPort' || n || '.ping class', NULL FROM d, (VALUES ('.near'), ('.helper'), ('.span'), ('.span')) t(m)
        UNION ALL SELECT 'target', c || m, c || '.helper class', NULL FROM d, (VALUES ('.outer'), ('.again')) t(m)
        UNION ALL SELECT 'target', c || '.span', c || m || ' class', NULL FROM d, (VALUES ('.take'), ('.drop')) t(m)
        UNION ALL SELECT 'target', c || '.runs', c || '.each class', NULL FROM d WHERE k % 5 <> 3
        UNION ALL SELECT 'remote', c || '.near', c || '.mA', 0 FROM d
        UNION ALL SELECT 'remote', c || '.helper', c || '.mA', 1 FROM d UNION ALL SELECT 'remote', c || '.helper', c || '.mB', 1 FROM d WHERE k % 2 = 0
        UNION ALL SELECT 'remote', c || '.span', c || '.mL', 0 FROM d WHERE k % 3 <> 0
        UNION ALL SELECT 'span', split_part(method, ':', 1), lock || ' under ' || CASE
                WHEN method LIKE '%.swapped:%' THEN CASE WHEN lock LIKE '%.mA' THEN replace(lock, '.mA', '.mB') ELSE '' END
                WHEN lock LIKE '%.mB' THEN replace(lock, '.mB', '.mA') ELSE '' END || ' from ' || line,
            CASE WHEN method LIKE '%.take:%' THEN 4294967295 ELSE line + 1 END FROM sites WHERE has
        UNION ALL SELECT 'span', c || '.span', c || '.mL under  from 30', 32 FROM d WHERE k % 3 <> 0
        UNION ALL SELECT 'order', c || '.mA', c || '.mB', CASE WHEN k % 4 = 0 THEN 2 ELSE 1 END FROM d WHERE k % 2 = 0
        UNION ALL SELECT 'order', c || '.mB', c || '.mA', 1 FROM d WHERE k % 3 = 1
        UNION ALL SELECT 'inversion', c || '.mA', c || '.mB', NULL FROM d WHERE k % 2 = 0 AND k % 3 = 1
        UNION ALL SELECT 'cycle', c || '.mA', c || '.mA, ' || c || '.mB', NULL FROM d WHERE k % 2 = 0 AND k % 3 = 1
        UNION ALL SELECT 'witness', c || '.mA', c || '.near > w.IPort' || n || '.ping', 1 FROM d
        UNION ALL SELECT 'witness', c || '.mA', c || '.outer > ' || c || '.helper', 1 FROM d
        UNION ALL SELECT 'witness', c || '.mB', c || CASE WHEN k % 4 = 0 THEN '.outer' ELSE '.again' END || ' > ' || c || '.helper', 1 FROM d WHERE k % 2 = 0
        UNION ALL SELECT 'witness', c || '.mL', c || '.span > ' || t, 1 FROM (SELECT c, k, unnest(['w.IPort' || n || '.ping', c || '.drop']) AS t FROM d) WHERE k % 3 <> 0
        UNION ALL SELECT 'witness', c || '.mB', c || '.outer > ' || c || '.helper > w.IPort' || n || '.ping', 2 FROM d WHERE k % 4 = 0
        UNION ALL SELECT 'witness', c || '.mB', c || '.again > ' || c || '.helper > w.IPort' || n || '.ping', 2 FROM d WHERE k % 4 = 2
        UNION ALL SELECT 'links', 'calls', NULL, count(*) * 12 + count_if(k % 2 = 0) + count_if(rich) + count_if(n % 2 = 0) + count_if(k % 3 = 1) + count_if(k % 5 <> 3) FROM d
        UNION ALL SELECT 'links', 'linked', NULL, count(*) * 12 + count_if(k % 2 = 0) + count_if(rich) + count_if(k % 5 <> 3) FROM d
        UNION ALL SELECT 'links', 'devirtualized', NULL, count_if(rich) FROM d UNION ALL SELECT 'links', 'callbacks', NULL, count_if(k % 5 <> 3) FROM d
        UNION ALL SELECT 'links', 'external', NULL, count_if(n % 2 = 0) FROM d UNION ALL SELECT 'links', 'unlinked', NULL, count_if(k % 3 = 1) FROM d)
    SELECT question, subject, answer, CAST(number AS BIGINT) AS number FROM answers""")
def index_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What one index answers, in full: targets of all calls, remote calls under locks, spans, lock orders, inversions with
    their gates, cycles, a witness for each lock that may be held in each method, and link statistics."""
    from .operators.relational import paired
    from .plans.index import build

    classes, methods, _ = depots(spark, sf_dir)
    index = build(classes, methods)
    name = index.methods.select("method_id", F.substring_index("key", ":", 1).alias("name"))
    named = lambda id_, to: name.select(F.col("method_id").alias(id_), F.col("name").alias(to))
    row = lambda rows, question, subject, answer, number=None: rows.select(F.lit(question).alias("question"), subject.alias("subject"), answer.alias("answer"), (F.lit(None) if number is None else number).cast("long").alias("number"))
    # Names are found for calls and for overrides, not for their pairs.
    callers = index.calls.select("call_id", "caller").join(named("caller", "from"), "caller").select("call_id", "from")
    edges = index.direct.join(callers, "call_id").join(named("target", "to"), "target").select("from", "to", "how")
    over = paired(index.open_calls.join(callers, "call_id").select("hub", "from"), index.overrides.join(named("target", "to"), "target").select("hub", "to"), "hub")
    edges = edges.unionByName(over.select("from", "to", F.lit("override").alias("how")))
    spans = index.spans.join(named("method_id", "name"), "method_id")
    paths = index.witness(8).select("method_id", "lock", "dist", F.posexplode("path").alias("i", "m"))
    paths = paths.join(named("m", "name"), "m").groupBy("method_id", "lock", "dist").agg(F.array_sort(F.collect_list(F.struct("i", "name"))).alias("path"))
    links = index.link_statistics()
    links = links.select(F.explode(F.array(*[F.struct(F.lit(c).alias("what"), F.col(c).alias("n")) for c in links.columns])).alias("l"))
    nothing, col = F.lit(None).cast("string"), F.col
    parts = [
        row(edges, "target", col("from"), F.concat_ws(" ", "to", "how")),
        row(index.remote_calls().join(named("caller", "name"), "caller"), "remote", col("name"), col("lock"), col("dist")),
        row(spans, "span", col("name"), F.concat(col("lock"), F.lit(" under "), F.array_join("held", ", "), F.lit(" from "), col("enter")), col("exit")),
        row(index.orders, "order", col("from"), col("to"), col("count")),
        row(index.inversions(), "inversion", col("from"), F.concat_ws(" gated by ", "to", "gate")),
        row(index.cycles(), "cycle", F.element_at("locks", 1), F.array_join("locks", ", ")),
        row(paths, "witness", col("lock"), F.array_join(F.transform("path", lambda s: s["name"]), " > "), col("dist")),
        row(links, "links", col("l.what"), nothing, col("l.n")),
    ]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out
