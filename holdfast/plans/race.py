"""Fields with an inconsistent locking discipline."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.names import OPAQUE, STATIC
from ..operators import graphs, relational
from ..sources.facts import ancestors
from ..storage import written
from .held import INTERFACE, entry_locks, surveyed, with_entries
from .index import Index, build
from .naming import at_hand

# Entry points of threads, and the class that makes them ones.
THREADS = (("run:()V", "java.lang.Runnable"), ("run:()V", "java.lang.Thread"), ("handleMessage:(Landroid/os/Message;)V", "android.os.Handler"))


def concurrent_methods(above: DataFrame, methods: DataFrame, index: Index) -> DataFrame:
    """method_id of all methods that a thread's entry point or a served remote call can reach; `above` are the ancestors of all classes."""
    sig = F.concat("name", F.lit(":"), "sig")
    own = methods.where((F.col("access").bitwiseAND(STATIC) == 0) & ~F.startswith("name", F.lit("<"))).select("method_id", F.col("class").alias("child"), sig.alias("sig"))
    mine = own.join(above.where("steps > 0"), "child")
    remote = above.where(F.col("ancestor") == INTERFACE).select(F.col("child").alias("ancestor")).distinct()
    served = methods.select(F.col("class").alias("ancestor"), sig.alias("sig")).join(remote, "ancestor", "left_semi").distinct()
    roots = mine.join(served, ["ancestor", "sig"], "left_semi").select("method_id")
    for s, cls in THREADS:
        roots = roots.union(mine.where((F.col("sig") == s) & (F.col("ancestor") == cls)).select("method_id"))
    # Read in each round of the search.
    found = graphs.reachable(written(index.ways(), "edges"), roots.select(F.col("method_id").alias("node")))
    # Hubs of overrides are below zero.
    return found.where("node >= 0").withColumnRenamed("node", "method_id")


def field_accesses(methods: DataFrame, index: Index, known: DataFrame, events: DataFrame) -> DataFrame:
    """field, method_id, line, write, held, unlocked; an accessor's accesses are those of its callers.

    `known` are the methods' effects and `events` what they do with nothing held on entry.
    """
    entry = entry_locks(methods, known, events=events)
    events = with_entries(methods, known, events, entry).where("kind = 'field'")
    events = events.join(methods.where(F.startswith("name", F.lit("<"))).select("method_id"), "method_id", "left_anti")
    held = F.filter("held", lambda n: ~F.startswith(n, F.lit(OPAQUE)))
    rows = written(events.select("method_id", F.col("name").alias("field"), "line", "write", held.alias("held")), "field-events")
    touches = lambda *ops: F.exists("insns", lambda i: i["op"].isin(*ops))
    accessors = methods.join(rows.select("method_id").distinct(), "method_id", "left_semi").where(
        F.forall("positions", lambda p: p["line"] == 0) & touches("iget", "iput", "sget", "sput") & ~touches("invoke", "monitor_enter", "monitor_exit")
    ).select("method_id")
    accessors = written(accessors, "accessors")
    locked = index.may_held.select("method_id").distinct().withColumn("_may", F.lit(True))
    calls = index.call_edges(accessors).select(F.col("dst").alias("accessor"), F.col("src").alias("method_id"), "line", "held")
    through = rows.join(accessors, "method_id", "left_semi").select(F.col("method_id").alias("accessor"), "field", "write").join(calls, "accessor")
    both = rows.join(accessors, "method_id", "left_anti").unionByName(through.select("method_id", "field", "line", "write", "held"))
    return both.join(locked, "method_id", "left").withColumn("unlocked", F.col("_may").isNull() & (F.size("held") == 0)).drop("_may")


def evidence(rows: DataFrame, shown: dict[str, int | None]) -> DataFrame:
    """field, guarded_at and unguarded: the first accesses of each side (guarded, open) by method, line and write.

    `shown` bounds a side (None: all). Which accesses are listed is settled by rank before anything is collected, and each task
    keeps only so many of a field before it sends them on, so a field that is used everywhere stays small.
    """
    first = Window.partitionBy("field", "side").orderBy("access.method", "access.line", "access.write", "access")
    parts = []
    for side, most in shown.items():
        own = rows.where(F.col("side") == side).select("field", "side", "access")
        parts.append(own if most is None else own.withColumn("_n", F.row_number().over(first)).where(F.col("_n") <= most).drop("_n"))
    named = [F.array_sort(F.collect_list(F.when(F.col("side") == s, F.col("access")))).alias(name) for s, name in (("guarded", "guarded_at"), ("open", "unguarded"))]
    return parts[0].unionByName(parts[1]).groupBy("field").agg(*named)


def races(classes: DataFrame, methods: DataFrame, flags: DataFrame, min_guarded: int = 3, min_ratio: float = 0.8, index: Index | None = None, shown: int | None = None, shown_open: int | None = None, **options) -> DataFrame:
    """field, guard, guarded, total, n_unguarded, guarded_at, unguarded; strongest evidence first.

    With `shown`, so many accesses at most are listed where the guard is held, with `shown_open` where it isn't; else all are.
    The counts are always of all accesses.
    """
    methods = at_hand(methods)
    known, events, facts = surveyed(methods)
    above = written(ancestors(classes), "ancestors")
    index = index or build(classes, methods, survey=(events, facts), above=above, **options)
    at = field_accesses(methods, index, known, events).join(flags, "field", "left_anti")
    threads = concurrent_methods(above, methods, index).withColumn("concurrent", F.lit(True))
    at = at.join(threads, "method_id", "left").join(index.methods.select("method_id", "key", "file"), "method_id")
    access = F.struct(F.col("key").alias("method"), F.when(F.col("file") != "", F.col("file")).alias("file"), "line", "write", "held", F.coalesce("concurrent", F.lit(False)).alias("concurrent"))
    at = written(at.select("field", "held", "write", "unlocked", access.alias("access")), "accesses")
    votes = at.select("field", F.explode("held").alias("guard"))
    guards = relational.elect(votes, ["field"], "guard", min_guarded, 0.0).select("field", "guard", F.col("votes").alias("guarded"))
    open_ = F.col("write") & F.col("unlocked")
    side = F.when(F.array_contains("held", F.col("guard")), "guarded").when(open_, "open")
    rows = at.join(guards, "field").withColumn("side", side)
    found = rows.groupBy("field", "guard", "guarded").agg(
        F.count("*").alias("total"), F.count_if(F.col("side") == "open").alias("n_unguarded"),
        F.coalesce(F.bool_or(F.when(F.col("side") == "open", F.col("access.concurrent"))), F.lit(False)).alias("threaded"),
    )
    found = written(found.where((F.col("guarded") >= min_ratio * F.col("total")) & (F.col("n_unguarded") > 0)), "races")
    listed = rows.where("side is not null").join(found.select("field"), "field", "left_semi")
    listed = evidence(listed, {"guarded": shown, "open": shown_open})
    rows = found.join(listed, "field").orderBy(F.desc("threaded"), F.desc("guarded"), "n_unguarded", "field")
    return rows.select("field", "guard", "guarded", "total", "n_unguarded", "guarded_at", "unguarded")
