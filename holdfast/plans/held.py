"""Held locks between methods: net effects of helpers, locks held on entry, remote calls under a lock."""

from __future__ import annotations

from functools import partial

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.names import OPAQUE, PRIVATE, flag
from ..sources.facts import ancestors
from ..storage import without, written
from .methods import EVENTS, LOCK_CALLS, SUMMARY, SURVEY, WALK, effect_rows, event_rows, survey_rows, walk_rows
from .naming import arrow_schema, at_hand, called_keys, mapped, with_callees

#: Rounds of the fixpoints at most.
ROUNDS = 16
# The remote-call interface, its transaction classes, and its plumbing.
INTERFACE = "android.os.IInterface"
TRANSACTION = ("android.os.IBinder", "android.os.BinderProxy")
PLUMBING = ("asBinder", "getInterfaceDescriptor")


def effects(methods: DataFrame, own_effects: DataFrame | None = None, calls: DataFrame | None = None) -> DataFrame:
    """key, takes, gives: locks that a method leaves held, or releases for its caller.

    All methods that take or release a lock themselves are walked once: nothing else has an effect of its own. After
    that each round walks the callers of keys whose effects have changed, and no others. `own_effects` (method_id, key, takes,
    gives; written) are those of the first walk and `calls` (method_id, key) those that it went through, where it is done already.
    """
    schema = "method_id long, key string, takes array<string>, gives array<string>"
    of_key = lambda rows: rows.groupBy("key").agg(F.max_by(F.struct("takes", "gives"), "method_id").alias("e")).select("key", "e.takes", "e.gives")
    none = methods.sparkSession.createDataFrame([], "key string, takes array<string>, gives array<string>")
    own = lambda i: i["op"].startswith("monitor") | ((i["op"] == "invoke") & i["name"].isin(*LOCK_CALLS))
    rows = written(mapped(methods.where(F.exists("insns", own)), effect_rows, schema), "effects") if own_effects is None else own_effects
    now, changed = of_key(rows), rows.select("key").distinct()
    calls = called_keys(methods) if calls is None else calls
    for _ in range(ROUNDS - 1):
        again = written(calls.join(changed, "key", "left_semi").select("method_id").distinct(), "effects-again")
        if again.isEmpty():
            break
        new = mapped(with_callees(methods.join(again, "method_id", "left_semi"), now, "effects"), effect_rows, schema)
        rows = written(rows.join(again, "method_id", "left_anti").unionByName(new), "effects")
        after = of_key(rows)
        changed = written(after.exceptAll(now).unionByName(now.exceptAll(after)).select("key").distinct(), "effects-changed")
        now = after
    return written(now, "effects")


def walked(methods: DataFrame, known: DataFrame, entry: DataFrame | None = None) -> DataFrame:
    """All events of all methods, with `known` effects of callees and locks held on `entry` (key, entry)."""
    rows = methods.join(entry, "key", "left") if entry is not None else methods.withColumn("entry", F.array().cast("array<string>"))
    return mapped(with_callees(rows, known, "effects"), event_rows, EVENTS)


def effects_and_events(methods: DataFrame) -> tuple[DataFrame, DataFrame]:
    """`effects`, and all events with these, of written tables. All methods are walked once, for both; only those that call a method with
    an effect are walked again. `methods` are written already.
    """
    return after_walk(methods, written(mapped(methods, walk_rows, WALK), "walk"))


def surveyed(methods: DataFrame, fields: bool = True) -> tuple[DataFrame, DataFrame, DataFrame]:
    """`effects_and_events`, and what `summaries` starts from, all of the same walk: methods are read into Python once.

    Events of kind field, of which code has most, can be left out where nothing asks for `fields`.
    """
    walk = written(mapped(methods, partial(survey_rows, fields=fields), SURVEY), "survey")
    return *after_walk(methods, walk), walk.where("kind = 'summary'").select(*arrow_schema(SUMMARY).names)


def after_walk(methods: DataFrame, walk: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Effects and events of a walk (written) that knew no callee's effects."""
    calls = walk.where("kind = 'call'").select("method_id", F.col("name").alias("key"))
    known = effects(methods, walk.where("kind = 'effect'").select("method_id", "key", "takes", "gives"), calls)
    events = walk.where("kind not in ('effect', 'summary')").select(*arrow_schema(EVENTS).names)
    if known.isEmpty():
        return known, events
    callers = written(calls.join(known, "key", "left_semi").select("method_id").distinct(), "effects-callers")
    again = written(walked(methods.join(callers, "method_id", "left_semi"), known), "events-again")
    # Those of all other methods stay where the walk has put them.
    return known, without(events, callers, "method_id", "events-kept").unionByName(again)


def with_entries(methods: DataFrame, known: DataFrame, events: DataFrame, entry: DataFrame) -> DataFrame:
    """Events with locks on entry: of `events`, which know of none, only those of methods that have some are made again."""
    held = methods.join(entry, "key", "left_semi")
    return events.join(entry, "key", "left_anti").unionByName(walked(held, known, entry))


def entry_locks(methods: DataFrame, known: DataFrame, closed_world: bool = False, events: DataFrame | None = None) -> DataFrame:
    """key and entry: locks held at every call of a private method (with `closed_world`, of any method whose
    name and signature are declared once). Each round starts from the locks of the one before.

    `events` are those of all methods with nothing held on entry, the first round. After that a round walks only the methods whose
    entry has changed. For each key its call sites are counted, and for each lock the sites that hold it; what a
    method's sites held before and hold now adjusts these counts, and only keys with a changed count are looked at.
    """
    private = methods.where(flag(F.col("access"), PRIVATE)).select("key").distinct()
    sig = F.concat("name", F.lit(":"), "sig")
    once = methods.groupBy(sig.alias("_sig")).agg(F.count("*").alias("n"), F.max("key").alias("_key")).where("n = 1")
    asked = written(private.withColumn("_own", F.lit(True)), "entry-private")
    once = written(once.select("_sig", "_key"), "entry-once") if closed_world else None

    def sites_of(events: DataFrame) -> DataFrame:
        calls = events.where("kind = 'call'").select("method_id", "ord", F.col("name").alias("key"), "sig", "held")
        target = calls.join(asked, "key", "left")
        if once is not None:
            target = target.join(once, F.col("sig") == F.col("_sig"), "left")
            target = target.withColumn("key", F.when(F.col("_own"), F.col("key")).otherwise(F.col("_key")))
        else:
            target = target.where("_own")
        nameable = F.array_distinct(F.filter("held", lambda n: ~F.startswith(n, F.lit(OPAQUE))))
        return target.where("key is not null").select("key", "method_id", "ord", nameable.alias("held"))

    def counted(sites: DataFrame, sign: int) -> DataFrame:
        return sites.select("key", F.explode("held").alias("lock"), F.lit(sign).cast("long").alias("n"))

    def held_at_all(counts: DataFrame) -> DataFrame:
        full = counts.join(totals, "key").where("n = total")
        return full.groupBy("key").agg(F.array_sort(F.collect_list("lock")).alias("entry"))

    events = walked(methods, known) if events is None else events
    sites = written(sites_of(events), "entry-sites")
    totals = written(sites.groupBy("key").agg(F.count("*").alias("total")), "entry-totals")
    counts = written(counted(sites, 1).groupBy("key", "lock").agg(F.sum("n").alias("n")), "entry-counts")
    entry = written(held_at_all(counts), "entry")
    changed = entry.select("key")
    for _ in range(ROUNDS - 1):
        if changed.isEmpty():
            break
        again = methods.join(changed, "key", "left_semi")
        rest = entry.select(F.col("key").alias("_key"), "entry")
        ids = written(again.select("method_id"), "entry-again")
        new = written(sites_of(walked(again, known, rest.withColumnRenamed("_key", "key"))), "entry-sites-new")
        old = sites.join(ids, "method_id", "left_semi")
        delta = counted(new, 1).unionByName(counted(old, -1)).groupBy("key", "lock").agg(F.sum("n").alias("n")).where("n <> 0")
        delta = written(delta, "entry-delta")
        if delta.isEmpty():
            break
        sites = written(sites.join(ids, "method_id", "left_anti").unionByName(new), "entry-sites")
        counts = written(counts.unionByName(delta).groupBy("key", "lock").agg(F.sum("n").alias("n")).where("n > 0"), "entry-counts")
        touched = delta.select("key").distinct()
        fresh = touched.join(held_at_all(counts.join(touched, "key", "left_semi")), "key", "left")
        fresh = fresh.join(entry.withColumnRenamed("entry", "before"), "key", "left")
        fresh = written(fresh.where(~F.col("entry").eqNullSafe(F.col("before"))).select("key", "entry"), "entry-changed")
        entry = written(entry.join(fresh, "key", "left_anti").unionByName(fresh.where("entry is not null")), "entry")
        changed = fresh.select("key")
    return entry


def transaction(cls: Column, name: Column) -> Column:
    return cls.isin(*TRANSACTION) & F.startswith(name, F.lit("transact"))


def transacting(methods: DataFrame) -> DataFrame:
    """Keys of methods whose body performs a raw transaction: client proxies, found by what they do."""
    does = F.exists("insns", lambda i: (i["op"] == "invoke") & transaction(i["class"], i["name"]))
    return methods.where(does).select("key").distinct()


def remote_interfaces(above: DataFrame) -> DataFrame:
    """Classes at or below the remote-call interface, by the ancestors of all classes."""
    below = above.where(F.col("ancestor") == INTERFACE)
    return below.select(F.col("child").alias("class")).distinct()


def calls_under_lock(classes: DataFrame, methods: DataFrame, closed_world: bool = False) -> DataFrame:
    """method, file, line, held, callee: remote calls made with a nameable lock held."""
    methods = at_hand(methods)
    known, events = effects_and_events(methods)
    calls = with_entries(methods, known, events, entry_locks(methods, known, closed_world, events)).where("kind = 'call'")
    name = F.substring_index("sig", ":", 1)
    calls = calls.withColumn("held", F.filter("held", lambda n: ~F.startswith(n, F.lit(OPAQUE)))).where(F.size("held") > 0)
    calls = calls.join(transacting(methods).select(F.col("key").alias("name"), F.lit(True).alias("_does")), "name", "left")
    calls = calls.join(remote_interfaces(ancestors(classes)).withColumn("_remote", F.lit(True)), "class", "left")
    plumbing = F.startswith(name, F.lit("<")) | name.isin(*PLUMBING)
    served = F.coalesce("_does", F.lit(False)) | ((F.col("dispatch") == "interface") & F.coalesce("_remote", F.lit(False)))
    calls = calls.where(transaction(F.col("class"), name) | (~plumbing & served))
    calls = calls.join(methods.select("method_id", "source_file"), "method_id")
    out = calls.select(F.col("key").alias("method"), F.col("source_file").alias("file"), "line", "held", F.concat("class", F.lit("."), name).alias("callee"))
    return out.orderBy("method", "line", "callee")
