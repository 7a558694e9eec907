"""Names of all lock sites: parameters bound over call sites, field aliases, alias chains."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from ..functions.names import AFFIXES, CUT, LONGEST_PATH, OF_FORMAL, STATIC, dotted, parameters
from ..operators.relational import unique_or_null
from ..storage import is_written, spread_out, without, written
from .methods import SUMMARY, batches_of, methods_in, summary_rows

#: Aliases followed at most.
HOPS = 6
#: What the functions over method rows read.
NEEDED = ("method_id", "key", "class", "access", "registers", "ins", "insns", "positions", "catches", "getters", "effects", "entry")


def arrow_schema(ddl: str) -> pa.Schema:
    return to_arrow_schema(StructType.fromDDL(ddl))


def mapped(rows: DataFrame, make, ddl: str) -> DataFrame:
    """A small function over method rows, in Arrow batches of the columns it needs.

    Instructions without a meaning here stay behind, but for methods with handlers: there they show which blocks throw.
    """
    schema = arrow_schema(ddl)
    named = F.when(F.coalesce(F.size("catches") > 0, F.lit(False)), F.col("insns")).otherwise(F.filter("insns", lambda i: i["op"] != "other"))
    rows = rows.withColumn("insns", named).select(*[c for c in NEEDED if c in rows.columns])

    def run(batches):
        # Methods are made of many small values without cycles: looking for those takes longer than the walk.
        import gc

        gc.disable()
        try:
            yield from batches_of(make(methods_in(batches)), schema)
        finally:
            gc.enable()

    return rows.mapInArrow(run, ddl)


def rendered(v: Column) -> Column:
    """The name of a lock value."""
    kind, text = v["kind"], v["text"]
    head = text
    for of, (before, after) in AFFIXES.items():
        head = F.when(kind == of, F.concat(F.lit(before), text, F.lit(after))).otherwise(head)
    mode = F.when(v["mode"] != "", F.array(v["mode"])).otherwise(F.array().cast("array<string>"))
    return F.array_join(F.concat(F.array(head), v["fields"], mode), ".")


def made(kind: Column | str, text: Column, fields: Column, mode: Column) -> Column:
    kind = F.lit(kind) if isinstance(kind, str) else kind
    return F.struct(kind.alias("kind"), text.alias("text"), fields.alias("fields"), mode.alias("mode"))


def grounded(v: Column, cls: Column, key: Column) -> Column:
    none = F.array().cast("array<string>")
    param = made("opaque", F.concat(key, F.lit(OF_FORMAL), v["text"]), none, F.lit(""))
    return F.when(v["kind"] == "this", made("recv", cls, v["fields"], v["mode"])).when(v["kind"] == "param", param).otherwise(v)


def extended(base: Column, more: Column) -> Column:
    """`base` followed by the fields and the mode of `more`; too long a path is a distinct unknown."""
    whole = made(base["kind"], base["text"], F.concat(base["fields"], more["fields"]), F.when(more["mode"] != "", more["mode"]).otherwise(base["mode"]))
    cut = made("opaque", F.concat(F.lit(CUT), rendered(whole)), F.array().cast("array<string>"), F.lit(""))
    return F.when(F.size(whole["fields"]) > LONGEST_PATH, cut).otherwise(whole)


def summaries(methods: DataFrame, found: DataFrame | None = None) -> DataFrame:
    """Per-method facts, where there are any; getters are found in a first pass, so they resolve one level. First of a key only.

    The first pass is over all methods (`found`, where it is done already; written); only those that call a getter are
    gone through again.
    """
    found = written(mapped(methods, summary_rows, SUMMARY), "facts") if found is None else found
    getters = found.where("getter is not null").groupBy("key").agg(F.max_by("getter", "method_id").alias("value"))
    getters = written(getters, "getters")
    facts = found
    if not getters.isEmpty():
        again = written(called_keys(methods).join(getters, "key", "left_semi").select("method_id").distinct(), "getters-callers")
        new = mapped(with_callees(methods.join(again, "method_id", "left_semi"), getters, "getters"), summary_rows, SUMMARY)
        # What the first pass found stays where it is.
        facts = without(facts, again, "method_id", "facts-kept").unionByName(written(new, "facts-again"))
    first = methods.groupBy("key").agg(F.min("method_id").alias("_first"), F.count("*").alias("_n")).where("_n > 1")
    later = written(methods.select("key", "method_id").join(first, "key").where("method_id > _first").select("method_id"), "later-methods")
    return facts if later.isEmpty() else without(facts, later, "method_id", "summaries")


def called_keys(methods: DataFrame) -> DataFrame:
    """method_id and key of each method that it calls, once."""
    calls = F.transform(F.filter("insns", lambda i: i["op"] == "invoke"), lambda i: F.concat(i["class"], F.lit("."), i["name"], F.lit(":"), i["sig"]))
    return methods.select("method_id", F.explode(F.array_distinct(calls)).alias("key"))


def with_callees(methods: DataFrame, facts: DataFrame, name: str) -> DataFrame:
    """Adds to each method an array of the facts (by key) of the methods that it calls.

    Methods are dealt out for what is done with them next: a walk takes much longer than its few bytes tell.
    """
    # They are read twice: what they are chosen from, with all code, once.
    methods = written(methods, "called-again")
    n, called = spread_out(methods.sparkSession), called_keys(methods).join(facts, "key")
    # Both sides are dealt alike, so methods are sent once and to as many tasks as are wanted.
    lists = called.repartition(n, "method_id").groupBy("method_id").agg(F.collect_list(F.struct("key", *[c for c in facts.columns if c != "key"])).alias(name))
    return methods.repartition(n, "method_id").join(lists, "method_id", "left")


def solved_formals(facts: DataFrame) -> DataFrame:
    """key, formal, tag and lock: what each demanded formal is bound to at all call sites of its method.

    The demand starts at formals stored into fields or locked, and follows arguments that are formals of
    the caller. Then rounds of join and meet up to the least fixpoint: bottom, one lock, or top.
    """
    seeds = facts.select("key", F.explode("stores.formal").alias("formal"))
    locked = facts.select("key", F.explode("sites.lock").alias("lock")).where("lock.kind = 'param'")
    seeds = seeds.unionByName(locked.select("key", F.col("lock.text").cast("int").alias("formal")))
    bound = facts.select(F.col("key").alias("caller"), "class", F.posexplode("bindings").alias("site", "b"))
    actuals = bound.select("caller", "class", "site", F.col("b.callee").alias("key"), F.posexplode("b.actuals").alias("formal", "actual"))
    actuals = written(actuals, "actuals")
    sites = written(bound.select(F.col("b.callee").alias("key"), "caller", "site"), "call-sites")
    demand = new = written(seeds.distinct(), "demand")
    while not new.isEmpty():
        asked = actuals.where("actual.kind = 'param'").join(new, ["key", "formal"])
        asked = asked.select(F.col("caller").alias("key"), F.col("actual.text").cast("int").alias("formal")).distinct()
        new = written(asked.join(demand, ["key", "formal"], "left_anti"), "demand")
        demand = written(demand.unionByName(new), "demand")
    # A row for each call site of a demanded formal, its actual or none.
    rows = demand.join(sites, "key", "left").join(actuals, ["key", "formal", "caller", "site"], "left")
    rows = written(rows, "bound-formals")
    none = F.lit(None).cast(facts.schema["getter"].dataType)
    state = written(demand.select("key", "formal", F.lit("bottom").alias("tag"), none.alias("lock")), "formals")
    g = grounded(F.col("actual"), F.col("class"), F.col("caller"))
    while True:
        before = state.select(F.col("key").alias("caller"), F.col("formal").cast("string").alias("_text"), F.col("tag").alias("_tag"), F.col("lock").alias("_lock"))
        on = (F.col("r.caller") == F.col("b.caller")) & (F.col("actual.kind") == "param") & (F.col("actual.text") == F.col("b._text"))
        seen = rows.alias("r").join(before.alias("b"), on, "left").select("r.*", "_tag", "_lock")
        is_param = F.col("actual.kind") == "param"
        value = F.when(is_param, F.when(F.col("_tag") == "value", extended(F.col("_lock"), F.col("actual")))).when(g["kind"].isin("recv", "static"), g)
        top = F.col("caller").isNull() | F.col("actual").isNull() | F.when(is_param, F.col("_tag") == "top").otherwise(~g["kind"].isin("recv", "static"))
        seen = seen.select("key", "formal", value.alias("value"), F.coalesce(top, F.lit(False)).alias("top"))
        seen = seen.withColumn("name", F.to_json("value"))
        many = F.max(F.col("top").cast("int")).cast("boolean") | F.coalesce(F.min("name") != F.max("name"), F.lit(False))
        after = seen.groupBy("key", "formal").agg(F.when(many, "top").when(F.min("name").isNull(), "bottom").otherwise("value").alias("tag"), F.min_by("value", "name").alias("_v"))
        after = written(after.select("key", "formal", "tag", F.when(F.col("tag") == "value", F.col("_v")).alias("lock")), "formals")
        if after.select("key", "formal", "tag", F.to_json("lock").alias("lock")).exceptAll(state.select("key", "formal", "tag", F.to_json("lock").alias("lock"))).isEmpty():
            return after
        state = after


def field_aliases(facts: DataFrame, formals: DataFrame) -> DataFrame:
    """field and the one lock that it names: stored locks, stored formals, and fields of a singleton type."""
    direct = facts.select(F.explode("aliases").alias("a")).select("a.field", "a.lock")
    stores = facts.select("key", F.explode("stores").alias("s")).select("key", "s.field", "s.formal").join(formals, ["key", "formal"], "left")
    # Any store of no single lock makes the field's own.
    single = (F.min(F.coalesce(F.col("tag") == "value", F.lit(False)).cast("int")) == 1) & (F.min(F.to_json("lock")) == F.max(F.to_json("lock")))
    injected = stores.groupBy("field").agg(F.when(single, F.min_by("lock", F.to_json("lock"))).alias("lock"))
    injected = injected.where(F.col("lock").isNotNull() & (rendered(F.col("lock")) != F.col("field")))
    noted = direct.unionByName(injected).withColumn("json", F.to_json("lock"))
    named = noted.groupBy("field").agg(F.when(F.min("json") == F.max("json"), F.min_by("lock", "json")).alias("lock"))
    # A type that locks itself and is stored in one field only is that field.
    own = facts.where(F.exists("sites", lambda s: s["lock"]["kind"] == "this")).select(F.col("class").alias("type")).distinct()
    stored = facts.select(F.explode("allocs").alias("a")).groupBy(F.col("a.type").alias("type"))
    stored = stored.agg(F.min("a.field").alias("field"), F.max("a.field").alias("_last")).where("field = _last")
    alone = stored.join(own, "type", "left_semi").join(named, "field", "left_anti")
    alone = alone.select("field", made("recv", F.col("type"), F.array().cast("array<string>"), F.lit("")).alias("lock"))
    return named.where("lock is not null").unionByName(alone.dropDuplicates(["field"]))


def canonical(rows: DataFrame, lock: str, aliases: DataFrame) -> DataFrame:
    """Follows aliases of the lock column, its mode kept, for at most HOPS steps.

    A way depends on the name alone: the few aliases are followed to their ends first, and each row takes one step.
    """
    step = aliases.select("field", F.col("lock").alias("_to"))
    ends = aliases.select(F.col("field").alias("_name"), F.col("lock").alias("_end"))
    for _ in range(HOPS - 1):
        ends = moved_on(ends, "_end", step)
    ends = written(ends.select(F.col("_name").alias("field"), F.col("_end").alias("_to")), "alias-ends")
    return moved_on(rows, lock, ends)


def moved_on(rows: DataFrame, lock: str, to: DataFrame) -> DataFrame:
    """The lock column, its mode kept, after one step along `to` (field, _to), where there is one."""
    v = F.col(lock)
    bare = rendered(made(v["kind"], v["text"], v["fields"], F.lit("")))
    rows = rows.withColumn("_bare", F.when(v["kind"].isin("recv", "static"), bare))
    rows = rows.join(to, F.col("_bare") == F.col("field"), "left")
    moved = made(F.col("_to.kind"), F.col("_to.text"), F.col("_to.fields"), v["mode"])
    return rows.withColumn(lock, F.when(F.col("_to").isNotNull(), moved).otherwise(v)).drop("_bare", "field", "_to")


def lock_points(methods: DataFrame) -> DataFrame:
    """class, method, source_file, line, lock: every site that takes a lock, by its canonical name.

    A locked parameter is what all call sites bind it to, else its declared class; anything else is
    grounded in its class; then aliases are followed.
    """
    return points_of(at_hand(methods))


def at_hand(methods: DataFrame) -> DataFrame:
    """Methods written once, as they are read many times. Fewer partitions than cores are dealt out, as work on a
    method takes much longer than reading it."""
    cores = methods.sparkSession.sparkContext.defaultParallelism
    few = methods.rdd.getNumPartitions() < cores
    if is_written(methods) and not few:
        return methods
    return written(methods.repartition(cores, "method_id") if few else methods, "methods")


def points_of(methods: DataFrame, found: DataFrame | None = None) -> DataFrame:
    """`lock_points` of methods that are cheap to read again; `found` is as for `summaries`."""
    sites = sites_of(methods, found).join(methods.select("method_id", "source_file"), "method_id")
    return sites.select("class", "method", "source_file", "line", "lock")


def sites_of(methods: DataFrame, found: DataFrame | None = None) -> DataFrame:
    """method_id, class, method, line and lock of `points_of`."""
    facts = summaries(methods, found)
    formals = solved_formals(facts)
    aliases = written(field_aliases(facts, formals), "aliases")
    sites = facts.select("method_id", "key", "class", F.posexplode("sites").alias("ord", "s"))
    sites = sites.select("method_id", "key", "class", "ord", "s.line", "s.lock").withColumn("formal", F.when(F.col("lock.kind") == "param", F.col("lock.text").cast("int")))
    sites = sites.join(formals.where("tag = 'value'").select("key", "formal", F.col("lock").alias("bound")), ["key", "formal"], "left")
    # Objects among the parameters by word: long and double take two.
    kinds = parameters(F.col("sig"))
    first = F.when(F.col("access").bitwiseAND(STATIC) != 0, 0).otherwise(1)
    wide = F.transform(kinds, lambda d: F.when(d.isin("J", "D"), 2).otherwise(1))
    objects = methods.where(F.contains(F.substring_index("sig", ")", 1), F.lit("L")))
    declared = objects.select("method_id", first.alias("first"), wide.alias("wide"), F.posexplode(kinds).alias("at", "d"))
    word = F.col("first") + F.aggregate(F.slice("wide", 1, F.col("at")), F.lit(0), lambda a, w: a + w)
    declared = declared.where("d like 'L%'").select("method_id", word.alias("formal"), dotted(F.col("d")).alias("declared"))
    sites = sites.join(declared, ["method_id", "formal"], "left")
    plain = F.col("bound").isNull() & F.col("declared").isNotNull() & (F.size("lock.fields") == 0)
    start = F.coalesce(F.when(F.col("bound").isNotNull(), extended(F.col("bound"), F.col("lock"))), grounded(F.col("lock"), F.col("class"), F.col("key")))
    sites = canonical(sites.withColumn("at", start).withColumn("typed", F.when(plain, F.col("declared"))), "at", aliases)
    return sites.select("method_id", "class", F.col("key").alias("method"), "line", F.coalesce("typed", rendered(F.col("at"))).alias("lock"))


def canonical_sites(points: DataFrame) -> DataFrame:
    """key, line (0: unknown) and the one lock taken there; null if there are several."""
    rows = points.select(F.col("method").alias("key"), F.coalesce("line", F.lit(0)).alias("line"), "lock")
    return unique_or_null(rows, ["key", "line"], "lock")
