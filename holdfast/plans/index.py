"""The lock-context index: spans, linked calls, locks that may be held on entry, lock orders, and questions to it."""

from __future__ import annotations

import json
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..functions.names import ABSTRACT, OPAQUE, flag
from ..operators import graphs, relational
from ..sources.facts import ancestors
from ..storage import is_written, parts_of, side_by_side, written
from .held import PLUMBING, remote_interfaces, surveyed, transacting
from .naming import at_hand, canonical_sites, sites_of

#: The end of a span without a release.
TO_END = 2**32 - 1
#: Of a written index: each table's folder, the column whose buckets its rows lie in, their number, those with rows, its schema.
LAYOUT = "name string, folder string, by string, buckets int, present array<int>, schema string"


@dataclass
class Index:
    methods: DataFrame  # method_id, key, file, line_lo, line_hi, binder
    spans: DataFrame  # method_id, ord, lock, enter, exit, held
    calls: DataFrame  # call_id, caller, line, held, outside
    direct: DataFrame  # call_id, target, how: all links but those by overrides
    open_calls: DataFrame  # call_id, hub: calls that any override at or below their class may take, and the number, below zero, of these
    overrides: DataFrame  # hub, target
    may_held: DataFrame  # method_id, lock, dist, pred: the method a shortest way comes from
    orders: DataFrame  # from, to, count, method_id, line, dist

    def write(self, path: str, methods_each: int = 4_096) -> None:
        """The tables laid out for questions, below a folder of their own; the table `layout`, written last, says which.

        Rows of a method lie in the folder of its file's bucket (home), and copies of those that name a lock in that of the
        lock's (lock_home), so a question reads the folders of what it asks for. There is a bucket for each `methods_each`
        methods, 4,096 at most; beyond, buckets grow. A write that is stopped leaves the earlier index as it was; folders of
        earlier indexes stay until someone removes them.
        """
        import uuid

        spark, folder = self.methods.sparkSession, f"{path}/tables-{uuid.uuid4().hex}"
        n = max(1, min(4_096, -(-self.methods.count() // methods_each)))
        home = lambda c: F.pmod(F.xxhash64(c), F.lit(n)).cast("int")
        methods = self.methods.withColumn("home", home("file"))
        homes = methods.select("method_id", "home")
        spans = self.spans.join(homes, "method_id")
        back = homes.select(F.col("method_id").alias("pred"), F.col("home").alias("pred_home"))
        may_held = self.may_held.join(homes, "method_id").join(back, "pred", "left").select("method_id", "lock", "dist", "pred", "home", "pred_home")
        orders = self.orders.join(homes, "method_id")
        locks = spans.select("lock").union(may_held.select("lock")).union(orders.select("from")).union(orders.select("to")).distinct()
        laid = {
            "methods": (methods, "home", ["file", "line_lo", "method_id"]), "spans": (spans, "home", ["method_id", "enter"]), "may_held": (may_held, "home", ["method_id", "dist"]),
            "lock_spans": (spans.withColumn("lock_home", home("lock")), "lock_home", ["lock", "method_id"]), "lock_may_held": (may_held.withColumn("lock_home", home("lock")), "lock_home", ["lock", "dist"]),
            "lock_from": (orders.withColumn("lock_home", home("from")), "lock_home", ["from", "dist"]), "lock_to": (orders.withColumn("lock_home", home("to")), "lock_home", ["to", "dist"]),
            "locks": (locks.withColumn("lock_home", home("lock")), None, []), "calls": (self.calls, None, []), "direct": (self.direct, None, []),
            "open_calls": (self.open_calls, None, []), "overrides": (self.overrides, None, []), "orders": (self.orders, None, []),
        }
        rows = []
        for name, (table, by, order) in laid.items():
            where, present = f"{folder}/{name}", None
            if by:
                # A bucket is one file unless it is large: then the rebalancing splits it.
                table.hint("rebalance", by).sortWithinPartitions(by, *order).write.partitionBy(by).parquet(where)
                present = sorted(r[0] for r in spark.read.parquet(where).select(by).distinct().collect()) if n > 1 else [0]
                if n == 1 and table.isEmpty():
                    present = []
            else:
                table.write.parquet(where)
            rows.append((name, where, by, n, present, table.schema.json()))
        spark.createDataFrame(rows, LAYOUT).coalesce(1).write.mode("overwrite").parquet(f"{path}/layout")

    @classmethod
    def read(cls, spark: SparkSession, path: str) -> LaidIndex:
        return LaidIndex(spark, {r.name: r for r in spark.read.schema(LAYOUT).parquet(f"{path}/layout").collect()})

    # --- what a question reads; an index that is laid out reads less ---

    def in_file(self, name: str) -> DataFrame:
        """The methods of the files of that name."""
        return self.methods.where(F.col("file") == name)

    def of(self, name: str, rows: DataFrame) -> DataFrame:
        """The table `name`, with all rows at least of the methods of `rows`."""
        return getattr(self, name)

    def with_lock(self, name: str, part: str) -> DataFrame:
        """Rows of spans or may_held, or of orders by their side (from, to), whose lock has `part` in its name."""
        table, column = (self.orders, name) if name in ("from", "to") else (getattr(self, name), "lock")
        return table.where(F.contains(F.col(column), F.lit(part)))

    def steps(self, near: DataFrame) -> tuple[DataFrame, DataFrame]:
        """Rows of may_held with all that lead to those of `near`, and methods with all that stand in them."""
        return self.may_held, self.methods

    # --- questions ---

    def at(self, file: str, line: int) -> DataFrame:
        """Methods of a file whose lines hold `line`, and the locks held there within the method."""
        here = self.in_file(file.rsplit("/", 1)[-1]).where(F.lit(line).between(F.col("line_lo"), F.col("line_hi")))
        inside = self.of("spans", here).where((F.col("enter") <= line) & (F.col("exit") > line)).groupBy("method_id").agg(F.array_sort(F.collect_set("lock")).alias("held"))
        return here.join(inside, "method_id", "left")

    def find_methods(self, part: str) -> DataFrame:
        return self.methods.where(F.contains("key", F.lit(part)))

    def distance(self, part: str, lock: str) -> DataFrame:
        """method_id, key, lock and dist for methods and locks with these in their names: how far the nearest holder is."""
        own = self.find_methods(part)
        return self.of("may_held", own).where(F.contains("lock", F.lit(lock))).join(own.select("method_id", "key"), "method_id").select("method_id", "key", "lock", "dist")

    def callers_of(self, part: str) -> DataFrame:
        """call_id, caller, target and line of the calls that are linked to methods with `part` in their names."""
        found = self.call_edges(self.find_methods(part).select("method_id"))
        return found.select("call_id", F.col("src").alias("caller"), F.col("dst").alias("target"), "line")

    def on_entry(self, depth: int) -> DataFrame:
        return self.may_held.where(F.col("dist") <= depth).orderBy("method_id", "dist", "lock")

    def sites(self, part: str) -> DataFrame:
        rows = self.with_lock("spans", part)
        home = [c for c in rows.columns if c == "home"]
        return rows.select("lock", "method_id", F.col("enter").alias("line"), *home).distinct().orderBy("lock", "method_id", "line")

    def holders(self, part: str) -> DataFrame:
        return self.with_lock("may_held", part).orderBy("lock", "dist", "method_id")

    @property
    def targets(self) -> DataFrame:
        """call_id, target and how of all links. Calls times overrides are rows here only, and nowhere in the tables."""
        over = relational.paired(self.open_calls, self.overrides, "hub").select("call_id", "target", F.lit("override").alias("how"))
        return self.direct.select("call_id", "target", "how").unionByName(over)

    def call_edges(self, to: DataFrame | None = None) -> DataFrame:
        """call_id, src, dst, line and held of all links, or of those to the methods `to` (method_id)."""
        to = None if to is None else to.select(F.col("method_id").alias("target"))
        direct, overrides = [rows if to is None else rows.join(to, "target", "left_semi") for rows in (self.direct, self.overrides)]
        at = self.calls.select("call_id", F.col("caller").alias("src"), "line", "held")
        columns = ["call_id", "src", F.col("target").alias("dst"), "line", "held"]
        return direct.join(at, "call_id").select(*columns).unionByName(relational.paired(self.open_calls.join(at, "call_id"), overrides, "hub").select(*columns))

    def ways(self) -> DataFrame:
        """src and dst: who calls whom, by way of the hubs of overrides, so no more rows than calls and overrides."""
        arrivals = self.direct.select("call_id", "target").unionByName(self.open_calls.select("call_id", F.col("hub").alias("target")))
        ways = arrivals.join(self.calls.select("call_id", "caller"), "call_id").select(F.col("caller").alias("src"), F.col("target").alias("dst"))
        return ways.unionByName(self.overrides.select(F.col("hub").alias("src"), F.col("target").alias("dst"))).distinct()

    def link_statistics(self) -> DataFrame:
        """One row: calls, linked, devirtualized (by the receiver's class), callbacks (edges found from what callers
        pass), external (into classes outside the inputs) and unlinked calls; callbacks alone link no call."""
        links = self.direct.select("call_id", "how").unionByName(self.open_calls.select("call_id", F.lit("override").alias("how")))
        how = links.groupBy("call_id").agg(
            F.count_if(F.col("how") != "formal").alias("plain"), F.count_if(F.col("how") == "receiver").alias("receiver"), F.count_if(F.col("how") == "formal").alias("formal")
        )
        rows = self.calls.select("call_id", "outside").join(how, "call_id", "left").na.fill(0, ["plain", "receiver", "formal"])
        none = F.col("plain") == 0
        return rows.agg(
            F.count("*").alias("calls"), F.count_if(~none).alias("linked"), F.count_if(F.col("receiver") > 0).alias("devirtualized"),
            F.coalesce(F.sum("formal"), F.lit(0)).alias("callbacks"), F.count_if(none & F.col("outside")).alias("external"), F.count_if(none & ~F.col("outside")).alias("unlinked"),
        )

    def witness(self, depth: int) -> DataFrame:
        """method_id, lock, dist and path: methods from the one that holds the lock down to this one.

        At each step back the caller of the least call is taken; which that is was settled when the distance was found, so no
        calls are read here.
        """
        steps = self.may_held.select(F.col("method_id").alias("node"), F.col("lock").alias("label"), "dist", "pred")
        return graphs.paths(steps, depth).select(F.col("node").alias("method_id"), F.col("label").alias("lock"), "dist", "path")

    def cycles(self) -> DataFrame:
        """Groups of locks that are taken in a cycle."""
        edges = self.orders.select(F.col("from").alias("src"), F.col("to").alias("dst"))
        rows = graphs.cycles(edges).groupBy("component").agg(F.array_sort(F.collect_set("node")).alias("locks"))
        return rows.select("locks").orderBy(F.desc(F.size("locks")), "locks")

    def inversions(self) -> DataFrame:
        """Pairs of locks taken in both orders, with the least other lock held at both sites, ungated first."""
        pairs = written(relational.inversions(self.orders), "inversions")
        pairs = pairs.withColumn("a", F.struct("method_id", "line")).withColumn("b", F.struct(F.col("back_method_id").alias("method_id"), F.col("back_line").alias("line")))
        sites = pairs.select("a").union(pairs.select("b")).distinct().select("a.*")
        inside = sites.join(self.spans, "method_id").where("enter <= line and line < exit").select("method_id", "line", "lock")
        entry = sites.join(self.may_held, "method_id").select("method_id", "line", "lock")
        held = inside.unionByName(entry).select(F.struct("method_id", "line").alias("site"), "lock")
        out = relational.gates(pairs, held, ["from", "to"], "a", "b", "site", "lock", ["from", "to"])
        return out.drop("a", "b").orderBy(F.col("gate").isNotNull(), F.greatest("dist", "back_dist"), F.desc(F.least("count", "back_count")), "from", "to")

    def remote_calls(self, depth: int = 4) -> DataFrame:
        """Calls into remote entries with a lock held there (0) or on entry to the caller within `depth`."""
        binder = self.methods.where("binder").select(F.col("method_id").alias("target"))
        least = self.overrides.join(binder, "target", "left_semi").groupBy("hub").agg(F.min("target").alias("target"))
        remote = self.direct.join(binder, "target", "left_semi").select("call_id", "target").unionByName(self.open_calls.join(least, "hub").select("call_id", "target"))
        remote = remote.groupBy("call_id").agg(F.min("target").alias("target")).join(self.calls, "call_id")
        own = remote.select("call_id", "caller", "target", F.explode("held").alias("lock"), F.lit(0).alias("dist"))
        entry = remote.join(self.may_held.where(F.col("dist") <= depth), F.col("caller") == F.col("method_id"))
        both = own.unionByName(entry.select("call_id", "caller", "target", "lock", "dist"))
        return both.groupBy("call_id", "caller", "target", "lock").agg(F.min("dist").alias("dist")).orderBy("dist", "call_id", "lock")


class LaidIndex(Index):
    """An index that was written: a table is listed and read when it is asked for, and of a laid out one only the folders
    that a question needs. What is collected for that are numbers of buckets, 4,096 at most."""

    def __init__(self, spark: SparkSession, layout: dict) -> None:
        self.spark, self.layout = spark, layout

    def __getattr__(self, name: str) -> DataFrame:
        if name not in self.__dict__.get("layout", ()):
            raise AttributeError(name)
        return self.table(name)

    def table(self, name: str, buckets: set[int] | None = None) -> DataFrame:
        """A table, or its buckets of these numbers."""
        laid = self.layout[name]
        schema = StructType.fromJson(json.loads(laid.schema))
        read = self.spark.read.schema(schema).option("basePath", laid.folder)
        if laid.by is None:
            return read.parquet(laid.folder)
        found = [b for b in laid.present if buckets is None or b in buckets]
        if not found:
            return self.spark.createDataFrame([], schema)
        return read.parquet(*[f"{laid.folder}/{laid.by}={b}" for b in found] if buckets is not None else [laid.folder])

    def in_file(self, name: str) -> DataFrame:
        n = self.layout["methods"].buckets
        home = self.spark.sql("SELECT CAST(pmod(xxhash64(:name), :n) AS INT)", args={"name": name, "n": n}).first()[0]
        return self.table("methods", {home}).where(F.col("file") == name)

    def of(self, name: str, rows: DataFrame) -> DataFrame:
        return self.table(name, {r[0] for r in rows.select("home").distinct().collect()})

    def with_lock(self, name: str, part: str) -> DataFrame:
        locks = self.locks.where(F.contains("lock", F.lit(part)))
        column = name if name in ("from", "to") else "lock"
        return self.table(f"lock_{name}", {r[0] for r in locks.select("lock_home").distinct().collect()}).where(F.contains(F.col(column), F.lit(part))).drop("lock_home")

    def steps(self, near: DataFrame) -> tuple[DataFrame, DataFrame]:
        """The chain of lookups from `near` back to the holders, a round a distance; no calls and no other buckets are read."""
        known = level = written(near, "steps")
        while True:
            back = level.where("dist > 1 and pred is not null").select(F.col("pred").alias("method_id"), "lock", F.col("pred_home").alias("home")).distinct()
            homes = {r[0] for r in back.select("home").distinct().collect()}
            if not homes:
                break
            found = self.table("may_held", homes).join(back.drop("home"), ["method_id", "lock"], "left_semi")
            level = written(found.select(*known.columns), "steps")
            known = known.unionByName(level)
        # A row of `near` may lead to another.
        known = known.dropDuplicates(["method_id", "lock"])
        homes = known.select("home").union(known.where("pred_home is not null").select("pred_home"))
        return known, self.of("methods", homes)


def named_events(methods: DataFrame, events: DataFrame, found: DataFrame | None = None) -> DataFrame:
    """Events with canonical names: per method the first line at which a name is seen decides it for all of it."""
    sites = canonical_sites(sites_of(methods, found)).withColumnRenamed("lock", "canon")
    # The walk tells where each name is seen first; a name that stays as it is needs no entry.
    first = events.where("kind = 'name'").select("method_id", "key", F.col("name").alias("g"), "line")
    canon = first.join(sites, ["key", "line"]).where("canon <> g").select("method_id", "g", F.col("canon").alias("to"))
    maps = canon.groupBy("method_id").agg(F.map_from_entries(F.collect_list(F.struct("g", "to"))).alias("_map"))
    # Nothing here asks for accesses of fields.
    out = events.where("kind not in ('name', 'field')").join(written(maps, "name-maps"), "method_id", "left")
    to = lambda n: F.coalesce(F.try_element_at("_map", n), n)
    names = F.filter(F.transform("held", to), lambda n: ~F.startswith(n, F.lit(OPAQUE)))
    return out.withColumn("held", names).withColumn("name", F.when(F.col("kind").isin("acquire", "release"), to(F.col("name"))).otherwise(F.col("name"))).drop("_map")


def spans_of(events: DataFrame) -> DataFrame:
    """Where each lock is held in each method: from the line taken to the last release seen, exclusive."""
    taken = events.where("kind = 'acquire'").where(~F.startswith("name", F.lit(OPAQUE)))
    taken = taken.groupBy("method_id", F.col("name").alias("lock"), F.coalesce("line", F.lit(0)).cast("long").alias("enter"))
    taken = taken.agg(F.min("ord").alias("ord"), F.min_by("held", "ord").alias("held"))
    gone = events.where("kind = 'release' and enter is not null")
    gone = gone.groupBy("method_id", F.col("name").alias("lock"), F.col("enter").cast("long").alias("enter"))
    gone = gone.agg(F.max(F.greatest(F.coalesce("line", F.lit(0)), F.col("enter") + 1)).cast("long").alias("exit"))
    out = taken.join(gone, ["method_id", "lock", "enter"], "left")
    return out.withColumn("exit", F.coalesce("exit", F.lit(TO_END).cast("long")))


def declared_at(rows: DataFrame, above: DataFrame, declared: DataFrame, cls: str, id_: list[str], name: str) -> DataFrame:
    """For rows (id_, cls, sig) the nearest method at or above the class that declares the signature."""
    found = rows.join(above.withColumnRenamed("child", cls), cls).join(declared.withColumnRenamed("class", "ancestor"), ["ancestor", "sig"])
    return found.groupBy(*id_).agg(F.min_by("method_id", F.struct("steps", "method_id")).alias(name))


def linked(calls: DataFrame, classes: DataFrame, above: DataFrame, methods: DataFrame, binder: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """call_id, target and how: by the receiver's known class (receiver), else by the static class (class); if the
    receiver is neither known nor a formal, by all overrides too; calls on a formal also get the classes that
    callers pass (formal). A target that is found twice has the first of these. `above` are the ancestors of `classes`.

    Calls of one class and signature have the same overrides, however many these are: such calls (call_id, hub) lead to a hub and
    the hub to its overrides (hub, target), so nothing grows with calls times overrides. A hub is numbered by the least of its calls, below zero.
    """
    outside = calls.select(F.col("class").alias("child")).distinct().join(classes.select(F.col("class").alias("child")), "child", "left_anti")
    above = written(above.unionByName(outside.select("child", F.col("child").alias("ancestor"), F.lit(0).alias("steps"))), "ancestors-outside")
    declared = written(methods.select("class", F.concat("name", F.lit(":"), "sig").alias("sig"), "method_id"), "declared")
    # Repeated declarations of a key: the last one counts.
    single = declared.groupBy("class", "sig").agg(F.max("method_id").alias("method_id"))
    open_ = F.col("dispatch").isin("virtual", "interface")
    receiver = F.when(F.col("dispatch") != "static", F.try_element_at("arg_types", F.lit(1)))
    calls = calls.withColumn("recv", F.when(open_ & (receiver != F.col("class")), receiver)).withColumn("formal", F.try_element_at("arg_formals", F.lit(1)))
    calls = written(calls, "raw-calls")
    # Each of these is read two or three times below.
    precise = written(declared_at(calls.where("recv is not null").select("call_id", "recv", "sig"), above, single, "recv", ["call_id"], "target"), "targets-receiver")
    rest = calls.join(precise, "call_id", "left_anti")
    static = written(declared_at(rest.select("call_id", "class", "sig"), above, single, "class", ["call_id"], "target"), "targets-class")
    remote = static.join(binder.select(F.col("method_id").alias("target")), "target", "left_semi").select("call_id")
    wide = rest.where(open_ & F.col("formal").isNull()).join(remote, "call_id", "left_anti").select("call_id", "class", "sig")
    hubs = written(wide.groupBy("class", "sig").agg((-1 - F.min("call_id")).alias("hub")), "hubs")
    over = declared.join(hubs.select("sig").distinct(), "sig", "left_semi").select(F.col("class").alias("child"), "sig", F.col("method_id").alias("target"))
    over = over.join(above.select("child", F.col("ancestor").alias("class")), "child").join(hubs, ["class", "sig"]).select("hub", "target").distinct()
    # The calls of a hub have the same method by their static class, too.
    over = written(over.join(static.select((-1 - F.col("call_id")).alias("hub"), "target"), ["hub", "target"], "left_anti"), "overrides")
    open_calls = wide.join(hubs.join(over, "hub", "left_semi"), ["class", "sig"]).select("call_id", "hub")
    open_calls = written(open_calls, "open-calls")
    found = lambda rows, how: rows.select("call_id", "target", F.lit(how).alias("how"))
    targets = written(found(precise, "receiver").unionByName(found(static, "class")), "targets")
    # Callbacks: formals that are invoked on, directly or by being passed on, and the classes that reach them.
    any_remote = targets.join(binder.select(F.col("method_id").alias("target")), "target", "left_semi").select("call_id").distinct()
    on_formal = calls.where(open_ & F.col("formal").isNotNull()).join(any_remote, "call_id", "left_anti")
    arrivals = targets.select("call_id", "target").unionByName(open_calls.select("call_id", F.col("hub").alias("target")))
    args = calls.join(arrivals, "call_id").select("caller", "target", F.posexplode(F.arrays_zip("arg_types", "arg_formals")).alias("p", "a"))
    args = args.select("caller", "target", "p", F.col("a.arg_types").alias("cls"), F.col("a.arg_formals").alias("i"))
    args = written(args.where("cls is not null or i is not null"), "arguments")
    at = lambda m, j: F.struct(F.col(m).cast("long").alias("m"), F.col(j).cast("int").alias("j"))
    handed = args.where("target < 0").select(F.col("target").alias("hub"), "p").distinct().join(over, "hub")
    passes = args.where("i is not null").select(at("caller", "i").alias("src"), at("target", "p").alias("dst")).distinct()
    passes = written(passes.unionByName(handed.select(at("hub", "p").alias("src"), at("target", "p").alias("dst"))), "passes")
    asked = on_formal.select(at("caller", "formal").alias("node"))
    demand = graphs.reachable(passes.select(F.col("dst").alias("src"), F.col("src").alias("dst")), asked)
    given = args.where("cls is not null").select(at("target", "p").alias("node"), F.col("cls").alias("label")).join(demand, "node", "left_semi").distinct()
    flow = passes.join(demand.withColumnRenamed("node", "dst"), "dst", "left_semi")
    known = new = written(given, "classes-reaching")
    while not new.isEmpty():
        moved = new.join(flow, F.col("node") == F.col("src")).select(F.col("dst").alias("node"), "label").distinct()
        new = written(moved.join(known, ["node", "label"], "left_anti"), "classes-reaching")
        known = written(known.unionByName(new), "classes-reaching")
    back = on_formal.select("call_id", "sig", at("caller", "formal").alias("node")).join(known, "node").select("call_id", "sig", F.col("label").alias("cls"))
    added = declared_at(back, above, single, "cls", ["call_id", "cls"], "target").select("call_id", "target")
    added = added.distinct().join(targets, ["call_id", "target"], "left_anti")
    return written(targets.unionByName(found(added, "formal")), "targets"), open_calls, over


def lock_orders(spans: DataFrame, may_held: DataFrame, order_depth: int) -> DataFrame:
    """Lock pairs (from held while to is taken): count, and the site of the least distance.

    A lock that is held already, here or on entry, orders nothing.
    """
    fresh = spans.where(~F.array_contains("held", F.col("lock")))
    fresh = fresh.join(may_held.select("method_id", "lock"), ["method_id", "lock"], "left_anti")
    own = fresh.select("method_id", "ord", F.col("lock").alias("to"), F.col("enter").alias("line"), F.posexplode("held").alias("at", "from")).withColumn("dist", F.lit(0))
    entry = fresh.join(may_held.where(F.col("dist") <= order_depth).select("method_id", F.col("lock").alias("from"), "dist"), "method_id")
    entry = entry.select("method_id", "ord", F.col("lock").alias("to"), F.col("enter").alias("line"), F.lit(0).alias("at"), "from", "dist")
    rows = own.unionByName(entry).where("from <> to")
    return relational.argmin(rows, ["from", "to"], ["dist", "method_id", "ord", "at"], ["method_id", "line", "dist"])


def linked_events(classes: DataFrame, methods: DataFrame, events: DataFrame, above: DataFrame) -> tuple[DataFrame, DataFrame, tuple[DataFrame, DataFrame, DataFrame]]:
    """Calls (call_id, caller, ord, line, outside), numbered in the order of methods; methods that a remote call enters; what `linked` gives."""
    calls = events.where("kind = 'call'").select("method_id", "ord", "line", "class", "sig", "dispatch", "arg_types", "arg_formals")
    calls = relational.numbered(calls, ["method_id", "ord"], "call_id", parts=parts_of(events.sparkSession, calls.count())).withColumnRenamed("method_id", "caller")
    calls = written(calls.withColumn("line", F.coalesce("line", F.lit(0))), "calls")
    abstract = methods.where(flag(F.col("access"), ABSTRACT)).join(remote_interfaces(above), "class", "left_semi").select("method_id")
    does = methods.join(transacting(methods), "key", "left_semi").select("method_id")
    named = methods.where(~F.startswith("name", F.lit("<")) & ~F.col("name").isin(*PLUMBING)).select("method_id")
    raw = methods.where((F.col("class") == "android.os.IBinder") & F.startswith("name", F.lit("transact"))).select("method_id")
    binder = written(abstract.union(does).distinct().join(named, "method_id", "left_semi").union(raw).distinct(), "binder")
    links = linked(calls, classes, above, methods, binder)
    known = classes.select("class", F.lit(False).alias("_outside")).distinct()
    calls = calls.join(known, "class", "left").select("call_id", "caller", "ord", "line", F.coalesce("_outside", F.lit(True)).alias("outside"))
    return calls, binder, links


def build(classes: DataFrame, methods: DataFrame, max_depth: int = 8, order_depth: int = 3, survey: tuple[DataFrame, DataFrame] | None = None, above: DataFrame | None = None) -> Index:
    """`survey` are the events of all methods without locks on entry and their facts, as of `surveyed`, and `above` the ancestors of
    all classes, where they are known already; `methods` are written then."""
    # Read many times from here on, whatever they are derived from.
    spark, classes = classes.sparkSession, classes if is_written(classes) else written(classes, "classes")
    methods = at_hand(methods) if survey is None else methods
    survey, above = side_by_side(
        spark, lambda: surveyed(methods, fields=False)[1:] if survey is None else survey, lambda: written(ancestors(classes), "ancestors") if above is None else above
    )
    # What a call leads to doesn't hang on the names of the locks held there.
    events, (calls, binder, (direct, open_calls, overrides)) = side_by_side(
        spark, lambda: written(named_events(methods, *survey), "named-events"), lambda: linked_events(classes, methods, survey[0], above)
    )
    spans = written(spans_of(events), "spans")
    held = events.where("kind = 'call'").select(F.col("method_id").alias("caller"), "ord", "held")
    calls = written(calls.join(held, ["caller", "ord"]).select("call_id", "caller", "line", "held", "outside"), "call-sites")
    arrivals = direct.select("call_id", "target").unionByName(open_calls.select("call_id", F.col("hub").alias("target")))
    edges = arrivals.join(calls.select("call_id", "caller", "held"), "call_id")
    start = edges.select(F.col("target").alias("node"), F.explode("held").alias("label"), F.col("caller").alias("pred"), F.col("call_id").alias("via"))
    ways = edges.groupBy(F.col("caller").alias("src"), F.col("target").alias("dst")).agg(F.min("call_id").alias("via"))
    far = graphs.traced(written(ways, "ways"), start, max(1, max_depth), overrides.select("hub", F.col("target").alias("node")))
    may_held = written(far.select(F.col("node").alias("method_id"), F.col("label").alias("lock"), "dist", "pred"), "may-held")
    orders = written(lock_orders(spans, may_held, order_depth), "orders")
    lines = F.transform("positions", lambda p: p["line"])
    records = methods.join(binder.withColumn("binder", F.lit(True)), "method_id", "left").select(
        "method_id", "key", F.coalesce("source_file", F.lit("")).alias("file"), F.coalesce(F.array_min(lines), F.lit(0)).alias("line_lo"), F.coalesce(F.array_max(lines), F.lit(0)).alias("line_hi"), F.coalesce("binder", F.lit(False)).alias("binder")
    )
    return Index(written(records, "method-index"), spans, calls, direct, open_calls, overrides, may_held, orders)
