"""Answers of the lock-context index for people and programs: bounded results, brought to the driver.

Every question is a filter or a join over the index's tables; only what is shown is collected. Text reports
show the first rows of each list (SHOWN); answers for programs hold all rows of what was asked for.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.names import basename, short_name, site
from ..operators import graphs
from ..storage import written
from .index import Index

# Rows that a text report shows of each list.
SHOWN = {"methods": 20, "locks": 10, "ungated": 40, "gated": 30, "remote": 300, "sites": 15, "holders": 10, "orders": 15}


def split_site(index: Index, text: str) -> tuple[str, int]:
    row = index.methods.sparkSession.range(1).select(site(F.lit(text)).alias("s")).first()
    if row.s is None:
        raise ValueError(f"{text} isn't FILE:LINE")
    return row.s["file"], row.s["line"]


def places(index: Index, rows: DataFrame, id_: str) -> DataFrame:
    """Adds method and file to rows with a method's number; those of a laid out index know the method's bucket (home)."""
    known = index.of("methods", rows) if "home" in rows.columns else index.methods
    return rows.drop("home", "pred_home").join(known.select(F.col("method_id").alias(id_), F.col("key").alias("method"), "file"), id_)


def points(index: Index, kind: str, text: str) -> DataFrame:
    """method_id, key, file, line and held for the methods at a site, or with a name, at their first line."""
    if kind == "at":
        file, line = split_site(index, text)
        found = index.at(file, line).withColumn("line", F.lit(line).cast("long"))
    else:
        own = index.find_methods(text).withColumn("line", F.col("line_lo").cast("long"))
        spans = index.of("spans", own).select("method_id", "lock", "enter", "exit")
        inside = own.join(spans, "method_id").where("enter <= line and line < exit")
        inside = inside.groupBy("method_id").agg(F.array_sort(F.collect_set("lock")).alias("held"))
        found = own.join(inside, "method_id", "left")
    held = F.coalesce("held", F.array().cast("array<string>")).alias("held")
    home = [c for c in found.columns if c == "home"]
    return found.select("method_id", "key", "file", "line", held, *home).orderBy("key", "method_id")


def entry_paths(index: Index, at: DataFrame, depth: int) -> DataFrame:
    """method_id, lock, dist and path (keys, from the holder down) of locks that may be held on entry."""
    near = index.of("may_held", at).where(F.col("dist") <= depth).join(at.select("method_id"), "method_id", "left_semi")
    leading, methods = index.steps(near)
    leading = leading.select(F.col("method_id").alias("node"), F.col("lock").alias("label"), "dist", "pred")
    paths = graphs.paths(leading, depth).select(F.col("node").alias("method_id"), F.col("label").alias("lock"), "dist", "path")
    paths = paths.join(near.select("method_id", "lock"), ["method_id", "lock"], "left_semi")
    steps = paths.select("method_id", "lock", "dist", F.posexplode("path").alias("i", "step"))
    steps = steps.join(methods.select(F.col("method_id").alias("step"), "key"), "step")
    path = F.transform(F.array_sort(F.collect_list(F.struct("i", "key"))), lambda s: s["key"]).alias("path")
    return steps.groupBy("method_id", "lock", "dist").agg(path).orderBy("method_id", "dist", "lock")


def lock_neighbours(index: Index, text: str, side: str) -> DataFrame:
    """Orders from (or to) locks of that name, the nearest and most frequent first."""
    return places(index, index.with_lock(side, text), "method_id").orderBy("dist", F.desc("count"), "from", "to")


def rows_of(df: DataFrame, most: int | None = None) -> list[dict]:
    return [r.asDict(recursive=True) for r in (df.limit(most) if most else df).collect()]


def answer(index: Index, kind: str, text: str | None, depth: int = 4, shown: dict | None = None) -> dict:
    """One question's answer; `shown` limits each list, else they are whole."""
    most = lambda name: shown and shown[name]
    if kind in ("at", "method"):
        at = points(index, kind, text)
        # What is shown is settled first, and paths are sought for that alone.
        at = written(at.limit(most("methods")) if shown else at, "asked")
        found = rows_of(at.drop("home").orderBy("key", "method_id"))
        of_method = {m["method_id"]: m.setdefault("may_hold", []) for m in found}
        for p in entry_paths(index, at, depth).collect() if found else ():
            of_method[p.method_id].append({"lock": p.lock, "dist": p.dist, "path": p.path})
        for m in found:
            m["may_hold"] = m["may_hold"][: most("locks")]
        return {"asked": {kind: text}, "methods": found}
    if kind == "lock":
        return {
            "asked": {kind: text}, "sites": rows_of(places(index, index.sites(text), "method_id").orderBy("lock", "method", "line"), most("sites")),
            "holders": rows_of(places(index, index.holders(text).where(F.col("dist") <= depth), "method_id").orderBy("dist", "method", "lock"), most("holders")),
            "before": rows_of(lock_neighbours(index, text, "to"), most("orders")), "after": rows_of(lock_neighbours(index, text, "from"), most("orders")),
        }
    if kind == "cycles":
        pairs = index.inversions()
        order = [F.greatest("dist", "back_dist"), F.desc(F.least("count", "back_count")), "from", "to"]
        return {
            "asked": kind, "cycles": [r["locks"] for r in rows_of(index.cycles())],
            "ungated": rows_of(pairs.where("gate is null").orderBy(*order), most("ungated")), "gated": rows_of(pairs.where("gate is not null").orderBy(*order), most("gated")),
        }
    calls = places(index, index.remote_calls(depth).withColumnRenamed("target", "_target"), "caller")
    target = index.methods.select(F.col("method_id").alias("_target"), F.col("key").alias("callee"))
    calls = calls.join(target, "_target").join(index.calls.select("call_id", "line"), "call_id")
    return {"asked": kind, "calls": rows_of(calls.select("method", "file", "line", "callee", "lock", "dist").orderBy("dist", "method", "line", "lock"), most("remote"))}


def last_two(name: str) -> str:
    return ".".join(name.split(".")[-2:])


def report(index: Index, kind: str, text: str | None, depth: int = 4) -> list[str]:
    """The answer as lines of text."""
    found = answer(index, kind, text, depth, SHOWN)
    where = lambda r: f"{r['method']} ({r['file'] or '?'}:{r['line']})"
    if kind in ("at", "method"):
        out = [] if found["methods"] else [f"nothing at {text}"]
        for m in found["methods"]:
            out.append(f"{m['key']} ({m['file'] or '?'}:{m['line']})")
            out += [f"  holds {name}" for name in m["held"]]
            for e in m["may_hold"]:
                out += [f"  may hold {e['lock']} at distance {e['dist']}", f"    {' > '.join(e['path'])}"]
        return out
    if kind == "lock":
        out = [f"taken in {where(r)}: {r['lock']}" for r in found["sites"]]
        out += [f"may be held on entry to {r['method']} at distance {r['dist']}: {r['lock']}" for r in found["holders"]]
        return out + [f"{last_two(r['from'])} before {last_two(r['to'])}, {r['count']} times, {where(r)}" for r in found["before"] + found["after"]]
    if kind == "cycles":
        out = [f"cycle of {len(c)}: {', '.join(map(last_two, c))}" for c in found["cycles"]]
        for r in found["ungated"] + found["gated"]:
            gate = f", both under {last_two(r['gate'])}" if r["gate"] else ""
            out.append(f"{last_two(r['from'])} and {last_two(r['to'])} in both orders, {r['count']} and {r['back_count']} times{gate}")
        return out
    return [f"{where(r)} calls {r['callee']} with {last_two(r['lock'])} held at distance {r['dist']}" for r in found["calls"]]


def located(rows: DataFrame) -> DataFrame:
    """Adds `at`, the file's name and line, and `short`, the lock's last two parts, to rows with file, line and lock."""
    at = F.concat(basename(F.coalesce("file", F.lit("?"))), F.lit(":"), F.coalesce("line", F.lit(0)).cast("string"))
    return rows.withColumn("at", at).withColumn("short", short_name(F.col("lock")))
