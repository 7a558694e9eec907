"""Command line: python -m holdfast resolve | dump | remote | index | ask | races."""

from __future__ import annotations

import argparse
import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .plans.held import calls_under_lock
from .plans.index import Index, build
from .plans.naming import lock_points
from .plans.race import races
from .plans.report import answer, report
from .plans.resolve import index_of_builds, resolve
from .sources import observations, reports
from .sources.bytecode import read_classes
from .sources.facts import read_facts
from .sources.seam import register


def facts(spark: SparkSession, args: argparse.Namespace) -> tuple[DataFrame, DataFrame, DataFrame]:
    return read_facts(spark, args.input, args.facts) if args.facts else read_classes(spark, args.input, args.scope)


def run_resolve(spark: SparkSession, args: argparse.Namespace) -> None:
    if args.source:
        register(spark)
        asked = {c: v for c, v in (("build_id", args.build), ("device_name", args.device)) if v}
        rows = spark.read.format(args.source).options(**asked, **dict(o.split("=", 1) for o in args.option or ())).load(args.input)
    else:
        rows = observations.read_observations(spark, args.input)
    rows = observations.selected(rows, args.build, args.device, args.limit)
    builds = [r.build_id for r in rows.select("build_id").distinct().toLocalIterator()]
    if args.by_build:
        for one in builds:
            index = index_of_builds(spark, [one], args.artifacts, args.cache, args.scope)
            observations.write_build(resolve(rows.where(F.col("build_id") == one), index, args.fuzz, args.if_unique), args.output, args.gzip)
        return
    index = index_of_builds(spark, builds, args.artifacts, args.cache, args.scope)
    out = resolve(rows, index, args.fuzz, args.if_unique)
    observations.write_csv(observations.compact(out) if args.compact_counts else out, args.output, args.gzip)


def run_dump(spark: SparkSession, args: argparse.Namespace) -> None:
    points = lock_points(facts(spark, args)[1])
    if args.format == "json":
        reports.write_points_json(points, args.output, args.gzip)
    else:
        reports.write_points_columns(points, args.output, gzip=args.gzip)


def run_remote(spark: SparkSession, args: argparse.Namespace) -> None:
    classes, methods, _ = facts(spark, args)
    reports.write_calls_under_lock(calls_under_lock(classes, methods, args.closed_world), args.output)


def run_index(spark: SparkSession, args: argparse.Namespace) -> None:
    classes, methods, _ = facts(spark, args)
    build(classes, methods, args.max_depth, args.order_depth).write(args.output)


def run_ask(spark: SparkSession, args: argparse.Namespace) -> None:
    index, asked = Index.read(spark, args.input), []
    asked += [("at", x) for x in args.at or ()] + [("method", x) for x in args.method or ()] + [("lock", x) for x in args.lock or ()]
    asked += [(kind, None) for kind in ("cycles", "remote") if getattr(args, kind)]
    if not asked:
        raise SystemExit("ask something: --at, --method, --lock, --cycles or --remote")
    if args.json:
        found = [answer(index, kind, text, args.depth) for kind, text in asked]
        print(json.dumps(found if len(found) > 1 else found[0]))
    else:
        for kind, text in asked:
            print("\n".join(report(index, kind, text, args.depth)))


def run_races(spark: SparkSession, args: argparse.Namespace) -> None:
    found = races(*facts(spark, args), min_guarded=args.min_guarded, min_ratio=args.min_ratio, max_depth=args.max_depth, shown=reports.SHOWN, shown_open=args.shown_open)
    reports.write_races(found, args.output)


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="holdfast", description=__doc__)
    commands = top.add_subparsers(required=True)

    def command(name: str, run, output: str | None, what: str = "folder of archives, or of fact tables") -> argparse.ArgumentParser:
        p = commands.add_parser(name)
        p.set_defaults(run=run)
        p.add_argument("input", help=what)
        if output:
            p.add_argument("-o", "--output", default=output)
            p.add_argument("--scope", default="*", help="glob on the names of archives")
        return p

    def over_facts(p: argparse.ArgumentParser) -> argparse.ArgumentParser:
        p.add_argument("--facts", choices=["parquet", "json"], help="the input is fact tables of that format")
        return p

    p = command("resolve", run_resolve, "resolved", "CSV of observations")
    p.add_argument("--artifacts", required=True, help="folder with a folder of archives for each build, or with archives")
    p.add_argument("--source", help="name of the source that reads the input, instead of CSV files read by Spark")
    p.add_argument("--option", action="append", metavar="NAME=VALUE", help="an option of the source")
    p.add_argument("--cache", help="folder where the site index of each build is kept")
    for name in ("--build", "--device"):
        p.add_argument(name)
    for name in ("--limit", "--fuzz"):
        p.add_argument(name, type=int, default=0)
    for name in ("--if-unique", "--gzip"):
        p.add_argument(name, action="store_true")
    form = p.add_mutually_exclusive_group()
    for name in ("--compact-counts", "--by-build"):
        form.add_argument(name, action="store_true")
    p = over_facts(command("dump", run_dump, "lock_points"))
    p.add_argument("--format", choices=["json", "columns"], default="columns")
    p.add_argument("--gzip", action="store_true")
    p = over_facts(command("remote", run_remote, "remote_calls"))
    p.add_argument("--closed-world", action="store_true")
    p = over_facts(command("index", run_index, "lock_index"))
    for name, default in (("--max-depth", 8), ("--order-depth", 3)):
        p.add_argument(name, type=int, default=default)
    p = command("ask", run_ask, None, "folder of an index")
    for name in ("--at", "--method", "--lock"):
        p.add_argument(name, action="append")
    for name in ("--cycles", "--remote", "--json"):
        p.add_argument(name, action="store_true")
    p.add_argument("--depth", type=int, default=4)
    p = over_facts(command("races", run_races, "races"))
    p.add_argument("--min-guarded", type=int, default=3)
    p.add_argument("--min-ratio", type=float, default=0.8)
    p.add_argument("--max-depth", type=int, default=8)
    p.add_argument("--shown-open", type=int, help="list so many unguarded accesses of a field at most; n_unguarded counts all")
    return top


def main(argv: list[str] | None = None) -> None:
    args = parser().parse_args(argv)
    args.run(SparkSession.builder.appName("holdfast").getOrCreate(), args)


if __name__ == "__main__":
    main()
