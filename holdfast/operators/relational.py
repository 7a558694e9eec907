"""Lookups, lattice aggregates and elections over any table, by column names."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.names import UNRESOLVED
from ..storage import parts_of


def merged_names(names: Column, unresolved: str = UNRESOLVED) -> Column:
    """An array of names as one sorted text, or the mark for none."""
    text = F.array_join(F.array_sort(F.array_distinct(names)), ", ")
    return F.when(F.size(F.coalesce(names, F.array().cast("array<string>"))) == 0, unresolved).otherwise(text)


def all_same(left: DataFrame, right: DataFrame, columns: list[str]) -> Column:
    """Equal in all columns, nulls too."""
    out = F.lit(True)
    for c in columns:
        out = out & left[c].eqNullSafe(right[c])
    return out


def lookup(asked: DataFrame, index: DataFrame, on: list[str], line: str, name: str, fuzz: int = 0, sole: bool = False, residual: Column | None = None, paths: tuple[str, str] | None = None) -> DataFrame:
    """All names at each asked place: at the exact line, else at the nearest line within `fuzz`, else the
    one name of the key if it has just one and `sole` is set.

    `asked` has distinct places (key columns and line). Lines meet in ranges of fuzz + 1, a place asks its own and the two
    beside it, so a key with many lines isn't joined with all that ask for it. Sole names come from the
    distinct names of each key. `residual` is a further condition on columns of `asked`, aliased q, and `index`, aliased x, and
    reads the two columns named in `paths`. Ties in distance go to the lower line.
    """
    width, holds = fuzz + 1, F.lit(True) if residual is None else residual
    range_of = F.floor(F.col(line) / width)
    near = F.explode(F.array(*[range_of + i for i in ((-1, 0, 1) if fuzz else (0,))]))
    q, x = asked.withColumn("_range", near).alias("q"), index.withColumn("_range", range_of).alias("x")
    away = F.abs(F.col(f"x.{line}") - F.col(f"q.{line}"))
    match = holds & (away <= fuzz)
    for c in (*on, "_range"):
        match = match & (F.col(f"q.{c}") == F.col(f"x.{c}"))
    rows = q.join(x, match).select(*[F.col(f"q.{c}").alias(c) for c in asked.columns], F.struct(away.alias("away"), F.col(f"x.{line}").alias("at")).alias("_spot"), F.col(f"x.{name}").alias("_name"))
    rows = rows.groupBy(*asked.columns, "_spot").agg(F.collect_set("_name").alias("_names"))
    found = rows.groupBy(*asked.columns).agg(F.min_by("_names", "_spot").alias("_names"))
    out = asked.join(found, all_same(asked, found, asked.columns), "left").select(*[asked[c] for c in asked.columns], "_names")
    if sole:
        mine, theirs = [*on, *([paths[0]] if paths else [])], [*on, *([paths[1]] if paths else [])]
        keys, known = asked.select(*mine).distinct().alias("q"), index.select(*theirs, name).distinct().alias("x")
        match = holds
        for c in on:
            match = match & (F.col(f"q.{c}") == F.col(f"x.{c}"))
        only = keys.join(known, match).select(*[F.col(f"q.{c}").alias(c) for c in mine], F.col(f"x.{name}").alias("_name"))
        only = only.groupBy(*mine).agg(F.min("_name").alias("_one"), F.max("_name").alias("_other")).where("_one = _other")
        out = out.join(only, all_same(out, only, mine), "left").select(*[out[c] for c in asked.columns], F.coalesce("_names", F.when(F.col("_one").isNotNull(), F.array("_one"))).alias("_names"))
    return out.select(*asked.columns, merged_names(F.col("_names")).alias("resolved"))


def meet(rows: DataFrame, by: list[str], value: str, top: Column) -> DataFrame:
    """Bottom < value < top: top if any row is, or if values differ; bottom without any value."""
    unlike = F.min(value) != F.max(value)
    tag = F.when(F.max(top.cast("int")) == 1, "top").when(unlike, "top").when(F.min(value).isNull(), "bottom").otherwise("value")
    out = rows.groupBy(*by).agg(tag.alias("tag"), F.min(value).alias("_value"))
    return out.select(*by, "tag", F.when(F.col("tag") == "value", F.col("_value")).alias(value))


def unique_or_null(rows: DataFrame, by: list[str], value: str) -> DataFrame:
    """The value of each key if it has a single one, else null. Minimum and maximum tell, in one shuffle."""
    return rows.groupBy(*by).agg(F.when(F.min(value) == F.max(value), F.min(value)).alias(value))


def must_intersection(sites: DataFrame, held: DataFrame, by: list[str], site: str, item: str, parts: int | None = None) -> DataFrame:
    """Items held at every site of a key. `sites` has all sites, also those that hold nothing.

    Repeats are taken out where a site's rows meet, in `parts` tasks: as many as the rows need, counted if not given. Only counts of
    sites meet by key, in part summed up before.
    """
    if parts is None:
        parts = parts_of(sites.sparkSession, max(sites.count(), held.count()))
    # Rows without a site count for nothing in the total.
    total = sites.select(*by, site).repartition(parts, site).distinct().groupBy(*by).agg(F.count(site).alias("_total"))
    seen = held.select(*by, site, item).repartition(parts, site).distinct().groupBy(*by, item).agg(F.count("*").alias("_seen"))
    return seen.join(total, by).where("_seen = _total").select(*by, item)


def first_wins(rows: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """The first row of each key, by a partial aggregate, so no key's rows need to meet in one task."""
    rest = [c for c in rows.columns if c not in key]
    best = F.min_by(F.struct(*rest), F.struct(*order)).alias("_best")
    return rows.groupBy(*key).agg(best).select(*key, *[F.col(f"_best.{c}").alias(c) for c in rest]).select(*rows.columns)


def elect(rows: DataFrame, by: list[str], candidate: str, least: int, ratio: float) -> DataFrame:
    """The most frequent candidate of each key (ties: the smallest), if it is frequent enough."""
    counts = rows.groupBy(*by, candidate).agg(F.count("*").alias("_n"))
    total = F.sum("_n").alias("total")
    best = F.max_by(F.struct(candidate, "_n"), F.struct(F.col("_n"), F.col("_rank"))).alias("_best")
    # Of equal counts the smallest name: names are ranked the other way round within the key.
    counts = counts.withColumn("_rank", -F.rank().over(Window.partitionBy(*by).orderBy(candidate)))
    out = counts.groupBy(*by).agg(best, total)
    out = out.select(*by, F.col(f"_best.{candidate}").alias(candidate), F.col("_best._n").alias("votes"), "total")
    return out.where((F.col("votes") >= least) & (F.col("votes") >= ratio * F.col("total")))


def argmin(rows: DataFrame, by: list[str], order: list[str], take: list[str]) -> DataFrame:
    """Count of each key and `take` of its least row."""
    best = F.min_by(F.struct(*take), F.struct(*order)).alias("_best")
    return rows.groupBy(*by).agg(F.count("*").alias("count"), best).select(*by, "count", *[F.col(f"_best.{c}").alias(c) for c in take])


def numbered(rows: DataFrame, order: list[str], name: str, first: int = 0, parts: int | None = None) -> DataFrame:
    """Adds consecutive numbers in the order of unique keys without sending all rows to one task.

    Rows are range-partitioned and sorted, once, in `parts` tasks (the session's number if not given); the partitions' sizes, one row
    each, give where each begins.
    """
    from ..storage import written

    parts = parts or int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # The number of a row within its sorted partition is in the low 33 bits.
    placed = rows.repartitionByRange(parts, *order).sortWithinPartitions(*order).withColumn("_place", F.monotonically_increasing_id())
    placed = written(placed, "placed")
    placed = placed.withColumn("_part", F.shiftright("_place", 33)).withColumn("_inside", F.col("_place").bitwiseAND(F.lit((1 << 33) - 1)))
    sizes = placed.groupBy("_part").agg(F.count("*").alias("_size"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.select("_part", F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_base"))
    return placed.join(F.broadcast(sizes), "_part").withColumn(name, F.col("_base") + F.col("_inside") + first).drop("_place", "_part", "_inside", "_base")


def dictionary(rows: DataFrame, order: str, columns: list[str]) -> DataFrame:
    """value and id: ids follow the first place of each value, row by row and column by column."""
    places = F.explode(F.array(*[F.struct(F.lit(i).alias("col"), F.col(c).alias("value")) for i, c in enumerate(columns)]))
    seen = rows.select(F.col(order).alias("_row"), places.alias("_p")).where("_p.value is not null")
    first = seen.groupBy(F.col("_p.value").alias("value")).agg(F.min(F.struct("_row", "_p.col")).alias("_first"))
    return numbered(first.select("value", "_first._row", "_first.col"), ["_row", "col"], "id", 1).select("value", F.col("id").cast("long"))


def inversions(edges: DataFrame) -> DataFrame:
    """Pairs of edges (a, b) and (b, a) with a < b; columns of the second have the prefix back_."""
    back = edges.select(*[F.col(c).alias(f"back_{c}") for c in edges.columns])
    return edges.where(F.col("from") < F.col("to")).join(back, (F.col("from") == F.col("back_to")) & (F.col("to") == F.col("back_from")))


def gates(pairs: DataFrame, held: DataFrame, key: list[str], site_a: str, site_b: str, site: str, item: str, apart: list[str]) -> DataFrame:
    """The least item held at both sites of a pair, other than the items named in its columns `apart`."""
    a = held.select(F.col(site).alias(site_a), F.col(item).alias("_item")).distinct()
    b = held.select(F.col(site).alias(site_b), F.col(item).alias("_item")).distinct()
    both = pairs.join(a, site_a).join(b, [site_b, "_item"])
    for c in apart:
        both = both.where(F.col("_item") != F.col(c))
    least = both.groupBy(*key).agg(F.min("_item").alias("gate"))
    return pairs.join(least, key, "left")


#: Rows of a key that one task pairs with all rows of that key on the other side, and pairs that one task makes, about.
BLOCK, PAIRS_EACH = 1_024, 8_000_000


def paired(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """All pairs of rows of equal `key`, where both sides may have many rows of a key.

    The right rows of a key are dealt to blocks of about BLOCK, and left rows are copied for each block of their key; blocks are dealt
    to as many tasks as the pairs need. So no task holds or makes all of a key, and what is shuffled are rows and never pairs.
    """
    from ..storage import is_written, written

    left, right = [rows if is_written(rows) else written(rows, "paired") for rows in (left, right)]
    sizes = left.groupBy(key).agg(F.count("*").alias("_left")).join(right.groupBy(key).agg(F.count("*").alias("_right")), key)
    sizes = written(sizes.withColumn("_blocks", F.ceil(F.col("_right") / BLOCK).cast("int")), "paired-sizes")
    pairs = sizes.agg(F.sum(F.col("_left") * F.col("_right"))).first()[0] or 0
    if pairs <= PAIRS_EACH:
        return left.join(right, key)
    n = parts_of(left.sparkSession, 0) + -(-pairs // PAIRS_EACH)
    blocks = sizes.select(key, "_blocks")
    dealt = right.join(blocks, key).withColumn("_block", F.pmod(F.xxhash64(*right.columns), F.col("_blocks")).cast("int")).drop("_blocks")
    copies = left.join(blocks, key).withColumn("_block", F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1))).drop("_blocks")
    # Tasks are told by pairs: by their bytes they would be merged to few.
    dealt = dealt.repartition(n, key, "_block").hint("shuffle_hash")
    return copies.repartition(n, key, "_block").join(dealt, [key, "_block"]).drop("_block")


def as_of(rows: DataFrame, marks: DataFrame, by: list[str], at: str, value: str) -> DataFrame:
    """For each row the value of the last mark at or before it, by one window over both."""
    both = rows.withColumn("_mark", F.lit(0)).withColumn("_value", F.lit(None).cast(marks.schema[value].dataType))
    more = marks.select(*by, at, F.col(value).alias("_value")).withColumn("_mark", F.lit(-1))
    both = both.unionByName(more, allowMissingColumns=True)
    before = Window.partitionBy(*by).orderBy(at, "_mark", "_value").rowsBetween(Window.unboundedPreceding, 0)
    seen = both.withColumn("_last", F.last("_value", ignorenulls=True).over(before))
    return seen.where("_mark = 0").select(*rows.columns, F.col("_last").alias(value))


def capped_fanout(calls: DataFrame, declarations: DataFrame, ancestors: DataFrame, cap: int) -> DataFrame:
    """Calls (call_id, class, sig) with all declarations (class, sig) of their signature at or below their class.

    Signatures with more than `cap` declarations are left out before the join, so it stays bounded.
    """
    few = declarations.groupBy("sig").count().where(F.col("count") <= cap).select("sig")
    below = ancestors.select(F.col("child").alias("target"), F.col("ancestor").alias("class"))
    mine = declarations.select(F.col("class").alias("target"), "sig").join(few, "sig", "left_semi")
    return calls.join(mine, "sig").join(below, ["target", "class"], "left_semi").select("call_id", "target").distinct()
