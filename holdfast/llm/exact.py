"""Exact deduplication by content-defined chunk recipes, in DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import free_name, join_groups, written

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def chunk_pattern(least: int, most: int) -> str:
    """A chunk ends at the first sentence or line end after `least` characters, or at `most`."""
    return rf"(?s).{{{least - 1},{most - 1}}}?[.!?\n]|.{{1,{most}}}"


def chunk_recipes(docs: DataFrame, text: str = "text", least: int = 1024, most: int = 4096) -> DataFrame:
    """Adds `recipe`, the ordered identifiers of the chunks of `text` (null: empty, so no chunks).

    Boundaries depend on the content alone. Each distinct chunk crosses the shuffle once a map
    task, to its hash; there it is verified that one hash names one chunk. Chunks whose hash names
    several get the rank among these appended, so equal identifiers always mean equal chunks.
    """
    chunks = F.regexp_extract_all(F.coalesce(F.col(text), F.lit("")), F.lit(chunk_pattern(least, most)), F.lit(0))
    exploded = docs.select(F.explode(chunks).alias("chunk")).withColumn("hash", F.xxhash64("chunk"))
    by_hash = exploded.groupBy("hash").agg(F.min("chunk").alias("low"), F.max("chunk").alias("high"))
    clashing = written(by_hash.where("low <> high").select("hash"), "chunk-clashes")
    if clashing.isEmpty():
        return docs.withColumn("recipe", F.transform(chunks, lambda c: F.xxhash64(c)))
    # The rare way: only chunks with a clashing hash are ranked and looked up.
    named = exploded.join(clashing, "hash", "left_semi").distinct()
    named = named.withColumn("rank", F.row_number().over(Window.partitionBy("hash").orderBy("chunk")))
    at = docs.withColumn("_row", F.monotonically_increasing_id())
    at = written(at, "chunk-rows")
    parts = at.select("_row", F.posexplode(chunks).alias("_at", "chunk")).withColumn("hash", F.xxhash64("chunk"))
    parts = parts.join(named, ["hash", "chunk"], "left")
    ids = F.concat_ws("-", F.col("hash").cast("string"), F.col("rank").cast("string"))
    lists = parts.groupBy("_row").agg(F.sort_array(F.collect_list(F.struct("_at", ids.alias("id")))).alias("_ids"))
    return at.join(lists, "_row", "left").withColumn(
        "recipe", F.coalesce(F.transform("_ids", lambda x: x["id"]), F.array().cast("array<string>"))
    ).drop("_row", "_ids")


def exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text: str = "text", least: int = 1024, most: int = 4096) -> DataFrame:
    """Groups rows whose texts are equal after lower-casing A-Z; of a group the largest id stays.

    Returns a row for each row: id, keep_id, group_size, kept, text_sha256. A null text counts as
    empty, so null and empty texts are one group. A null id is below all others. If rows repeat
    the largest id of a group, one of them stays. Other columns are ignored, an empty table gives
    an empty result.
    """
    normal = F.translate(F.coalesce(F.col(text), F.lit("")), UPPER, LOWER)
    rows = chunk_recipes(docs.select(F.col(id_col).alias("id"), normal.alias("normal")), "normal", least, most)
    rows = rows.select("id", F.sha2(F.encode("normal", "UTF-8"), 256).alias("sha"), "recipe")
    rows = written(rows.withColumn("row", F.monotonically_increasing_id()), "recipes")
    best = F.max(F.struct("id", "row")).alias("best")
    groups = written(rows.groupBy("recipe").agg(best, F.count("*").alias("group_size")), "recipe-groups")
    out = join_groups(rows, groups, "recipe", "group_size")
    return out.select(
        F.col("id").alias(id_col),
        F.col("best.id").alias("keep_id"),
        "group_size",
        (F.col("row") == F.col("best.row")).alias("kept"),
        F.col("sha").alias("text_sha256"),
    )


def without_copies(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of `docs` that stay, with all their columns. Of rows that repeat both, one stays."""
    sha = F.sha2(F.encode(F.translate(F.coalesce(F.col(text), F.lit("")), UPPER, LOWER), "UTF-8"), 256)
    found = exact_duplicates(docs, id_col, text)
    best = found.where(F.col(id_col).eqNullSafe(F.col("keep_id")))
    best = best.groupBy(F.col(id_col).alias("id"), F.col("text_sha256").alias("sha")).agg(F.count("*").alias("n"))
    best = written(best, "exact-kept")
    own = free_name(docs, "sha")
    rows = docs.withColumn(own, sha)
    out = rows.alias("rows").join(best.alias("best"), F.col(f"rows.{id_col}").eqNullSafe(F.col("best.id")) & (F.col(f"rows.{own}") == F.col("best.sha")), "left_semi")
    if not best.where("n > 1").isEmpty():
        out = out.dropDuplicates([id_col, own])
    return out.drop(own)
