"""SimHash near-duplicates: exact comparison tile by tile, of tiles whose population counts can be near enough."""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .ngrams import components, united
from .passages import column
from .shared import join_groups, written
from .textkit import U64, blocks

#: Words of a shingle, seed of its hash, and bits in which linked fingerprints differ at most.
WORDS, SEED, RADIUS = 3, 42, 2
#: Fingerprints of a block, about: 32 KB.
BLOCK = 4096
#: Hashes whose bits are counted at once, bytes of a text that are split at once, and pairs compared at once.
HASHES, PIECE, PAIRS = 1 << 16, 1 << 20, 1 << 19
SPACE = re.compile(rb"[\x20\x09-\x0D]")


def shingles(text: bytes, k: int = WORDS):
    """Lists of the word shingles of a text, piece by piece; of fewer than k words the whole sequence, of none nothing."""
    kept: list[bytes] = []
    at, n = 0, 0
    while at < len(text):
        cut = SPACE.search(text, at + PIECE)
        end = cut.start() if cut else len(text)
        words = kept + text[at:end].lower().split()
        n += len(words) - len(kept)
        if len(words) >= k:
            yield [b" ".join(words[i : i + k]) for i in range(len(words) - k + 1)]
        kept = words[max(0, len(words) - k + 1) :] if k > 1 else []
        at = end
    if 0 < n < k:
        yield [b" ".join(kept)]


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text: str = "text", k: int = WORDS, seed: int = SEED) -> DataFrame:
    """id and fp: a bit of the 64 is set if it is in over half the XXH64 hashes of the shingles, repeats included.

    A-Z are lower-cased. A null text, like any without words, has the fingerprint zero.
    """

    def sign(batches):
        import xxhash

        digest = xxhash.xxh64_intdigest
        for batch in batches:
            for part, texts in blocks(batch, "text"):
                ones, totals = np.zeros((texts.n, 64), np.int64), np.zeros(texts.n, np.int64)
                hashes: list[int] = []
                owner: list[tuple[int, int]] = []

                def flush():
                    bits = np.unpackbits(np.array(hashes, "<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")  # noqa: B023
                    who, at = np.array(owner).T  # noqa: B023
                    np.add.at(ones, who, np.add.reduceat(bits, at, axis=0, dtype=np.int32))  # noqa: B023
                    np.add.at(totals, who, np.diff(np.append(at, len(bits))))  # noqa: B023

                for i in range(texts.n):
                    for piece in shingles(texts.text(i), k):
                        owner.append((i, len(hashes)))
                        hashes.extend([digest(x, seed) for x in piece])
                        if len(hashes) >= HASHES:
                            flush()
                            hashes, owner = [], []
                if hashes:
                    flush()
                fp = np.packbits(2 * ones > totals[:, None], axis=1, bitorder="little").view("<i8").reshape(-1)
                yield pa.RecordBatch.from_arrays([column(part, "id"), pa.array(fp)], ["id", "fp"])

    rows = docs.select(F.col(id_col).alias("id"), F.col(text).alias("text"))
    return rows.mapInArrow(sign, f"id {rows.schema['id'].dataType.simpleString()}, fp long")


def tile_parts(n: int) -> int:
    """Into how many parts fingerprints are cut, whose population counts name a tile.

    Fingerprints within the radius differ in these counts by the radius in all. For even bits, about 1 pair of
    65 is in tiles so near with 4 parts, 1 of 3,000 with 8, 1 of 2,000,000 with 16; more parts are more, smaller tiles.
    """
    return 4 if n <= 1 << 25 else 8 if n <= 1 << 35 else 16


def tile(fp: Column, parts: int) -> Column:
    """The counts of a fingerprint's parts as digits of one number; a digit leaves room, so a step never makes another tile's number."""
    size, digit = 64 // parts, step(parts)
    count = lambda i: F.bit_count(F.shiftrightunsigned(fp, i * size).bitwiseAND(F.lit((1 << size) - 1))).cast("long")
    return sum((count(i) * digit**i for i in range(1, parts)), count(0))


def step(parts: int) -> int:
    return {4: 32, 8: 16, 16: 8}[parts]


def near_tiles(parts: int, radius: int) -> list[int]:
    """Steps from a tile to those that can hold fingerprints within the radius: itself and one of each pair of opposite steps."""
    vectors = [()]
    for _ in range(parts):
        vectors = [(*v, x) for v in vectors for x in range(-radius, radius + 1) if sum(map(abs, v)) + abs(x) <= radius]
    steps = (sum(x * step(parts) ** i for i, x in enumerate(v)) for v in vectors)
    return sorted(s for s in steps if s >= 0)


def near_pairs(a: np.ndarray, b: np.ndarray, radius: int, alike: bool):
    """Pairs of fingerprints within the radius, strip by strip, each strip as a forest of its links."""
    strip = max(1, PAIRS // max(1, len(b)))
    for i in range(0, len(a), strip):
        x, y = np.nonzero(np.bitwise_count(a[i : i + strip, None] ^ b[None, :]) <= radius)
        if alike:
            x, y = x[x + i < y], y[x + i < y]
        if len(x):
            node, root = united(a[i + x].view(np.int64), b[y].view(np.int64))
            far = node != root
            yield root[far], node[far]


def near_fingerprints(prints: DataFrame, radius: int = RADIUS, parts: int | None = None, block: int = BLOCK) -> DataFrame:
    """Edges a, b between fingerprints (distinct, column fp) that join what differs in `radius` bits or fewer.

    Fingerprints with equal counts are a tile, in blocks of about `block`. Blocks of tiles near enough meet, two in a row,
    each pair once, and are compared in full by exclusive-or and bit counts; pairs of blocks are dealt to all tasks, so a tile
    that holds a third of all fingerprints is shared among them. What is returned is a forest for each strip, not all links.
    """
    if parts is None:
        parts = tile_parts(prints.count())
    named = prints.select("fp", tile(F.col("fp"), parts).alias("tile"))
    tiles = named.groupBy("tile").agg(F.count("*").alias("n")).withColumn("n_blocks", F.ceil(F.col("n") / block).cast("long"))
    tiles = written(tiles, "simhash-tiles")
    own = join_groups(named, tiles, "tile", "n").withColumn("block", F.pmod(F.xxhash64("fp"), "n_blocks"))
    held = written(own.groupBy("tile", "block").agg(F.collect_list("fp").alias("fps")), "simhash-blocks")
    pairs = tiles.select("tile", "n_blocks", F.explode(F.array(*map(F.lit, near_tiles(parts, radius)))).alias("step"))
    pairs = pairs.withColumn("other", F.col("tile") + F.col("step"))
    pairs = pairs.join(tiles.select(F.col("tile").alias("other"), F.col("n_blocks").alias("n_others")), "other")
    pairs = pairs.withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n_blocks") - 1)))
    least = F.when(F.col("step") == 0, F.col("block")).otherwise(0)
    pairs = pairs.select("tile", "block", "other", F.explode(F.sequence(least, F.col("n_others") - 1)).alias("other_block"))
    met = pairs.join(held, ["tile", "block"])
    met = met.join(held.select(F.col("tile").alias("other"), F.col("block").alias("other_block"), F.col("fps").alias("others")), ["other", "other_block"])
    alike = ((F.col("tile") == F.col("other")) & (F.col("block") == F.col("other_block"))).alias("alike")

    def compare(batches):
        for batch in batches:
            low, high = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
            sides = [(x.values.to_numpy().view(U64), x.offsets.to_numpy()) for x in (batch.column(0), batch.column(1))]
            (a, a_at), (b, b_at) = sides
            for i, same in enumerate(batch.column(2).to_pylist()):
                for x, y in near_pairs(a[a_at[i] : a_at[i + 1]], b[b_at[i] : b_at[i + 1]], radius, same):
                    low.append(x)
                    high.append(y)
            edges = np.unique(np.stack([np.concatenate(low), np.concatenate(high)], 1), axis=0)
            yield pa.RecordBatch.from_arrays([pa.array(edges[:, 0].copy()), pa.array(edges[:, 1].copy())], ["a", "b"])

    return met.select("fps", "others", alike).mapInArrow(compare, "a long, b long").distinct()


def simhash_groups(docs: DataFrame, id_col: str = "doc_id", text: str = "text", radius: int = RADIUS, parts: int | None = None, block: int = BLOCK) -> DataFrame:
    """For each row: id, fp, component_id (the least id of the rows reachable by links, itself included).

    Rows of one fingerprint are one node, however many they are. Texts without words, null ones too, have the
    fingerprint zero and are linked like any other. A null id is a row like others, but never the least; a component
    of null ids alone has a null component_id. Repeated rows are linked; other columns are ignored; an empty table gives an empty one.
    """
    rows = written(fingerprints(docs, id_col, text), "fingerprints")
    prints = written(rows.groupBy("fp").agg(F.min("id").alias("least"), F.count("*").alias("n_rows")), "distinct-fingerprints")
    label = components(near_fingerprints(prints.select("fp"), radius, parts, block))
    nodes = prints.join(label.withColumnRenamed("node", "fp").hint("merge"), "fp", "left").withColumn("label", F.coalesce("label", "fp"))
    nodes = written(nodes, "fingerprint-labels")
    classes = written(nodes.groupBy("label").agg(F.min("least").alias("component_id"), F.count("*").alias("n_prints")), "fingerprint-classes")
    named = written(join_groups(nodes.select("fp", "n_rows", "label"), classes, "label", "n_prints").select("fp", "n_rows", "component_id"), "fingerprint-components")
    return join_groups(rows, named, "fp", "n_rows").select(F.col("id").alias(id_col), "fp", "component_id")
