"""Line deduplication: an exact set-similarity join by prefix, length and position."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .ngrams import components
from .passages import ROWS, column, integers, keyed, new_keys, packed, rows_of, unpacked
from .shared import join_checked, tasks, written
from .textkit import BLOCK, U64, Texts, blocks, mixed

SIMILARITY = 0.8
#: Counts of hashed words: a fixed number whatever the input.
COUNTERS = 1 << 20
#: Prefix entries that a task holds before it sends them; pairs looked at in one go, and words of these.
HELD, PAIRS, PAIR_WORDS = 1 << 19, 1 << 18, 1 << 21
#: Words of the input for each part of the entries, about; entries of a part that are in memory at once.
PART_WORDS, MOST = 1 << 22, 1 << 20
#: Words of the lines that are verified together.
VERIFIED = 1 << 19
#: Words from which a set has a sketch of 256 bits: 64 say little about larger sets.
LONG = 64
#: A word's number: so many bits of its digest below those of its rarity.
HASH_BITS, RARITY_BITS = 59, 5

ENTRY = np.dtype([("key", "<u8"), ("set", "<u8"), ("other", "<u8"), ("sketch", "<u8"), ("doc", "<i8"), ("tie", "<i8"), ("line", "<u4"), ("n", "<u4"), ("at", "<u4"), ("wide", "<u8", (3,))])


def least_overlap(total: np.ndarray, similarity: float) -> np.ndarray:
    """Shared tokens that two sets of `total` tokens together need."""
    return np.ceil(similarity / (1 + similarity) * total - 1e-9).astype(np.int64)


@dataclass
class Lines:
    """A block's lines that have a word: distinct words, the rarest first, line by line; `digest` is their other 64 bits."""

    doc: np.ndarray
    line: np.ndarray
    at: np.ndarray
    token: np.ndarray
    digest: np.ndarray


def lines_of(texts: Texts, rarity: np.ndarray) -> Lines:
    texts.words()
    breaks = np.flatnonzero(texts.data == 10)
    # Lines are numbered over the block; each text begins one.
    number = np.searchsorted(breaks, texts.starts) + texts.word_doc
    first = np.searchsorted(breaks, texts.at[:-1]) + np.arange(texts.n)
    edge = new_keys(number) if len(number) else np.zeros(0, np.int64)
    doc = texts.word_doc[edge]
    line = number[edge] - first[doc]
    dense = np.zeros(len(number), np.int64)
    dense[edge] = 1
    dense = np.cumsum(dense) - 1
    digests = texts.word_digests()
    h = digests[:, 0]
    token = (rarity[(h >> U64(44)).astype(np.int64)].astype(U64) << U64(HASH_BITS)) | (h & U64((1 << HASH_BITS) - 1))
    # By line and word: both in one number, as far as they fit. Unlike words that agree so far are sorted in full.
    bits = U64(max(1, len(edge).bit_length()))
    both = (dense.astype(U64) << (U64(64) - bits)) | (token >> bits)
    order = np.argsort(both)
    again = np.zeros(len(order), bool)
    again[1:] = both[order[1:]] == both[order[:-1]]
    if (token[order[1:]] != token[order[:-1]])[again[1:]].any():
        order = np.lexsort((token, dense))
        again[1:] = (token[order[1:]] == token[order[:-1]]) & (dense[order[1:]] == dense[order[:-1]])
    order = order[~again]
    return Lines(doc, line, np.searchsorted(dense[order], np.arange(len(edge) + 1)), token[order], digests[order, 1])


def word_rarity(rows: DataFrame) -> tuple[np.ndarray, int]:
    """The binary logarithm of the number of occurrences of each hashed word, over all texts; and of all words."""

    def count(batches):
        counts = np.zeros(COUNTERS, np.int64)
        for batch in batches:
            for _, texts in blocks(batch, "text"):
                texts.words()
                counts += np.bincount((texts.word_hashes() >> U64(44)).astype(np.int64), minlength=COUNTERS)
        at = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(counts[at])], ["word", "n"])

    # Each task sums its rows before the shuffle; the driver gets a row for each counter in use, so a fixed number.
    sums = rows.select("text").mapInArrow(count, "word long, n long").groupBy("word").agg(F.sum("n").alias("n")).toArrow()
    counts = np.zeros(COUNTERS, np.int64)
    counts[sums.column("word").to_numpy()] = sums.column("n").to_numpy()
    return np.minimum(np.log2(counts + 1).astype(np.uint8), 31), int(counts.sum())


SET = np.dtype([("set", "<u8"), ("other", "<u8"), ("sketch", "<u8"), ("doc", "<i8"), ("tie", "<i8"), ("line", "<u4"), ("n", "<u4"), ("wide", "<u8", (3,)), ("prefix", "<u4")])


def prefix_sets(lines: Lines, doc: np.ndarray, tie: np.ndarray, similarity: float) -> tuple[np.ndarray, np.ndarray]:
    """A row for each line, and the words of all their prefixes one after the other."""
    n = np.diff(lines.at)
    if not len(n):
        return np.zeros(0, SET), np.zeros(0, U64)
    out = np.zeros(len(n), SET)
    # Sums over the words, of 64 bits of their digests and of the other 64: sets that agree in both, and in their size, count as equal.
    out["set"] = np.add.reduceat(mixed(lines.token), lines.at[:-1])
    out["other"] = np.add.reduceat(mixed(lines.digest), lines.at[:-1])
    own = mixed(lines.token ^ U64(0x5555555555))
    bit, quarter = U64(1) << (own >> U64(58)), (own >> U64(56)) & U64(3)
    out["sketch"] = np.bitwise_xor.reduceat(bit, lines.at[:-1])
    for i in range(3):
        out["wide"][:, i] = np.where(n >= LONG, np.bitwise_xor.reduceat(np.where(quarter == i, bit, U64(0)), lines.at[:-1]), U64(0))
    prefix = n - np.ceil(similarity * n - 1e-9).astype(np.int64) + 1
    out["doc"], out["tie"], out["line"], out["n"], out["prefix"] = doc[lines.doc], tie[lines.doc], lines.line, n, prefix
    return out, lines.token[np.repeat(lines.at[:-1], prefix) + places(prefix)]


def places(counts: np.ndarray) -> np.ndarray:
    """0, 1, ... for each count."""
    return np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)


def prefix_entries(sets: np.ndarray, tokens: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """An entry for each prefix word of each distinct set, at its earliest place; and the later places."""
    counts = sets["prefix"].astype(np.int64)
    begin = np.cumsum(counts) - counts
    order = np.lexsort((sets["line"], sets["tie"], sets["doc"], sets["other"], sets["set"]))
    sorted_sets = sets[order]
    at = new_keys(sorted_sets["set"], sorted_sets["other"], sorted_sets["n"])
    rep = np.repeat(at, np.diff(np.append(at, len(order))))
    later = sorted_sets[(sorted_sets["doc"] != sorted_sets["doc"][rep]) | (sorted_sets["tie"] != sorted_sets["tie"][rep]) | (sorted_sets["line"] != sorted_sets["line"][rep])]
    own, counts, begin = sorted_sets[at], counts[order[at]], begin[order[at]]
    spot = places(counts)
    e = np.zeros(len(spot), ENTRY)
    e["key"], e["at"] = tokens[np.repeat(begin, counts) + spot], spot
    for n in ("set", "other", "sketch", "doc", "tie", "line", "n", "wide"):
        e[n] = np.repeat(own[n], counts, axis=0)
    # Zeros of short sets beside each other pack well.
    return e[np.argsort(e["n"], kind="stable")], later


def collapsed(e: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of equal sets under a key the earliest stays; and the later ones (told at the first word only)."""
    c = {n: np.ascontiguousarray(e[n]) for n in ("line", "tie", "doc", "other", "set", "n", "key")}
    e = e[np.lexsort(tuple(c.values()))]
    at = new_keys(e["key"], e["n"], e["set"], e["other"])
    rep = np.repeat(at, np.diff(np.append(at, len(e))))
    later = ((e["doc"] != e["doc"][rep]) | (e["tie"] != e["tie"][rep]) | (e["line"] != e["line"][rep])) & (e["at"] == 0)
    return e[at], e[later]


def meetings(key: np.ndarray, n: np.ndarray, at: np.ndarray, sketch: np.ndarray, side: np.ndarray, similarity: float, wide: np.ndarray | None = None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of entries under one key that pass the length, position and sketch filters, a bounded number at a time.

    Entries are sorted by key and then by n, the words of the set; `at` is the key's place among these. Those of side 2 meet all
    others, those of sides 0 and 1 only each other. `sketch` is the sum of a wide sketch's quarters, `wide` three of these.
    """
    group = np.zeros(len(key), np.int64)
    group[new_keys(key)] = 1
    n, rest = n.astype(np.int64), n.astype(np.int64) - at
    code = np.cumsum(group) << 32
    reach = np.searchsorted(code + n, code + np.floor(n / similarity + 1e-9).astype(np.int64), "right")
    count = reach - np.arange(len(key)) - 1
    total, i, skipped = np.concatenate([[0], np.cumsum(count)]), 0, 0
    while i < len(key):
        # An entry that meets more than PAIRS others does so in several goes.
        j = max(i + 1, int(np.searchsorted(total, total[i] + PAIRS, "right")) - 1)
        if j == i + 1:
            b = i + 1 + np.arange(skipped, min(int(count[i]), skipped + PAIRS))
            a = np.full(len(b), i)
            skipped += PAIRS
            if skipped >= count[i]:
                i, skipped = j, 0
        else:
            a = np.repeat(np.arange(i, j), count[i:j])
            b = a + 1 + places(count[i:j])
            i = j
        need = least_overlap(n[a] + n[b], similarity)
        # What the sets can share from this word on, if they share none before.
        good = np.minimum(rest[a], rest[b]) >= need
        a, b, need = a[good], b[good], need[good]
        good = np.bitwise_count(sketch[a] ^ sketch[b]) <= n[a] + n[b] - 2 * need
        good &= (side[a] != side[b]) | (side[a] == 2)
        if wide is not None:
            two = np.flatnonzero(good & (np.minimum(n[a], n[b]) >= LONG))
            x, y = a[two], b[two]
            quarters = wide[x] ^ wide[y]
            last = sketch[x] ^ sketch[y] ^ quarters[:, 0] ^ quarters[:, 1] ^ quarters[:, 2]
            differ = np.bitwise_count(quarters).sum(1, dtype=np.int64) + np.bitwise_count(last)
            good[two] = differ <= n[x] + n[y] - 2 * need[two]
        yield a[good], b[good]


def forest(e: np.ndarray, side: np.ndarray, similarity: float) -> np.ndarray:
    """For each entry the least entry that meetings join it to, itself if there are none."""
    label = np.arange(len(e))
    columns = [np.ascontiguousarray(e[name]) for name in ("key", "n", "at", "sketch")]
    for a, b in meetings(*columns, side, similarity, e["wide"]):
        while True:
            x, y = label[a], label[b]
            apart = x != y
            if not apart.any():
                break
            a, b, x, y = a[apart], b[apart], x[apart], y[apart]
            np.minimum.at(label, np.maximum(x, y), np.minimum(x, y))
            up = label[label]
            while (up != label).any():
                label, up = up, up[up]
    return label


MET = "kind string, node long, other long, doc long, tie long, line long, n long, entries binary"


def met(kind: str, n_rows: int, **columns) -> pa.RecordBatch:
    schema = pa.schema([(f.split()[0], {"string": pa.string(), "long": pa.int64(), "binary": pa.binary()}[f.split()[1]]) for f in MET.split(", ")])
    columns["kind"] = [kind] * n_rows
    each = [pa.array(columns[f.name], f.type) if f.name in columns else pa.nulls(n_rows, f.type) for f in schema]
    return pa.RecordBatch.from_arrays(each, schema=schema)


def places_of(e: np.ndarray) -> dict:
    return {name: e[name].astype(np.int64) for name in ("doc", "tie", "line")}


class Bucket:
    """The entries of a part as they come in, of which `most` are held, and what is found among them.

    Keys with so many distinct sets that they don't fit are put off: their entries are given back.
    """

    def __init__(self, similarity: float, most: int):
        self.similarity, self.most, self.limit = similarity, most, most
        self.held, self.sides, self.size, self.hot = [], [], 0, np.zeros(0, U64)

    def add(self, e: np.ndarray, side: int | None = None) -> Iterator[pa.RecordBatch]:
        """`side` tells which of two blocks of a key that was put off the entries are of; such keys fit."""
        if len(self.hot):
            put_off = np.isin(e["key"], self.hot)
            yield from self.later(e[put_off])
            e = e[~put_off]
        self.held.append(e)
        self.sides.append(np.full(len(e), 2 if side is None else side, np.uint8))
        self.size += len(e)
        if side is None and self.size > self.limit:
            e, equal = collapsed(np.concatenate(self.held))
            yield met("line", len(equal), **places_of(equal))
            at = new_keys(e["key"])
            counts = np.diff(np.append(at, len(e)))
            large = counts > self.most // 4
            self.hot = np.union1d(self.hot, e["key"][at[large]])
            many = np.repeat(large, counts)
            yield from self.later(e[many])
            e = e[~many]
            self.held, self.sides, self.size = [e], [np.full(len(e), 2, np.uint8)], len(e)
            self.limit = max(self.most, 2 * self.size)

    def later(self, e: np.ndarray) -> Iterator[pa.RecordBatch]:
        e = e[np.argsort(e["key"], kind="stable")]
        for x in np.split(e, new_keys(e["key"])[1:]) if len(e) else []:
            yield met("hot", 1, node=x["key"][:1].view(np.int64), n=[len(x)], entries=[packed(x)])

    def done(self) -> Iterator[pa.RecordBatch]:
        e, side = np.concatenate(self.held), np.concatenate(self.sides)
        if (side == 2).all():
            e, equal = collapsed(e)
            yield met("line", len(equal), **places_of(equal))
            side = np.full(len(e), 2, np.uint8)
        else:
            order = np.lexsort((e["n"], e["key"]))
            e, side = e[order], side[order]
        label = forest(e, side, self.similarity)
        far = np.flatnonzero(label != np.arange(len(e)))
        pairs = np.unique(np.stack([e["set"][far], e["set"][label[far]]], 1), axis=0).view(np.int64)
        yield met("edge", len(pairs), node=pairs[:, 0], other=pairs[:, 1])
        active = e[np.union1d(far, label[far])]
        active = active[np.lexsort((active["line"], active["tie"], active["doc"]))]
        active = active[new_keys(active["doc"], active["tie"], active["line"])]
        yield met("active", len(active), node=np.ascontiguousarray(active["set"]).view(np.int64), n=active["n"].astype(np.int64), **places_of(active))


def meet(similarity: float, most: int):
    """Streams entries, sorted by part, through a Bucket for each part; lines that are settled pass."""

    def each(batches):
        now, bucket = None, None
        for batch in batches:
            columns = [column(batch, name).to_pylist() for name in ("kind", "part", "a", "b", "c")]
            for kind, part, a, b, c in zip(*columns, strict=True):
                if kind == "line":
                    doc, tie, line = unpacked(a, "<i8"), unpacked(b, "<i8"), unpacked(c, "<u4").astype(np.int64)
                    yield met("line", len(doc), doc=doc, tie=tie, line=line)
                    continue
                if bucket is None or part != now:
                    if bucket:
                        yield from bucket.done()
                    now, bucket = part, Bucket(similarity, most)
                yield from bucket.add(unpacked(a, ENTRY), None if kind == "entry" else int(kind))
        if bucket:
            yield from bucket.done()

    return each


def dealt_again(hot: DataFrame, n_parts: int, most: int) -> DataFrame:
    """Entries of the keys that were put off, dealt to pairs of blocks; equal sets are in one block.

    A block has about an eighth of `most` entries, so both blocks of a pair fit. A key of b blocks has its entries in b pairs.
    """
    blocks_of = hot.groupBy("node").agg(F.ceil(F.sum("n") / max(1, most // 8)).alias("n_blocks"))
    rows = join_checked(hot.select("node", "entries"), written(blocks_of, "line-hot-keys"), "node")

    def deal(batches):
        for batch in batches:
            for blob, n in zip(column(batch, "entries").to_pylist(), column(batch, "n_blocks").to_pylist(), strict=True):
                e = unpacked(blob, ENTRY)
                block = (mixed(e["set"]) % U64(n)).astype(np.int64)
                for i in np.unique(block).tolist():
                    mine = e[block == i]
                    for j in range(n):
                        # The pair is the key, so that pairs that share a part stay apart.
                        low, high = min(i, j), max(i, j)
                        copy = mine.copy()
                        copy["key"] = mixed(mine["key"] + mixed(np.full(len(mine), low * n + high, U64)))
                        part = int(mixed(copy["key"][:1])[0] >> U64(33)) % n_parts
                        yield rows_of("2" if low == high else str(int(i == high)), np.full(len(copy), part), [copy])

    return rows.select("entries", "n_blocks").mapInArrow(deal, ROWS)


def words_of_lines(data: bytes, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct word hashes of each line and the line each is of, a block of lines at a time."""
    at = np.concatenate([[0], np.cumsum(sizes.astype(np.int64))])
    raw, tokens, lines, i = np.frombuffer(data, np.uint8), [np.zeros(0, U64)], [np.zeros(0, np.int64)], 0
    while i < len(sizes):
        j = max(i + 1, int(np.searchsorted(at, at[i] + BLOCK, "right")) - 1)
        texts = Texts(raw[at[i] : at[j]], at[i : j + 1] - at[i])
        texts.words()
        token, of = texts.word_hashes(), texts.word_doc
        order = np.lexsort((token, of))
        order = order[new_keys(of[order], token[order])]
        tokens.append(token[order])
        lines.append(of[order] + i)
        i = j
    return np.concatenate(tokens), np.concatenate(lines)


def overlaps(code: np.ndarray, at: np.ndarray, n_words: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """How many words lines a and b share, pair by pair; `code` has line * n_words + word, sorted, and a line's begin at `at`."""
    size = at[a + 1] - at[a]
    pair = np.repeat(np.arange(len(a)), size)
    wanted = code[np.repeat(at[a], size) + places(size)] + (b - a)[pair] * n_words
    spot = np.minimum(np.searchsorted(code, wanted), len(code) - 1)
    return np.bincount(pair[code[spot] == wanted], minlength=len(a))


def similar_to_earlier(group: np.ndarray, rank: np.ndarray, side: np.ndarray, token: np.ndarray, of: np.ndarray, similarity: float) -> np.ndarray:
    """Which lines have a similar one of lower rank in their group, found by the prefix filter and verified on all words.

    `token` are the distinct word hashes of the lines `of`. A line that has one found takes part in no more checks as the later
    one. Of sides 0 and 1 only lines of side 1 ask, and lines of side 0 answer.
    """
    n_lines = len(group)
    _, word, counts = np.unique(token, return_inverse=True, return_counts=True)
    n_words = max(1, len(counts))
    # Numbers that grow with the frequency: a line's words in order are the rarest first.
    place = np.empty(len(counts), np.int64)
    place[np.argsort(counts, kind="stable")] = np.arange(len(counts))
    code = np.sort(of * n_words + place[word])
    line = code // n_words
    at = np.searchsorted(line, np.arange(n_lines + 1))
    n = np.diff(at)
    bits = mixed((code % n_words).astype(U64) + U64(1))
    sketch = np.zeros(n_lines, U64)
    some = np.flatnonzero(n)
    if len(some):
        sketch[some] = np.bitwise_xor.reduceat(U64(1) << (bits >> U64(58)), at[some])
    prefix = np.where(n > 0, n - np.ceil(similarity * n - 1e-9).astype(np.int64) + 1, 0)
    who, spot = np.repeat(np.arange(n_lines), prefix), places(prefix)
    key = group[who] * n_words + code[at[who] + spot] % n_words
    order = np.lexsort((n[who], key))
    who, spot, key = who[order], spot[order], key[order]
    found = np.zeros(n_lines, bool)

    def check(late: np.ndarray, early: np.ndarray) -> None:
        bounds = np.concatenate([[0], np.cumsum(n[late])])
        i = 0
        while i < len(late):
            j = max(i + 1, int(np.searchsorted(bounds, bounds[i] + PAIR_WORDS, "right")) - 1)
            a, b = late[i:j], early[i:j]
            shared = overlaps(code, at, n_words, a, b)
            found[a[shared >= similarity * (n[a] + n[b] - shared) - 1e-9]] = True
            i = j

    for x, y in meetings(key, n[who], spot, sketch[who], side[who], similarity):
        x, y = who[x], who[y]
        late, early = np.where(rank[x] > rank[y], x, y), np.where(rank[x] > rank[y], y, x)
        open_ = ~found[late] & (side[late] != 0)
        late, early = late[open_], early[open_]
        # Each line's earliest first, then the others of those that are still open.
        order = np.lexsort((rank[early], late))
        late, early = late[order], early[order]
        first = new_keys(late)
        check(late[first], early[first])
        rest = ~found[late]
        rest[first] = False
        check(late[rest], early[rest])
    return found


def verified(sets: DataFrame, n_parts: int, similarity: float) -> DataFrame:
    """From label, block, n_blocks, doc, tie, line, text and side: which lines are similar to an earlier one of their block."""

    def verify(table: pa.Table) -> pa.Table:
        table = table.sort_by([(name, "ascending") for name in ("label", "block", "doc", "tie", "line")])
        get = lambda name: table.column(name).to_numpy()
        at = np.append(new_keys(get("label"), get("block")), table.num_rows)
        raw = [x.encode() for x in table.column("text").to_pylist()]
        size = np.concatenate([[0], np.cumsum([len(x) for x in raw])])[at]
        side, found, i = get("side"), [np.zeros(0, bool)], 0
        while i < len(at) - 1:
            # Whole groups, about a BLOCK of text at a time.
            j = max(i + 1, int(np.searchsorted(size, size[i] + BLOCK, "right")) - 1)
            own = slice(at[i], at[j])
            group = np.repeat(np.arange(j - i), np.diff(at[i : j + 1]))
            token, of = words_of_lines(b"".join(raw[own]), np.array([len(x) for x in raw[own]], np.int64))
            found.append(similar_to_earlier(group, np.arange(len(group)), side[own], token, of, similarity))
            i = j
        return table.select(["label", "block", "n_blocks", "doc", "tie", "line"]).append_column("similar", pa.array(np.concatenate(found)))

    part = F.pmod(F.xxhash64("label", "block"), F.lit(n_parts))
    schema = "label long, block long, n_blocks long, doc long, tie long, line long, similar boolean"
    return sets.groupBy(part.alias("part")).applyInArrow(verify, schema)


def similar_lines(rows: DataFrame, found: DataFrame, similarity: float, verified_words: int = VERIFIED) -> DataFrame:
    """doc, tie and line of the lines that are similar to an earlier one, of rows that `meet` gave.

    Lines that met are joined into components; each line's text goes to its component once, or to
    one block of a component that is large. What a block leaves open is asked of the other blocks.
    """
    spark = rows.sparkSession
    active = found.where("kind = 'active'").select("node", "doc", "tie", "line", "n").distinct()
    label = components(found.where("kind = 'edge'").select(F.col("node").alias("a"), F.col("other").alias("b")).distinct())
    active = written(active.join(label, "node"), "line-components")
    sizes = active.groupBy("label").agg(F.sum("n").alias("words"))
    large = sizes.where(F.col("words") > verified_words).select("label", F.ceil(F.col("words") / verified_words).alias("n_blocks"))
    active = join_checked(active, written(large, "line-large"), "label", "left").withColumn("n_blocks", F.coalesce("n_blocks", F.lit(1)).cast("long"))
    block = F.pmod(F.xxhash64("doc", "tie", "line"), "n_blocks").alias("block")
    wanted = active.groupBy("doc", "tie").agg(F.collect_list(F.struct("line", "label", "n_blocks", block)).alias("wanted"))
    # As many documents as there are near copies: merged at every size.
    texts = rows.select("doc", "tie", "text").join(wanted.hint("merge"), ["doc", "tie"])

    def fetch(batches):
        names = ["label", "block", "n_blocks", "doc", "tie", "line", "text"]
        for batch in batches:
            columns = [column(batch, name).to_pylist() for name in ("doc", "tie", "text", "wanted")]
            out = []
            for doc, tie, text, wanted in zip(*columns, strict=True):
                lines = text.split("\n")
                out += [(w["label"], w["block"], w["n_blocks"], doc, tie, w["line"], lines[w["line"]]) for w in wanted]
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64() if i < 6 else pa.string()) for i, x in enumerate(zip(*out, strict=True))] if out else [pa.array([], pa.int64())] * 6 + [pa.array([], pa.string())], names)

    schema = "label long, block long, n_blocks long, doc long, tie long, line long, text string"
    # Rows that repeat id and text ask for the same line.
    sets = written(texts.mapInArrow(fetch, schema).dropDuplicates(["doc", "tie", "line"]), "line-sets")
    n_parts = max(tasks(spark), int((active.agg(F.sum("n")).first()[0] or 0) // verified_words) * 2)
    first = written(verified(sets.withColumn("side", F.lit(2).cast("tinyint")), n_parts, similarity), "lines-verified")
    names = ["doc", "tie", "line"]
    out = first.where("similar").select(*names)
    open_ = first.where("n_blocks > 1 and not similar")
    if not open_.isEmpty():
        asked = sets.join(open_.select(*names), names)
        others = F.filter(F.sequence(F.lit(0).cast("long"), F.col("n_blocks") - 1), lambda b: b != F.col("block"))
        asked = asked.withColumn("block", F.explode(others)).withColumn("side", F.lit(1).cast("tinyint"))
        told = sets.where("n_blocks > 1").withColumn("side", F.lit(0).cast("tinyint"))
        out = out.unionByName(verified(told.unionByName(asked), n_parts, similarity).where("similar").select(*names))
    return out


def remove_similar_lines(docs: DataFrame, id_col: str = "doc_id", text: str = "text", similarity: float = SIMILARITY, most: int = MOST, verified_words: int = VERIFIED) -> DataFrame:
    """Removes each line whose set of words has a Jaccard similarity of `similarity` or more to an earlier line.

    Lines end at \\n; earlier is a smaller id, or an earlier line of the document; lines are judged on
    the input, so it doesn't matter whether the earlier one stays. Words are ordered by rarity (counted
    over all texts), a line's prefix are so many of its rarest words that similar lines share one. Lines
    meet under these words, equal sets (of equal size, and equal in two sums of 64 bits of their words' digests) as one; length, position of the word and a 64-bit sketch of the set
    drop most pairs. Pairs are never rows: a task joins the lines that meet to trees, the trees' components bring
    the lines' texts together, and there each line is verified against earlier ones until one is similar. A
    word with more distinct sets than `most` allows is dealt to pairs of blocks; a component of more than
    `verified_words` words to blocks, and only lines that find nothing in theirs are asked of others.

    Returns id, n_lines, n_removed, kept_sha256 (of the lines that stay, joined by \\n). Lines without
    words stay. A null text is empty and has one line. Null ids come first. Rows that repeat
    both id and text are one document; rows of one id with different texts are ordered by a hash of
    these. Other columns are ignored. Ids are integers.
    """
    rows = keyed(docs, id_col, text)
    spark = rows.sparkSession
    rarity, n_words = word_rarity(rows)
    n_parts = max(tasks(spark), n_words // PART_WORDS)
    rarity = spark.sparkContext.broadcast(rarity)  # COUNTERS bytes

    def walk(batches):
        held, size = [], 0

        def send():
            e, later = prefix_entries(*(np.concatenate(x) for x in zip(*held, strict=True)))
            if len(later):
                # They pass through whichever part; one for each batch of them.
                yield rows_of("line", np.full(len(later), int(later["doc"][0]) % n_parts), [later["doc"], later["tie"], later["line"]])
            yield rows_of("entry", (mixed(e["key"]) >> U64(33)).astype(np.int64) % n_parts, [e])

        for batch in batches:
            for part, texts in blocks(batch, "text"):
                held.append(prefix_sets(lines_of(texts, rarity.value), integers(part, "doc"), integers(part, "tie"), similarity))
                size += len(held[-1][1])
                if size >= HELD:
                    yield from send()
                    held, size = [], 0
        if size:
            yield from send()

    def by_part(rows: DataFrame) -> DataFrame:
        return rows.select("kind", "part", "a", "b", "c").repartition(n_parts, "part").sortWithinPartitions("part")

    found = written(by_part(rows.select("text", "doc", "tie").mapInArrow(walk, ROWS)).mapInArrow(meet(similarity, most), MET), "lines-met")
    hot = found.where("kind = 'hot'").select("node", "n", "entries")
    if not hot.isEmpty():
        again = by_part(dealt_again(hot, n_parts, most)).mapInArrow(meet(similarity, most), MET)
        found = found.where("kind <> 'hot'").unionByName(written(again, "lines-met"))
    names = ["doc", "tie", "line"]
    gone = found.where("kind = 'line'").select(*names).unionByName(similar_lines(rows, found, similarity, verified_words))
    gone = written(gone.groupBy("doc", "tie").agg(F.collect_set("line").alias("lines")), "lines-removed")

    def remove(batches):
        for batch in batches:
            for part, texts in blocks(batch, "text"):
                n_lines, n_removed, digests = [], [], []
                for i, x in enumerate(column(part, "lines").to_pylist()):
                    all_lines = texts.text(i).split(b"\n")
                    out = set(x or ())
                    n_lines.append(len(all_lines))
                    n_removed.append(len(out))
                    kept = b"\n".join([y for j, y in enumerate(all_lines) if j not in out]) if out else texts.text(i)
                    digests.append(hashlib.sha256(kept).hexdigest())
                yield pa.RecordBatch.from_arrays([column(part, "id"), pa.array(n_lines, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(digests, pa.string())], [id_col, "n_lines", "n_removed", "kept_sha256"])

    out = rows.join(gone.hint("merge"), ["doc", "tie"], "left").select("id", "text", "lines")
    return out.mapInArrow(remove, f"{id_col} long, n_lines long, n_removed long, kept_sha256 string")
