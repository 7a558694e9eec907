"""Repeated byte strings by sampled suffixes: splitters, local multikey sorts, neighbours compared."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .passages import Contexts, Items, Unit, compared, finished, keyed, new_keys, parts_for, removed_items, repeated_anchors, walk_contexts
from .textkit import U64, Texts, anchors, blocks, mixed, repeats

#: Bytes of a string that counts as a repeat, and of an anchor.
WINDOW, GRAM = 200, 32
#: Bytes by which suffixes are dealt to buckets, and contexts of a bucket, about.
LEADING, BUCKET = GRAM, 8_000
#: For the splitters: one document in so many, and suffixes, about.
SAMPLE_DOCS, SAMPLED = 64, 20_000


def byte_items(texts: Texts) -> Items:
    data, n = texts.data, len(texts.data)
    values = data.astype(U64) + U64(1)
    grams, have, power = values.copy(), 1, 0x2545F4914F6CDD1D
    while have < GRAM:
        m = max(0, n - have)
        grams[:m] = grams[:m] * U64(power) + grams[have : have + m]
        have, power = 2 * have, power * power % 2**64
    sizes = np.diff(texts.at)
    text = np.repeat(np.arange(texts.n), sizes)
    room = np.repeat(texts.at[1:], sizes) - np.arange(n)
    whole = room >= GRAM
    grams = np.where(whole, mixed(grams), U64(2**64 - 1))
    windows = room >= WINDOW
    least, chosen = anchors(grams, windows, WINDOW - GRAM + 1)
    place = np.arange(n)
    return Items(texts.at, text, values, grams, least, windows, chosen & whole, place, place + 1)


BYTES = Unit(byte_items, WINDOW, GRAM)


def leading(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The first LEADING bytes from each place, zeros after the end, as numbers that sort like them: the whole anchor."""
    padded = np.append(data, np.zeros(LEADING, np.uint8))
    found = np.lib.stride_tricks.sliding_window_view(padded, LEADING)[at]
    return np.ascontiguousarray(found).view(">u8").astype(U64).reshape(len(at), LEADING // 8)


def splitters(rows: DataFrame, n_buckets: int, n_repeated: int) -> np.ndarray:
    """Leading bytes that cut the suffixes at anchors into about even buckets, from a bounded sample.

    Of the sampled documents so many suffixes are taken, by a hash, that about SAMPLED of them reach
    the driver if a quarter of all anchors repeat.
    """
    rate = min(1.0, SAMPLED * SAMPLE_DOCS / max(1, 4 * n_repeated))
    threshold = U64(min(2**64 - 1, int(rate * 2**64)))

    names = list("abcdefgh"[: LEADING // 8])

    def sample(batches):
        for batch in batches:
            for part, texts in blocks(batch, "text"):
                items = byte_items(texts)
                at = np.flatnonzero(items.chosen & (mixed(items.grams) <= threshold))
                key = leading(texts.data, at).view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(key[:, i].copy()) for i in range(len(names))], names)

    some = rows.where(F.pmod(F.xxhash64("doc", "tie"), F.lit(SAMPLE_DOCS)) == 0).select("text")
    found = some.mapInArrow(sample, ", ".join(f"{n} long" for n in names)).orderBy(F.xxhash64(*names)).limit(2 * SAMPLED).toPandas()
    key = np.ascontiguousarray(found.to_numpy(np.int64)).view(U64).reshape(-1, len(names))
    key = key[np.lexsort(key.T[::-1])]
    cut = np.unique(np.linspace(0, len(key), n_buckets + 1).astype(int)[1:-1])
    return np.unique(key[cut[cut < len(key)]], axis=0)


def bucket_of(key: np.ndarray, cuts: np.ndarray) -> np.ndarray:
    """How many splitters stand at or before each key; equal keys never part."""
    both = np.concatenate([cuts, key])
    rank = np.lexsort((np.arange(len(both)), *both.T[::-1]))
    out = np.empty(len(both), np.int64)
    out[rank] = np.cumsum(rank < len(cuts))
    return out[len(cuts) :]


def multikey_order(keys: np.ndarray) -> np.ndarray:
    """Sorts rows of tokens: each round deals the rows that are still tied by their next token."""
    order = np.arange(len(keys))
    group = np.zeros(len(keys), np.int64)
    tied = np.arange(len(keys))
    for k in range(keys.shape[1]):
        if not len(tied):
            break
        rows = order[tied]
        inner = np.lexsort((keys[rows, k], group[tied]))
        order[tied] = rows = rows[inner]
        edge = np.zeros(len(tied), bool)
        edge[new_keys(group[tied], keys[rows, k])] = True
        # Groups are named by their first place.
        group[tied] = tied[np.maximum.accumulate(np.where(edge, np.arange(len(tied)), 0))]
        single = edge & np.append(edge[1:], True)
        tied = tied[~single]
    return order


class Side:
    """One side of the contexts, from the anchor outwards: sorted, with what neighbours have in common."""

    def __init__(self, data: np.ndarray, begin: np.ndarray, size: np.ndarray, step: int, width: int, first: np.ndarray):
        self.size = size
        width = -(-width // 8) * 8
        if step < 0:
            data, begin = data[::-1], len(data) - 1 - begin
        # A view: `width` bytes a context are copied, and no places of these.
        bytes_ = np.lib.stride_tricks.sliding_window_view(np.append(data, np.zeros(width, np.uint8)), width)[begin]
        bytes_[np.arange(width) >= size[:, None]] = 0
        tokens = np.concatenate([first.astype(U64)[:, None], bytes_.view(">u8").astype(U64)], 1)
        self.order = multikey_order(tokens)
        bytes_, first = bytes_[self.order], first[self.order]
        differ = bytes_[1:] != bytes_[:-1]
        common = np.where(differ.any(1), differ.argmax(1), width)
        self.common = np.where(first[1:] == first[:-1], common, -1)

    def classes(self, depth: int) -> np.ndarray:
        """Equal numbers for contexts that have the first `depth` bytes in common."""
        out = np.empty(len(self.order), np.int64)
        out[self.order] = np.append(0, np.cumsum(self.common < depth)) if len(out) else out
        return out


def repeated_ranges(c: Contexts, window: int = WINDOW):
    """Of each context the range that windows found elsewhere cover: doc, tie, start, length.

    A window that holds the anchor after `a` bytes is the last `a` bytes before it and the first
    window - a after. For each `a` contexts are alike if they are in one class on both sides. All
    windows of a context overlap, so what they cover is a single range.
    """
    n = len(c.doc)
    size = np.diff(c.at)
    lead = c.at[:-1] + c.left
    right = Side(c.data, lead, size - c.left, 1, window, c.alone)
    left = Side(c.data, lead - 1, c.left, -1, window - GRAM, c.alone)
    # Contexts that are equal as a whole are one from here on; two places of it cover all of it.
    whole = np.stack([right.classes(window), left.classes(window - GRAM), right.size, left.size], 1)
    order = np.lexsort((c.start, c.tie, c.doc, *whole.T[::-1]))
    at = new_keys(*(whole[order].T))
    count = np.diff(np.append(at, n))
    same_place = (c.doc[order] == np.repeat(c.doc[order[at]], count)) & (c.tie[order] == np.repeat(c.tie[order[at]], count)) & (c.start[order] == np.repeat(c.start[order[at]], count))
    several = np.add.reduceat(~same_place, at) > 0 if n else np.zeros(0, bool)
    settled = (np.maximum.reduceat(c.mark[order], at) > 0) | several if n else several
    all_of = order[np.repeat(settled, count) & (size[order] >= window)]
    found = [(c.doc[all_of], c.tie[all_of], c.start[all_of], size[all_of])]
    lone = order[at]
    least, most = np.full(n, window), np.full(n, -1)
    settled_of = np.zeros(n, bool)
    settled_of[lone] = settled
    for a in range(window - GRAM + 1):
        able = lone[(left.size[lone] >= a) & (right.size[lone] >= window - a)]
        if len(able) > 1:
            key = right.classes(window - a)[able] * n + left.classes(a)[able]
            many, _ = repeats(key)
            hit = able[many & ~settled_of[able]]
            least[hit], most[hit] = np.minimum(least[hit], a), a
    hit = np.flatnonzero(most >= 0)
    found.append((c.doc[hit], c.tie[hit], c.start[hit] + c.left[hit] - most[hit], window + most[hit] - least[hit]))
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def settle_equal(doc, tie, start, length, group):
    """Of contexts that a task holds at several places, all are covered; one goes on, marked."""
    at = new_keys(group)
    count = np.diff(np.append(at, len(group)))
    rep = np.repeat(at, count)
    several = np.add.reduceat((doc != doc[rep]) | (tie != tie[rep]) | (start != start[rep]), at) > 0
    which = np.flatnonzero(np.repeat(several, count))
    return at, several.astype(np.int64), (which, start[which], length[which])


def remove_repeated_bytes(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """Removes each byte covered by a WINDOW-byte string that also starts anywhere else.

    Strings don't cross documents, overlaps count, and all copies go; strings are judged on the
    input. Suffixes are sampled at anchors, one at least in each window. Those whose anchor
    repeats are dealt to buckets between sampled splitters of their leading bytes, with the bytes
    before the anchor; each bucket sorts both sides by multikey sort and finds by what neighbours
    have in common which windows repeat. Splitters part different leading bytes only, so windows
    that are alike meet in one bucket; those of a hot anchor are dealt one by one.

    Returns id, n_bytes, n_removed, n_spans, kept_sha256 for each row. A null text is empty. Rows
    that repeat both id and text are one document. Ids are integers or null.
    """
    rows = keyed(docs, id_col, text)
    n_parts = parts_for(rows)
    flagged, hot = repeated_anchors(rows, BYTES, n_parts)
    n = flagged.agg(F.sum(F.length("places")) / 4).first()[0] or 0
    n_buckets = max(1, int(n // BUCKET))
    cuts = splitters(rows, n_buckets, int(n))
    shared = rows.sparkSession.sparkContext.broadcast(cuts.tobytes())  # 2 * SAMPLED keys at most

    def part_of(texts, items, low, lead, high, alone):
        return bucket_of(leading(texts.data, lead), np.frombuffer(shared.value, U64).reshape(-1, LEADING // 8))

    def untouched(texts):
        size = np.diff(texts.at)
        none = np.zeros(texts.n, np.int64)
        return {"n_bytes": size, "n_removed": none, "n_spans": none, "kept_sha256": [hashlib.sha256(texts.text(i)).hexdigest() for i in range(texts.n)]}

    schema = "n_bytes long, n_removed long, n_spans long, kept_sha256 string"
    walked = walk_contexts(rows, flagged, hot, BYTES, part_of, settle_equal, untouched, schema, n_parts)
    intervals = compared(walked, repeated_ranges, n_buckets, n_parts)

    def remove(part, texts):
        removed = removed_items(part, texts.at)
        total = np.concatenate([[0], np.cumsum(removed)])
        n_removed = total[texts.at[1:]] - total[texts.at[:-1]]
        begins = removed & ~np.append(False, removed[:-1])
        first = texts.at[:-1][texts.at[:-1] < texts.at[1:]]
        begins[first] = removed[first]
        spans = np.concatenate([[0], np.cumsum(begins)])
        kept = texts.data[~removed]
        bounds = texts.at - total[texts.at]
        digests = [hashlib.sha256(kept[a:b].tobytes()).hexdigest() for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
        return {"n_bytes": np.diff(texts.at), "n_removed": n_removed, "n_spans": spans[texts.at[1:]] - spans[texts.at[:-1]], "kept_sha256": digests}

    return finished(walked, intervals, remove, schema, id_col)
