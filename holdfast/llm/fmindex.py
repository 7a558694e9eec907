"""Repeated word windows by FM-indexes: one for each shard, searched backwards over wavelet trees."""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .passages import Contexts, Items, Unit, compared, finished, keyed, new_keys, parts_for, removed_items, repeated_anchors, walk_contexts
from .textkit import U64, Texts, anchors, long_span_hashes, mixed, span_hashes

#: Words of a window that counts as a repeat, and of an anchor.
WINDOW, GRAM = 20, 8
#: Contexts of a shard, about.
SHARD = 8_000


def word_items(texts: Texts) -> Items:
    texts.words()
    values = texts.word_hashes()
    grams, whole = texts.windows(values, GRAM)
    grams = np.where(whole, grams, U64(2**64 - 1))
    room = texts.word_at[1:][texts.word_doc] - np.arange(len(values)) if len(values) else np.zeros(0, np.int64)
    windows = room >= WINDOW
    least, chosen = anchors(grams, windows, WINDOW - GRAM + 1)
    return Items(texts.word_at, texts.word_doc, values, grams, least, windows, chosen & whole, texts.starts, texts.ends)


WORDS = Unit(word_items, WINDOW, GRAM)


class WaveletTree:
    """Rank of symbols in a sequence, a bit vector for each bit of a symbol (in matrix layout).

    A level is its packed bits and the number of ones before each 64 of them.
    """

    def __init__(self, sequence: np.ndarray, n_symbols: int):
        self.n, self.bits = len(sequence), max(1, int(n_symbols - 1).bit_length())
        self.levels, x = [], sequence
        for shift in range(self.bits - 1, -1, -1):
            bit = ((x >> shift) & 1).astype(np.uint8)
            padded = np.zeros(-(-(self.n + 1) // 64) * 64, np.uint8)
            padded[: self.n] = bit
            words = np.packbits(padded, bitorder="little").view(U64)
            before = np.concatenate([[0], np.cumsum(np.bitwise_count(words), dtype=np.int64)[:-1]]).astype(np.int32)
            self.levels.append((words, before, int(self.n - bit.sum())))
            x = np.concatenate([x[bit == 0], x[bit == 1]])
        self.first = self.descend(np.arange(n_symbols), np.zeros(n_symbols, np.int64))

    def descend(self, symbol: np.ndarray, i: np.ndarray) -> np.ndarray:
        for level, (words, before, zeros) in enumerate(self.levels):
            block = i >> 6
            low = (U64(1) << (i & 63).astype(U64)) - U64(1)
            ones = before[block] + np.bitwise_count(words[block] & low)
            bit = (symbol >> (self.bits - 1 - level)) & 1
            i = np.where(bit == 1, zeros + ones, i - ones)
        return i

    def rank(self, symbol: np.ndarray, i: np.ndarray) -> np.ndarray:
        """How often the symbol stands before place i."""
        return self.descend(symbol, i) - self.first[symbol]


class FMIndex:
    """Of contexts of words, each closed by symbol 0; patterns are no longer than the order's depth."""

    def __init__(self, text: np.ndarray, n_symbols: int, depth: int, stands: np.ndarray):
        rank, have = text.astype(np.int64), 1
        n = len(text)
        while have < depth:
            nxt = np.zeros(n, np.int64)
            m = max(0, n - have)
            nxt[:m] = rank[have:][:m]
            key = rank * (rank.max() + 1) + nxt
            order = np.argsort(key, kind="stable")
            rank = np.empty(n, np.int64)
            rank[order] = np.cumsum(np.append(0, key[order][1:] != key[order][:-1]))
            have *= 2
        order = np.argsort(rank, kind="stable")
        self.tree = WaveletTree(text[order - 1], n_symbols)
        self.below = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=n_symbols))])
        # Where each row's suffix stands among all documents; the earliest of any range of rows.
        self.table = [stands[order]]
        while 2 << (len(self.table) - 1) <= n:
            half = 1 << (len(self.table) - 1)
            self.table.append(np.minimum(self.table[-1][:-half], self.table[-1][half:]))
        self.flat = np.concatenate(self.table)
        self.offset = np.concatenate([[0], np.cumsum([len(t) for t in self.table])])

    def earliest(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        level = np.frexp((high - low).astype(np.float64))[1] - 1
        base = self.offset[level]
        return np.minimum(self.flat[base + low], self.flat[base + high - (1 << level)])

    def extended(self, symbol: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rows that begin with the symbol and then what rows low to high begin with."""
        both = self.tree.rank(np.concatenate([symbol, symbol]), np.concatenate([low, high]))
        return self.below[symbol] + both[: len(symbol)], self.below[symbol] + both[len(symbol) :]


def search_back(index: FMIndex, text: np.ndarray, stands: np.ndarray, end: np.ndarray, limit: np.ndarray) -> np.ndarray:
    """Extends each pattern from `end` backwards, down to `limit`, while it also stands earlier.

    Returns where each begins: the matching statistics of these ends against what is earlier.
    """
    begin, live = end.copy(), np.flatnonzero(end > limit)
    low, high = np.zeros(len(end), np.int64), np.full(len(end), len(text), np.int64)
    while len(live):
        place = begin[live] - 1
        a, b = index.extended(text[place], low[live], high[live])
        some = b > a
        some[some] = index.earliest(a[some], b[some]) < stands[place[some]]
        live, a, b = live[some], a[some], b[some]
        begin[live] -= 1
        low[live], high[live] = a, b
        live = live[begin[live] > limit[live]]
    return begin


def earlier_windows(c: Contexts, window: int = WINDOW):
    """Of each context the words that windows cover which also start earlier: doc, tie, start, length."""
    texts = Texts(c.data, c.at)
    texts.words()
    hashes = texts.word_hashes()
    n_words = np.diff(texts.word_at)
    # Equal contexts are indexed once, at their earliest place; of the others everything is later.
    key = long_span_hashes(hashes, texts.word_at[:-1], texts.word_at[1:], 0x9E3779B97F4A7C15)
    other = long_span_hashes(hashes, texts.word_at[:-1], texts.word_at[1:], 0xA24BAED4963EE407)
    order = np.lexsort((c.start, c.tie, c.doc, other, key))
    at = new_keys(key[order], other[order])
    rep = np.repeat(order[at], np.diff(np.append(at, len(order))))
    later = order[(c.doc[order] != c.doc[rep]) | (c.tie[order] != c.tie[rep]) | (c.start[order] != c.start[rep])]
    found = [(c.doc[later], c.tie[later], c.start[later], n_words[later])]
    lone = np.sort(order[at])
    # The shard's text: each context's words and a closing 0.
    sizes = n_words[lone]
    begin = np.concatenate([[0], np.cumsum(sizes + 1)])
    text = np.zeros(begin[-1], np.int64)
    names, symbol = np.unique(hashes, return_inverse=True)
    inside = np.ones(len(text), bool)
    inside[begin[1:] - 1] = False
    taken = np.zeros(texts.n, bool)
    taken[lone] = True
    text[inside] = symbol[taken[texts.word_doc]] + 1
    # Documents in order, and words within: which of two places is the earlier.
    places = np.lexsort((c.tie[lone], c.doc[lone]))
    edge = np.zeros(len(lone), np.int64)
    edge[new_keys(c.doc[lone][places], c.tie[lone][places])] = 1
    number = np.empty(len(lone), np.int64)
    number[places] = np.cumsum(edge)
    stands = np.full(len(text), np.iinfo(np.int64).max)
    stands[inside] = (np.repeat((number << 34) + c.start[lone] - begin[:-1], sizes + 1) + np.arange(len(text)))[inside]
    index = FMIndex(text, len(names) + 1, 2 * window, stands)

    # Windows not yet known begin from low to high. From the right one match settles all windows in
    # it; from the left one mismatch settles all that hold it.
    low, high = begin[:-1].copy(), begin[:-1] + sizes - window
    repeat = np.zeros(len(text) + 1, bool)
    from_right = True
    open_ = np.flatnonzero(low <= high)
    while len(open_):
        first, last = low[open_], high[open_]
        end = (last if from_right else first) + window
        got = search_back(index, text, stands, end, first)
        if from_right:
            hit = got <= last
            lengths = np.where(hit, last - got + 1, 0)
            high[open_] = np.where(hit, got - 1, last - 1)
            start = got
        else:
            hit = got <= first
            lengths = hit.astype(np.int64)
            low[open_] = np.where(hit, first + 1, got)
            start = first
        spots = np.repeat(start - np.concatenate([[0], np.cumsum(lengths)[:-1]]), lengths) + np.arange(lengths.sum())
        repeat[spots] = True
        open_ = open_[low[open_] <= high[open_]]
        from_right = not from_right
    # Runs of such windows; closing symbols part those of different contexts.
    edge = np.diff(np.concatenate([[0], repeat.astype(np.int8)]))
    a, b = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    mine = np.searchsorted(begin, a, "right") - 1
    who = lone[mine]
    found.append((c.doc[who], c.tie[who], c.start[who] + a - begin[mine], b - a + window - 1))
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def settle_later(doc, tie, start, length, group):
    """Of contexts that a task holds at several places, the earliest goes on; the others are later."""
    at = new_keys(group)
    rep = np.repeat(at, np.diff(np.append(at, len(group))))
    later = np.flatnonzero((doc != doc[rep]) | (tie != tie[rep]) | (start != start[rep]))
    return at, np.zeros(len(at), np.int64), (later, start[later], length[later])


def kept_words(texts: Texts, removed: np.ndarray) -> list[str]:
    """Hex digests of each text's words that stay, joined by single spaces."""
    kept = np.flatnonzero(~removed)
    data = np.append(texts.data, np.uint8(32))
    edge = np.zeros(len(data) + 1, np.int8)
    edge[texts.starts[kept]] += 1
    ends = texts.ends[kept]
    edge[ends] -= 1
    keep = np.cumsum(edge, dtype=np.int32)[: len(data)] > 0
    # After each word but a text's last there is a separator; it becomes the space.
    gap = ends[:-1][texts.word_doc[kept[1:]] == texts.word_doc[kept[:-1]]]
    data[gap], keep[gap] = 32, True
    total = np.concatenate([[0], np.cumsum(keep)])
    out, bounds = data[keep], total[texts.at]
    return [hashlib.sha256(out[a:b].tobytes()).hexdigest() for a, b in zip(bounds[:-1], bounds[1:], strict=True)]


def remove_earlier_windows(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """Removes words covered by a WINDOW-word window that also starts earlier.

    Earlier is a smaller id, or an earlier start in the same document; windows are judged on the
    input. Each shard holds the surroundings of the repeated anchors that fall to it, in an FM-index:
    words are symbols, the Burrows-Wheeler sequence is in a wavelet tree. The same surroundings
    are streamed against it: backward search extends each match while one of its rows stands
    earlier, and intervals of WINDOW words or more are reported. Equal surroundings are indexed once.
    The windows of a hot anchor are dealt to shards one by one, by their own words.

    Returns id, n_words, n_removed, kept_sha256 for each row. A null text has no words. Null ids
    come first. Rows that repeat both id and text are one document; rows of one id with different
    texts are ordered by a hash of these. Texts shorter than a window stay whole. Ids are integers.
    """
    rows = keyed(docs, id_col, text)
    n_parts = parts_for(rows)
    flagged, hot = repeated_anchors(rows, WORDS, n_parts)
    n = flagged.agg(F.sum(F.length("places")) / 4).first()[0] or 0
    n_shards = max(1, int(n // SHARD))

    def part_of(texts, items, low, lead, high, alone):
        own = np.where(alone, span_hashes(items.values, low, high, 0x9E3779B97F4A7C15), items.grams[lead])
        return (mixed(own) >> U64(33)).astype(np.int64) % n_shards

    def untouched(texts):
        texts.words()
        none = np.zeros(len(texts.starts), bool)
        return {"n_words": np.diff(texts.word_at), "n_removed": np.zeros(texts.n, np.int64), "kept_sha256": kept_words(texts, none)}

    schema = "n_words long, n_removed long, kept_sha256 string"
    walked = walk_contexts(rows, flagged, hot, WORDS, part_of, settle_later, untouched, schema, n_parts)
    intervals = compared(walked, earlier_windows, n_shards, n_parts)

    def remove(part, texts):
        texts.words()
        removed = removed_items(part, texts.word_at)
        return {"n_words": np.diff(texts.word_at), "n_removed": np.bincount(texts.word_doc[removed], minlength=texts.n), "kept_sha256": kept_words(texts, removed)}

    return finished(walked, intervals, remove, schema, id_col)
