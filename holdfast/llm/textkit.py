"""Words, word windows and lines of many texts at once, as numpy arrays over their UTF-8 bytes.

All inside one task: Spark partitions the rows, these helpers take a batch's Arrow column a few
megabytes at a time, so memory follows the longest text and not the batch.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U64 = np.uint64
#: Bytes of text handled at once; a longer text is a block of its own.
BLOCK = 1 << 20
SEPARATOR = np.zeros(256, bool)
SEPARATOR[[0x20, *range(0x09, 0x0E)]] = True

#: The lowest i bytes of a number, for i up to 8.
BYTES = np.array([(1 << 8 * i) - 1 for i in range(9)], U64)
#: Words of more bytes than this are digested one by one.
SHORT = 15
#: A prime, modulo which whole sequences are hashed.
PRIME = (1 << 61) - 1

_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}
_prime_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective mix of 64-bit values."""
    x = (x ^ (x >> U64(32))) * U64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> U64(29))) * U64(0x9E3779B97F4A7C15)
    return x ^ (x >> U64(32))


def powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd base modulo 2**64 and of its inverse."""
    if base not in _powers or len(_powers[base][0]) < n:
        size = max(n, BLOCK + 1)
        make = lambda b: np.concatenate([np.ones(1, U64), np.full(size - 1, b, U64)]).cumprod(dtype=U64)
        _powers[base] = make(base), make(pow(base, -1, 1 << 64))
    up, down = _powers[base]
    return up[:n], down[:n]


def span_hashes(values: np.ndarray, starts: np.ndarray, ends: np.ndarray, base: int) -> np.ndarray:
    """Mixed polynomial hashes of values[start:end]; equal spans have equal hashes wherever they stand.

    Modulo 2**64, so for short spans of strong values (words' digests), or where bytes are compared later:
    long spans of two values in turn can be made alike. `long_span_hashes` has no such spans.
    """
    up, down = powers(base, len(values) + 1)
    total = np.zeros(len(values) + 1, U64)
    np.cumsum(values * up[:-1], out=total[1:])
    return mixed((total[ends] - total[starts]) * down[starts] + (ends - starts).astype(U64))


def folded(x: np.ndarray) -> np.ndarray:
    """x modulo PRIME."""
    x = (x & U64(PRIME)) + (x >> U64(61))
    return np.where(x >= U64(PRIME), x - U64(PRIME), x)


def times(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """a * b modulo PRIME, of numbers below it."""
    low = U64(0xFFFFFFFF)
    a1, a0, b1, b0 = a >> U64(32), a & low, b >> U64(32), b & low
    middle, small = a1 * b0 + a0 * b1, a0 * b0
    # 2**61 is 1 here, so 2**64 is 8.
    return folded(((a1 * b1) << U64(3)) + (middle >> U64(29)) + ((middle & U64((1 << 29) - 1)) << U64(32)) + (small & U64(PRIME)) + (small >> U64(61)))


def prime_powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of a base modulo PRIME and of its inverse."""
    if base not in _prime_powers or len(_prime_powers[base][0]) < n:

        def make(b: int) -> np.ndarray:
            out = np.ones(1, U64)
            while len(out) < max(n, 1 << 18):
                out = np.append(out, times(out, np.full(1, pow(b, len(out), PRIME), U64)))
            return out

        _prime_powers[base] = make(base % PRIME), make(pow(base, -1, PRIME))
    up, down = _prime_powers[base]
    return up[:n], down[:n]


def long_span_hashes(values: np.ndarray, starts: np.ndarray, ends: np.ndarray, base: int) -> np.ndarray:
    """As `span_hashes`, modulo a prime: for spans of any length whose equality is taken from two such hashes."""
    up, down = prime_powers(base, len(values) + 1)
    each = times(folded(values), up[:-1])
    high, low = np.zeros(len(values) + 1, U64), np.zeros(len(values) + 1, U64)
    np.cumsum(each >> U64(32), out=high[1:])
    np.cumsum(each & U64(0xFFFFFFFF), out=low[1:])
    high = folded(high)
    total = folded(((high & U64((1 << 29) - 1)) << U64(32)) + (high >> U64(29)) + folded(low))
    return mixed(times(folded(total[ends] + U64(PRIME) - total[starts]), down[starts]) + mixed((ends - starts).astype(U64)))


class Texts:
    """A block of texts: `data` bytes, `at` their n + 1 offsets."""

    def __init__(self, data: np.ndarray, at: np.ndarray):
        self.data, self.at, self.n = data, at, len(at) - 1

    def words(self) -> None:
        """Sets starts, ends (byte offsets), word_at (n + 1 offsets into these) and word_doc."""
        apart = SEPARATOR[self.data]
        before = np.empty_like(apart)
        before[:1], before[1:] = True, apart[:-1]
        filled = self.at[:-1][self.at[:-1] < self.at[1:]]
        before[filled] = True
        after = np.empty_like(apart)
        after[-1:], after[:-1] = True, apart[1:]
        after[self.at[1:][self.at[:-1] < self.at[1:]] - 1] = True
        self.starts = np.flatnonzero(~apart & before)
        self.ends = np.flatnonzero(~apart & after) + 1
        self.word_at = np.searchsorted(self.starts, self.at)
        self.word_doc = np.repeat(np.arange(self.n), np.diff(self.word_at))

    def word_digests(self) -> np.ndarray:
        """128 bits of each word, as a row of two numbers.

        Words of up to SHORT bytes are their bytes and their length under a permutation of 128-bit numbers, so different
        ones never agree; longer ones have a BLAKE2 digest.
        """
        data = np.append(self.data, np.zeros(16, np.uint8))
        eight = np.ndarray(len(data) - 7, "<u8", data, strides=(1,))
        n = self.ends - self.starts
        low = eight[self.starts] & BYTES[np.minimum(n, 8)]
        high = (eight[self.starts + 8] & BYTES[np.clip(n - 8, 0, 7)]) | (n.astype(U64) << U64(56))
        for key in (0x9E3779B97F4A7C15, 0xA24BAED4963EE407):
            high = high ^ mixed(low + U64(key))
            low = low ^ mixed(high + U64(key))
        out = np.stack([low, high], 1)
        long = np.flatnonzero(n > SHORT)
        if len(long):
            raw, spans = memoryview(self.data), zip(self.starts[long].tolist(), self.ends[long].tolist(), strict=True)
            digests = b"".join([hashlib.blake2b(raw[a:b], digest_size=16).digest() for a, b in spans])
            out[long] = np.frombuffer(digests, "<u8").reshape(-1, 2)
        return out

    def word_hashes(self) -> np.ndarray:
        """64 bits of each word."""
        return np.ascontiguousarray(self.word_digests()[:, 0])

    def windows(self, hashes: np.ndarray, k: int, base: int = 0x9E3779B97F4A7C15) -> tuple[np.ndarray, np.ndarray]:
        """Hash of the k words that start at each word, and whether all k are of one text."""
        n = len(hashes)
        first = np.arange(n)
        whole = first + k <= self.word_at[1:][self.word_doc] if n else np.zeros(0, bool)
        return span_hashes(hashes, first, np.minimum(first + k, n), base), whole

    def text(self, i: int) -> bytes:
        return self.data[self.at[i] : self.at[i + 1]].tobytes()


def texts_of(column: pa.Array) -> Texts:
    """An Arrow string column; null counts as empty."""
    column = column.fill_null("") if column.null_count else column
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    kind = np.int64 if wide else np.int32
    at = np.frombuffer(offsets, kind, len(column) + 1, column.offset * np.dtype(kind).itemsize).astype(np.int64) if len(column) else np.zeros(1, np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return Texts(raw[at[0] : at[-1]], at - at[0])


def blocks(batch: pa.RecordBatch, text: str, limit: int = BLOCK) -> Iterator[tuple[pa.RecordBatch, Texts]]:
    """Slices of a batch whose texts hold about `limit` bytes, one text at least."""
    column = batch.column(batch.schema.get_field_index(text))
    at = texts_of(column).at
    i = 0
    while i < len(column):
        j = max(i + 1, int(np.searchsorted(at, at[i] + limit, "right")) - 1)
        part = batch.slice(i, j - i)
        yield part, texts_of(part.column(part.schema.get_field_index(text)))
        i = j


def per_text(flags: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Sum of `flags` over each text's range of them."""
    total = np.zeros(len(flags) + 1, np.int64)
    np.cumsum(flags, out=total[1:])
    return total[at[1:]] - total[at[:-1]]


def repeats(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each key: is it there more than once; did it stand earlier."""
    order = np.argsort(keys, kind="stable")
    same = np.zeros(len(keys), bool)
    sorted_keys = keys[order]
    same[1:] = sorted_keys[1:] == sorted_keys[:-1]
    either = same.copy()
    either[:-1] |= same[1:]
    many, later = np.empty_like(same), np.empty_like(same)
    many[order], later[order] = either, same
    return many, later


def covered(starts: np.ndarray, width: int, n: int) -> np.ndarray:
    """Which of n places lie in [start, start + width) of any start."""
    edge = np.zeros(n + width + 1, np.int32)
    np.add.at(edge, starts, 1)
    edge[width:] -= edge[:-width].copy()
    return np.cumsum(edge[:n]) > 0


def sliding(x: np.ndarray, width: int, best) -> np.ndarray:
    """best (np.minimum or np.maximum) over x[i : i + width], cut off at the end."""
    x, have = x.copy(), 1
    while have < width:
        step = min(have, width - have)
        if len(x) > step:
            best(x[:-step], x[step:], out=x[:-step])
        have += step
    return x


def anchors(grams: np.ndarray, whole: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Of `width` grams from each place on the least one, and the places that are least of some such run.

    `whole` says where all grams of the run are of one text. Equal runs have the same anchors, ties
    included, so whatever two texts share holds an anchor that they share.
    """
    least = sliding(grams, width, np.minimum)
    known = np.where(whole, least, U64(0))
    # The largest of the minima of all runs that hold this place, looking back.
    back = sliding(known[::-1], width, np.maximum)[::-1]
    return least, (back == grams) & (back > 0)
