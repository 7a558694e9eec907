"""Periodic runs of words: a harmonic grid of probes for each period, survivors extended in chunks."""

from __future__ import annotations

from itertools import chain, compress

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .passages import column
from .shared import WORD
from .textkit import Texts, blocks

#: A run has so many words at least, and so many periods.
LEAST, TIMES = 24, 3
#: Grid points probed at once, and words compared at once while survivors are extended.
PROBES, CELLS = 1 << 18, 1 << 20

RUNS = "array<struct<start: long, length: long, period: long>>"


def agreement(ids: np.ndarray, a: np.ndarray, b: np.ndarray, most: np.ndarray, step: int) -> np.ndarray:
    """For each pair of places, how many words in a row agree from there on, in steps of 1 or -1, up to `most`.

    Chunks double while they agree, so what is read follows what agrees.
    """
    done = np.zeros(len(a), np.int64)
    live, width = np.flatnonzero(most > 0), 8
    while len(live):
        going = []
        strip = max(1, CELLS // width)
        for i in range(0, len(live), strip):
            own = live[i : i + strip]
            k = done[own, None] + np.arange(width)
            inside = k < most[own, None]
            k = np.minimum(k, most[own, None] - 1) * step
            same = (ids[a[own, None] + k] == ids[b[own, None] + k]) & inside
            whole = same.all(1)
            done[own] += np.where(whole, width, same.argmin(1))
            going.append(own[whole])
        live, width = np.concatenate(going), min(2 * width, CELLS)
    return done


def find_runs(ids: np.ndarray, at: np.ndarray, least: int = LEAST, times: int = TIMES) -> np.ndarray:
    """Rows of text, start (in its text), length, period: all maximal runs of the texts ids[at[i]:at[i + 1]].

    A run of period p holds two grid neighbours jp and (j + 1)p with all p words from each equal, as it is three periods long;
    so for each p only the points of its grid are probed: n / p of them, n log n in all. Grid points in a
    found run whose period divides p are passed over: whatever they belong to is that run itself.
    """
    if times < 3:
        raise ValueError("a run has three periods at least")
    sizes = np.diff(at)
    found = [np.zeros((0, 4), np.int64)]
    p, longest = 1, int(sizes.max(initial=0))
    while times * p <= longest and least <= longest:
        active = np.flatnonzero(sizes >= max(least, times * p))
        n = sizes[active]
        # Never a period and its double at once: the shorter one has to be known first.
        periods = np.arange(p, p + min(p, max(1, PROBES * p // int(n.sum()))))
        counts = n // periods[:, None] - 1
        counts[n < times * periods[:, None]] = 0
        counts = counts.ravel()
        cell = np.repeat(np.arange(len(counts)), counts)
        j = np.arange(len(cell)) - np.repeat(np.cumsum(counts) - counts, counts)
        period, text = periods[cell // len(active)], active[cell % len(active)]
        place = at[text] + j * period
        same = ids[place] == ids[place + period]
        place, period, text = place[same], period[same], text[same]
        p = int(periods[-1]) + 1

        order = np.int64(at[-1] + 1)
        known = np.concatenate(found)
        known = known[known[:, 2] > periods[0]]
        if len(known) and len(place):
            # Places of each grid that lie in a found run, as intervals of (period, place).
            first = -(-periods[0] // known[:, 3])
            many = np.maximum(periods[-1] // known[:, 3] - first + 1, 0)
            run = np.repeat(np.arange(len(known)), many)
            multiple = (np.repeat(first, many) + np.arange(len(run)) - np.repeat(np.cumsum(many) - many, many)) * known[run, 3]
            start = at[known[run, 0]] + known[run, 1]
            end = np.maximum(start + known[run, 2] - multiple, start)
            key = period * order + place
            edge = np.zeros(len(key) + 1, np.int64)
            np.add.at(edge, np.searchsorted(key, multiple * order + start), 1)
            np.add.at(edge, np.searchsorted(key, multiple * order + end), -1)
            free = np.cumsum(edge[:-1]) == 0
            place, period, text = place[free], period[free], text[free]

        full = agreement(ids, place, place + period, period, 1) == period
        place, period, text = place[full], period[full], text[full]
        if not len(place):
            continue
        # Neighbours on a grid are of one stretch: its ends are less than a period away.
        head = np.append(True, (period[1:] != period[:-1]) | (place[1:] - place[:-1] != period[1:]) | (text[1:] != text[:-1]))
        tail = np.append(head[1:], True)
        low, high, period, text = place[head], place[tail], period[head], text[head]
        low = low - agreement(ids, low - 1, low + period - 1, low - at[text], -1)
        high = high + 2 * period
        high = high + agreement(ids, high - period, high, at[text + 1] - high, 1)
        good = high - low >= np.maximum(least, times * period)
        found.append(np.stack([text, low - at[text], high - low, period], 1)[good])
    runs = np.concatenate(found)
    return runs[np.lexsort((runs[:, 3], runs[:, 1], runs[:, 0]))]


def numbered_words(texts: Texts) -> tuple[list[list[bytes]], np.ndarray, np.ndarray]:
    """The words of each text, their numbers (equal for equal words and no others), and where each text begins in these."""
    words = [texts.text(i).split() for i in range(texts.n)]
    names: dict[bytes, int] = {}
    at = np.zeros(texts.n + 1, np.int64)
    np.cumsum([len(w) for w in words], out=at[1:])
    ids = np.fromiter((names.setdefault(w, len(names)) for w in chain.from_iterable(words)), np.int32, at[-1])
    return words, ids, at


def periodic_runs(docs: DataFrame, id_col: str = "doc_id", text: str = "text", least: int = LEAST, times: int = TIMES) -> DataFrame:
    """For each row: id, n_words, runs (start, length and period in words; by start, then period), collapsed.

    A run is a stretch with smallest period p, of max(least, times * p) words or more, that no
    neighbouring word extends with that period. `collapsed` is the text without the words that a run
    holds after its first p, the rest joined by one space.

    A null text has no words; a text without runs is collapsed to its words. Rows are judged each for
    itself, so repeated and null ids are no matter, and other columns are ignored. Nothing is shuffled. A task holds
    about a megabyte of texts, or one longer text, and the time grows as n log n with its words.
    """

    def find(batches):
        for batch in batches:
            for part, texts in blocks(batch, "text"):
                words, ids, at = numbered_words(texts)
                runs = find_runs(ids, at, least, times)
                edge = np.zeros(len(ids) + 1, np.int64)
                base = at[runs[:, 0]] + runs[:, 1]
                np.add.at(edge, base + runs[:, 3], 1)
                np.add.at(edge, base + runs[:, 2], -1)
                stays = np.cumsum(edge[:-1]) == 0
                bounds = np.searchsorted(runs[:, 0], np.arange(texts.n + 1))
                touched = (np.diff(bounds) > 0).tolist()
                collapsed = [b" ".join(compress(w, stays[at[i] : at[i + 1]]) if touched[i] else w) for i, w in enumerate(words)]
                structs = pa.StructArray.from_arrays([pa.array(runs[:, c]) for c in (1, 2, 3)], ["start", "length", "period"])
                lists = pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), structs)
                yield pa.RecordBatch.from_arrays([column(part, "id"), pa.array(np.diff(at)), lists, pa.array(collapsed, pa.binary()).cast(pa.string())], ["id", "n_words", "runs", "collapsed"])

    rows = docs.select(F.col(id_col).alias("id"), F.col(text).alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(find, f"id {kind}, n_words long, runs {RUNS}, collapsed string").withColumnRenamed("id", id_col)


def greatest_run(runs: Column) -> Column:
    """Of a list of runs the one with the most periods, exactly; of equal ones the first. Null for an empty list."""
    longer = lambda best, x: x["length"] * best["period"] > best["length"] * x["period"]
    return F.aggregate(runs, F.get(runs, 0), lambda best, x: F.when(longer(best, x), x).otherwise(best))


def with_planted_runs(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """The documents, in a tenth of which the words from some place on repeat a stretch of words.

    Which, where and how is told by the crc32 of the decimal id: for trials of run detection. A null id has no digits, and
    its text stays. Words of a changed text are joined by one space.
    """
    h = F.crc32(F.col(id_col).cast("string"))
    words = F.regexp_extract_all(F.col(text), F.lit(WORD), F.lit(0))
    n, g = F.size(words).cast("long"), F.floor(h / 10)
    a = g % n
    p = 1 + F.floor((n - a) / (3 + g % 8))
    i = lambda x: x.cast("int")
    again = F.flatten(F.array_repeat(F.slice(words, i(a + 1), i(p)), i(F.ceil((n - a) / p))))
    planted = F.array_join(F.concat(F.slice(words, F.lit(1), i(a)), F.slice(again, F.lit(1), i(n - a))), " ")
    return docs.withColumn(text, F.when((h % 10 == 0) & (n > 0), planted).otherwise(F.col(text)))
