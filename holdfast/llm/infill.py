"""Fill-in-the-middle by a parallel automaton scan: chunks are functions over states, composed to find cuts."""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .passages import column, integers
from .shared import tasks, written
from .textkit import Texts, blocks

#: What marks prefix, suffix and middle in an output.
MARKERS = ("<P>", "<S>", "<M>")
#: Bytes of a text above which its chunks are scanned by several tasks, and of such a chunk.
CHUNK = 1 << 20
#: Bytes of chunks for each task that scans them, about.
TASK_BYTES = 32 << 20
NEWLINE = 10


@dataclass(frozen=True)
class Automaton:
    """Reads bytes: whether the next one begins a line, and how much of a marker was read last.

    A state is 2 * progress + inside; `inside` is 0 before the first byte of a line. The last progress means that a marker
    was found, and stays. Bytes that no state tells apart are one class; class 0 is in no marker and no
    line's end, and a run of it does what one byte of it does.
    """

    markers: tuple[str, ...] = MARKERS

    @cached_property
    def tables(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The class of each byte; next state and lines begun, by class and state."""
        words = [m.encode() for m in self.markers]
        progress = sorted({w[:i] for w in words for i in range(len(w))}, key=lambda x: (len(x), x))
        letters = sorted({NEWLINE, *b"".join(words)})
        kind = np.zeros(256, np.uint8)
        kind[letters] = np.arange(1, len(letters) + 1)
        found = len(progress)
        ahead = np.zeros((len(letters) + 1, 2 * found + 2), np.uint8)
        begun = np.zeros_like(ahead, np.int64)
        for c in range(len(letters) + 1):
            for p in range(found + 1):
                to = found
                if p < found:
                    read = progress[p] + bytes([letters[c - 1]]) if c else b""
                    ends = [read[i:] for i in range(len(read) + 1)]
                    to = found if any(e in words for e in ends) else progress.index(next(e for e in ends if e in progress))
                for inside in (0, 1):
                    ahead[c, 2 * p + inside] = 2 * to + (0 if c and letters[c - 1] == NEWLINE else 1)
                    begun[c, 2 * p + inside] = 1 - inside
        return kind, ahead, begun

    @property
    def n_states(self) -> int:
        return self.tables[1].shape[1]

    def found(self, state: int) -> bool:
        return state >= self.n_states - 2

    def scan(self, data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """A chunk as a function: for each state before it, the state after it and the lines that begin in it.

        Each byte is such a function. Neighbours are composed two by two until one is left.
        """
        kind, ahead, begun = self.tables
        c = kind[data]
        again = np.zeros(len(c), bool)
        again[1:] = (c[1:] == 0) & (c[:-1] == 0)
        c = c[~again]
        to, n = ahead[c], begun[c]
        if not len(c):
            return np.arange(self.n_states, dtype=np.uint8), np.zeros(self.n_states, np.int64)
        while len(to) > 1:
            last = (to[-1:], n[-1:]) if len(to) % 2 else (to[:0], n[:0])
            first, second = to[0 : len(to) - 1 : 2], to[1::2]
            n = np.concatenate([n[0 : len(n) - 1 : 2] + np.take_along_axis(n[1::2], first, 1), last[1]])
            to = np.concatenate([np.take_along_axis(second, first, 1), last[0]])
        return to[0], n[0]


def characters(data: np.ndarray) -> int:
    return int(np.count_nonzero((data & 0xC0) != 0x80))


def line_at(data: np.ndarray, k: int, inside: bool) -> int:
    """Code points of a chunk before the k-th line (from 0) that begins in it; `inside` if it begins within a line."""
    begins = np.flatnonzero(data[:-1] == NEWLINE) + 1
    if not inside:
        k -= 1
    return characters(data[: begins[k]]) if k >= 0 else 0


@dataclass(frozen=True)
class Cut:
    """A place in a text: the k-th line that begins in a chunk; without a chunk, `chars` is the place itself."""

    chunk: int
    k: int
    inside: bool
    chars: int


def resolve(auto: Automaton, scanned: list[tuple[np.ndarray, np.ndarray, int]], draws: tuple[int, int]) -> tuple[int, bool, list[Cut]]:
    """Number of lines, whether a marker is in the text, and the cuts, from the functions of its chunks in order."""
    state, n, chars, entered = 0, 0, 0, []
    for ahead, begun, size in scanned:
        entered.append((state, n, chars))
        n += int(begun[state])
        chars += size
        state = int(ahead[state])
    cuts = []
    for u in sorted(h % (n + 1) for h in draws):
        if u == n:
            cuts.append(Cut(-1, 0, False, chars))
            continue
        i = int(np.searchsorted([e[1] for e in entered], u, "right")) - 1
        cuts.append(Cut(i, u - entered[i][1], bool(entered[i][0] % 2), entered[i][2]))
    return n, auto.found(state), cuts


def place(cut: Cut, chunk_of) -> int:
    return cut.chars + (line_at(chunk_of(cut.chunk), cut.k, cut.inside) if cut.chunk >= 0 else 0)


FOUND = "n long, marked boolean, first long, second long"


def found_columns(rows: list[tuple[int, bool, int, int]]) -> list[pa.Array]:
    kinds = (pa.int64(), pa.bool_(), pa.int64(), pa.int64())
    return [pa.array([r[i] for r in rows], kind) for i, kind in enumerate(kinds)]


def cut_whole(rows: DataFrame, auto: Automaton) -> DataFrame:
    """Adds n, marked and the two cuts (code points) to texts of one chunk each."""

    def cut(batches):
        for batch in batches:
            for part, texts in blocks(batch, "text"):
                h1, h2 = integers(part, "h1"), integers(part, "h2")
                found = []
                for i in range(texts.n):
                    data = texts.data[texts.at[i] : texts.at[i + 1]]
                    n, marked, cuts = resolve(auto, [(*auto.scan(data), characters(data))], (int(h1[i]), int(h2[i])))
                    found.append((n, marked, *(place(c, lambda _: data) for c in cuts)))  # noqa: B023
                yield pa.RecordBatch.from_arrays([*part.columns, *found_columns(found)], [*part.schema.names, "n", "marked", "first", "second"])

    return rows.mapInArrow(cut, f"{declared(rows)}, {FOUND}")


def declared(rows: DataFrame) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)


def text_chunks(texts: Texts, i: int, size: int) -> list[np.ndarray]:
    data = texts.data[texts.at[i] : texts.at[i + 1]]
    return [data[a : a + size] for a in range(0, len(data), size)]


def cut_in_chunks(rows: DataFrame, auto: Automaton, size: int) -> DataFrame:
    """As `cut_whole`, for texts of many chunks: these are dealt to all tasks, and only their functions come together again."""
    rows = written(rows.withColumn("row", F.monotonically_increasing_id()), "infill-long")
    n_bytes = rows.agg(F.sum(F.octet_length("text"))).first()[0]
    if n_bytes is None:
        return rows.drop("row").selectExpr("*", "0L n", "true marked", "0L first", "0L second")

    def deal(batches):
        for batch in batches:
            for part, texts in blocks(batch, "text"):
                for i, row in enumerate(integers(part, "row").tolist()):
                    for k, chunk in enumerate(text_chunks(texts, i, size)):
                        yield pa.RecordBatch.from_arrays([pa.array([row]), pa.array([k]), pa.array([chunk.tobytes()], pa.binary())], ["row", "k", "chunk"])

    def scan(batches):
        for batch in batches:
            chunks = [np.frombuffer(c, np.uint8) for c in batch.column(2).to_pylist()]
            done = [auto.scan(c) for c in chunks]
            ahead = pa.array([a.tobytes() for a, _ in done], pa.binary())
            begun = pa.array([n.astype("<i8").tobytes() for _, n in done], pa.binary())
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], ahead, begun, pa.array([characters(c) for c in chunks], pa.int64())], ["row", "k", "ahead", "begun", "chars"])

    n_parts = max(tasks(rows.sparkSession), n_bytes // TASK_BYTES)
    chunks = rows.select("row", "text").mapInArrow(deal, "row long, k long, chunk binary").repartition(n_parts, "row", "k")
    scanned = chunks.mapInArrow(scan, "row long, k long, ahead binary, begun binary, chars long")
    # A text is a cell of 2 GB at most, so it has a bounded number of chunks, each a few hundred bytes here.
    functions = scanned.groupBy("row").agg(F.array_sort(F.collect_list(F.struct("k", "ahead", "begun", "chars"))).alias("functions"))

    def cut(batches):
        for batch in batches:
            for part, texts in blocks(batch, "text"):
                h1, h2 = integers(part, "h1"), integers(part, "h2")
                found = []
                for i, functions in enumerate(column(part, "functions").to_pylist()):
                    own = [(np.frombuffer(f["ahead"], np.uint8), np.frombuffer(f["begun"], "<i8"), f["chars"]) for f in functions]
                    n, marked, cuts = resolve(auto, own, (int(h1[i]), int(h2[i])))
                    of_text = text_chunks(texts, i, size)
                    found.append((n, marked, *(place(c, of_text.__getitem__) for c in cuts)))
                yield pa.RecordBatch.from_arrays([*(column(part, x) for x in kept), *found_columns(found)], [*kept, "n", "marked", "first", "second"])

    kept = [c for c in rows.columns if c != "row"]
    return rows.join(functions.hint("merge"), "row").drop("row").mapInArrow(cut, f"{declared(rows.drop('row'))}, {FOUND}")


def fill_in_middle(
    docs: DataFrame, id_col: str = "doc_id", text: str = "text", rate: int = 100, spm_rate: int = 50, seed: str = "7", markers: tuple[str, str, str] = MARKERS, chunk: int = CHUNK
) -> DataFrame:
    """For each row: id, n (lines), form, prefix_chars, middle_chars (code points; null if plain), output.

    A text is cut at two of its line beginnings (or its end) that the seed and the decimal id name. The output has
    its parts behind their markers, as prefix, suffix, middle (`psm`) or suffix, prefix, middle (`spm`, `spm_rate` of a
    hundred). A text is `plain`, its own output, if it is empty, has a marker in it, or isn't among `rate` of a hundred.

    A null text is empty; a null id has no digits. Rows are cut each for itself, so repeated ids are no matter; other columns
    are ignored. Texts above `chunk` bytes are scanned by many tasks; every text has to be a cell still, as its output is one.
    No end of a marker may be the beginning of a marker, or outputs could be read in two ways.
    """
    if any(a[-i:] == b[:i] and (a, i) != (b, len(a)) for a in markers for b in markers for i in range(1, min(len(a), len(b)) + 1)):
        raise ValueError("markers overlap")
    auto = Automaton(markers)
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("id").cast("string"), F.lit(""))), 256)
    for i in range(4):
        rows = rows.withColumn(f"h{i + 1}", F.conv(F.substring(digest, 8 * i + 1, 8), 16, 10).cast("long"))
    long = F.octet_length("text") > chunk
    cut = cut_whole(rows.where(~long), auto).unionByName(cut_in_chunks(rows.where(long), auto, chunk))
    plain = (F.col("text") == "") | F.col("marked") | (F.col("h3") % 100 >= rate)
    form = F.when(plain, "plain").when(F.col("h4") % 100 < spm_rate, "spm").otherwise("psm")
    cut = cut.withColumn("form", form)
    middle_chars = F.col("second") - F.col("first")
    part = lambda at, n: F.col("text").substr((at + 1).cast("int"), n.cast("int"))
    prefix, middle, suffix = part(F.lit(0), F.col("first")), part(F.col("first"), middle_chars), part(F.col("second"), F.length("text"))
    p, s, m = map(F.lit, markers)
    output = F.when(F.col("form") == "psm", F.concat(p, prefix, s, suffix, m, middle)).when(F.col("form") == "spm", F.concat(s, suffix, p, prefix, m, middle)).otherwise(F.col("text"))
    cutting = F.col("form") != "plain"
    return cut.select(
        F.col("id").alias(id_col), "n", "form", F.when(cutting, F.col("first")).alias("prefix_chars"), F.when(cutting, middle_chars).alias("middle_chars"), output.alias("output")
    )


def restored(output: Column, form: Column, markers: tuple[str, str, str] = MARKERS) -> Column:
    """The text of an output. Texts with markers are plain, so the first of each marker is the one that was put in."""
    p, s, m = markers
    after = lambda c, n: c.substr(F.lit(n + 1) if isinstance(n, int) else n + 1, F.length(c))

    def split(c: Column, first: str, second: str) -> tuple[Column, Column, Column]:
        rest = after(c, len(first))
        one = F.substring_index(rest, second, 1)
        rest = after(rest, F.length(one) + len(second))
        two = F.substring_index(rest, m, 1)
        return one, two, after(rest, F.length(two) + len(m))

    prefix, suffix, middle = split(output, p, s)
    psm = F.concat(prefix, middle, suffix)
    suffix, prefix, middle = split(output, s, p)
    return F.when(form == "psm", psm).when(form == "spm", F.concat(prefix, middle, suffix)).otherwise(output)
