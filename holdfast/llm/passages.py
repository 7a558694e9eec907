"""What repeated word windows and repeated byte strings have in common: finding where they can be.

Anchors are content-selected places, at least one in each window; whatever windows two texts share
holds an anchor that they share. Anchors that occur twice or more are found first, by their
hashes alone. Then only the surroundings of these ("contexts") travel, each to the part that compares
all contexts of an anchor, and intervals of what repeats come back to the documents.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import tasks, written
from .textkit import U64, Texts, blocks, long_span_hashes, mixed, sliding, texts_of

#: Anchors, and bytes of contexts, that a task gathers before it sorts and sends them.
HELD, HELD_BYTES = 1 << 20, 24 << 20
#: Anchors counted as hot at most: a fixed bound on what is broadcast (8 bytes each).
MOST_HOT = 1_000_000
#: An anchor with fewer occurrences is never hot.
LEAST_HOT = 20_000
#: Bytes of text for each part that anchors and intervals are gathered in, about.
PART_BYTES = 32 << 20
LOWEST = -(2**63)
SETTLED = 0xFFFFFFFF


@dataclass
class Items:
    """A block's items (words or bytes): where texts begin in them, and their anchors."""

    at: np.ndarray
    text: np.ndarray
    values: np.ndarray
    grams: np.ndarray
    least: np.ndarray
    windows: np.ndarray
    chosen: np.ndarray
    #: Byte offsets at which an item starts and ends.
    starts: np.ndarray
    ends: np.ndarray


@dataclass(frozen=True)
class Unit:
    """How to read a block, and the lengths of windows and anchors in items."""

    read: Callable[[Texts], Items]
    window: int
    gram: int

    @property
    def width(self) -> int:
        return self.window - self.gram + 1


def keyed(docs: DataFrame, id_col: str, text: str, carried: list[Column] = []) -> DataFrame:
    """id, doc (null: the least number), text (null: empty) and tie, which tells rows of one id.

    That is a hash of the text where any id repeats, else 0, which packs well.
    """
    doc = F.coalesce(F.col(id_col).cast("long"), F.lit(LOWEST))
    # A null id and the least number there is are one key here, so they need the tie too.
    single = docs.groupBy(doc).count().where("count > 1").isEmpty()
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text), F.lit("")).alias("text"), *carried)
    tie = F.lit(0).cast("long") if single else F.xxhash64("text")
    return rows.withColumn("doc", F.coalesce("id", F.lit(LOWEST))).withColumn("tie", tie)


def parts_for(rows: DataFrame) -> int:
    """As many parts as the texts are large, a part a task at least."""
    n_bytes = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    return max(tasks(rows.sparkSession), n_bytes // PART_BYTES)


def column(batch: pa.RecordBatch, name: str) -> pa.Array:
    return batch.column(batch.schema.get_field_index(name))


def integers(batch: pa.RecordBatch, name: str) -> np.ndarray:
    return column(batch, name).to_numpy(zero_copy_only=False)


def shelf(doc: np.ndarray, tie: np.ndarray, n: int) -> np.ndarray:
    """Which of n parts a document's intervals are gathered in."""
    return (mixed(doc.astype(U64) * U64(0x9E3779B97F4A7C15) ^ tie.astype(U64)) >> U64(33)).astype(np.int64) % n


def packed(x: np.ndarray) -> bytes:
    """Compressed, the first bytes of all items first."""
    import zstandard

    flat = np.ascontiguousarray(x).view(np.uint8).reshape(len(x), x.dtype.itemsize).T
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(flat).tobytes())


def unpacked(x: bytes, kind: str) -> np.ndarray:
    import zstandard

    flat = np.frombuffer(zstandard.ZstdDecompressor().decompress(x), np.uint8)
    return np.ascontiguousarray(flat.reshape(np.dtype(kind).itemsize, -1).T).reshape(-1).view(kind)


ROWS = "kind string, part long, a binary, b binary, c binary, d binary, e binary, f binary"
BLOBS = "abcdef"


def rows_of(kind: str, part: np.ndarray, columns: list[np.ndarray], raw: list[bytes] | None = None) -> pa.RecordBatch:
    """A row for each part with the packed columns of its items; `raw` (a bytes each) is joined as f."""
    import zstandard

    order = np.argsort(part, kind="stable")
    names, at = np.unique(part[order], return_index=True)
    bounds = [*at.tolist(), len(part)]
    data = {"kind": pa.array([kind] * len(names), pa.string()), "part": pa.array(names.astype(np.int64))}
    for i, name in enumerate(BLOBS):
        blobs: list[bytes | None] = [None] * len(names)
        if i < len(columns):
            sorted_column = columns[i][order]
            blobs = [packed(sorted_column[a:b]) for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
        elif name == "f" and raw is not None:
            press = zstandard.ZstdCompressor(level=3)
            blobs = [press.compress(b"".join([raw[j] for j in order[a:b].tolist()])) for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
        data[name] = pa.array(blobs, pa.binary())
    return pa.RecordBatch.from_pydict(data)


def joined(table: pa.Table, name: str, kind: str) -> np.ndarray:
    return np.concatenate([unpacked(x, kind) for x in table.column(name).to_pylist()] or [np.zeros(0, kind)])


def as_table(batch: pa.RecordBatch) -> pa.Table:
    return pa.Table.from_batches([batch])


# --- anchors ------------------------------------------------------------------------------------


def repeated_anchors(rows: DataFrame, unit: Unit, n_parts: int) -> tuple[DataFrame, np.ndarray]:
    """doc, tie and places of all anchors whose hash occurs twice or more; hashes of the hot ones.

    A hash that a task holds twice is settled there, and one entry of it tells the others, so a part
    gets an entry of a hash for each HELD anchors at most, however many documents hold it.
    """

    def gather(batches):
        held, size = [], 0

        def send():
            h, doc, tie, place = (np.concatenate(x) for x in zip(*held, strict=True))
            order = np.argsort(h, kind="stable")
            h, doc, tie, place = h[order], doc[order], tie[order], place[order]
            first = np.append(True, h[1:] != h[:-1])
            at = np.flatnonzero(first)
            count = np.diff(np.append(at, len(h))).astype(np.uint32)
            many = np.repeat(count > 1, count)
            if many.any():
                yield rows_of("place", shelf(doc[many], tie[many], n_parts), [doc[many], tie[many], place[many]])
            place = np.where(many, np.uint32(SETTLED), place)
            yield rows_of("hash", (h[at] >> U64(33)).astype(np.int64) % n_parts, [h[at], doc[at], tie[at], place[at], count])

        for batch in batches:
            for part, texts in blocks(batch, "text"):
                items = unit.read(texts)
                at = np.flatnonzero(items.chosen)
                text = items.text[at]
                held.append((items.grams[at], integers(part, "doc")[text], integers(part, "tie")[text], (at - items.at[text]).astype(np.uint32)))
                size += len(at)
                if size >= HELD:
                    yield from send()
                    held, size = [], 0
        if size:
            yield from send()

    sent = written(rows.select("text", "doc", "tie").mapInArrow(gather, ROWS), "anchors")

    def settle(table: pa.Table) -> pa.Table:
        h, doc, tie, place, count = (joined(table, n, k) for n, k in zip("abcde", ("<u8", "<i8", "<i8", "<u4", "<u4"), strict=True))
        order = np.argsort(h, kind="stable")
        h, doc, tie, place, count = h[order], doc[order], tie[order], place[order], count[order]
        at = np.flatnonzero(np.append(True, h[1:] != h[:-1]))
        total = np.add.reduceat(count.astype(np.int64), at)
        entries = np.diff(np.append(at, len(h)))
        many = np.repeat(total > 1, entries) & (place != SETTLED)
        hot = total >= LEAST_HOT
        out = []
        if many.any():
            out.append(rows_of("place", shelf(doc[many], tie[many], n_parts), [doc[many], tie[many], place[many]]))
        if hot.any():
            out.append(rows_of("hot", np.zeros(hot.sum(), np.int64), [h[at[hot]], total[hot]]))
        return pa.Table.from_batches(out) if out else as_table(rows_of("place", np.zeros(0, np.int64), [np.zeros(0, np.int64)]))

    settled = written(sent.where("kind = 'hash'").repartition(n_parts, "part").groupBy("part").applyInArrow(settle, ROWS), "anchors-settled")
    hashes, totals = [np.zeros(0, "<u8")], [np.zeros(0, np.int64)]
    for a, b in settled.where("kind = 'hot'").select("a", "b").toLocalIterator():
        hashes.append(unpacked(a, "<u8"))
        totals.append(unpacked(b, "<i8"))
        if sum(map(len, hashes)) > 2 * MOST_HOT:
            hashes, totals = most_frequent(hashes, totals)
    hashes, _ = most_frequent(hashes, totals)
    places = sent.where("kind = 'place'").unionByName(settled.where("kind = 'place'"))

    def by_document(table: pa.Table) -> pa.Table:
        doc, tie, place = joined(table, "a", "<i8"), joined(table, "b", "<i8"), joined(table, "c", "<u4")
        order = np.lexsort((place, tie, doc))
        doc, tie, place = doc[order], tie[order], place[order]
        at = new_keys(doc, tie)
        each = [np.unique(x).astype("<u4").tobytes() for x in np.split(place, at[1:])] if len(doc) else []
        return pa.table({"doc": doc[at], "tie": tie[at], "places": pa.array(each, pa.binary())})

    flagged = places.select("part", "a", "b", "c").repartition(n_parts, "part").groupBy("part").applyInArrow(by_document, "doc long, tie long, places binary")
    return written(flagged, "flagged"), np.sort(hashes[0])


def most_frequent(hashes: list[np.ndarray], totals: list[np.ndarray]) -> tuple[list[np.ndarray], list[np.ndarray]]:
    h, t = np.concatenate(hashes), np.concatenate(totals)
    keep = np.argsort(-t, kind="stable")[:MOST_HOT]
    return [h[keep]], [t[keep]]


def new_keys(*columns: np.ndarray) -> np.ndarray:
    """Where sorted columns have another key than before."""
    if not len(columns[0]):
        return np.zeros(0, np.int64)
    new = np.zeros(len(columns[0]) - 1, bool)
    for c in columns:
        new |= c[1:] != c[:-1]
    return np.flatnonzero(np.append(True, new))


# --- contexts -----------------------------------------------------------------------------------


@dataclass
class Held:
    """Contexts that a task has gathered."""

    part: list
    doc: list
    tie: list
    start: list
    key: list
    other: list
    length: list
    left: list
    raw: list
    size: int = 0


def contexts_of(unit: Unit, texts: Texts, items: Items, flags: np.ndarray, hot: np.ndarray) -> tuple[np.ndarray, ...]:
    """Ranges of items around the flagged anchors that are least of some window: low, lead (the anchor), high, single.

    A hot anchor's windows are contexts of their own, so they spread by their own content.
    """
    held = np.where(flags, items.grams, U64(2**64 - 1))
    able = items.windows & (sliding(held, unit.width, np.minimum) == items.least)
    known = np.where(able, items.least, U64(0))
    owner = flags & (sliding(known[::-1], unit.width, np.maximum)[::-1] == items.grams)
    at = np.flatnonzero(owner)
    is_hot = np.isin(items.grams[at], hot) if len(hot) else np.zeros(len(at), bool)
    plain = at[~is_hot]
    text = items.text[plain]
    low, high = np.maximum(plain - unit.width + 1, items.at[text]), np.minimum(plain + unit.window, items.at[text + 1])
    single = np.flatnonzero(able & np.isin(items.least, hot)) if is_hot.any() else np.zeros(0, np.int64)
    alone = np.append(np.zeros(len(low), bool), np.ones(len(single), bool))
    return np.append(low, single), np.append(plain, single), np.append(high, single + unit.window), alone


def walk_contexts(rows: DataFrame, flagged: DataFrame, hot: np.ndarray, unit: Unit, part_of: Callable, settle: Callable, untouched: Callable[[Texts], dict], schema: str, n_parts: int) -> DataFrame:
    """Written table of documents (kind doc), contexts (kind context) and intervals (kind interval).

    `untouched` gives the columns of `schema` for texts of which nothing is removed; texts with contexts
    are kept in the table. Equal contexts of a task are sent once: `settle(doc, tie, start,
    length, group)` gets them sorted by group and then place, and returns which to send, a mark (0 or 1) for
    these, and the intervals (index, start, length) that are settled already.
    """
    spark = rows.sparkSession
    sent_hot = spark.sparkContext.broadcast(hot.tobytes())  # MOST_HOT hashes at most
    fields = [f.split() for f in schema.split(", ")]
    types = {"long": pa.int64(), "string": pa.string()}

    def walk(batches):
        hot = np.frombuffer(sent_hot.value, "<u8")
        held = Held([], [], [], [], [], [], [], [], [])

        def wide(batch: pa.RecordBatch) -> pa.RecordBatch:
            n = batch.num_rows
            more = {"id": pa.int64(), "doc": pa.int64(), "tie": pa.int64(), "text": pa.string()} | {f: types[t] for f, t in fields}
            return pa.RecordBatch.from_arrays([*batch.columns, *(pa.nulls(n, t) for t in more.values())], [*batch.schema.names, *more])

        def send():
            names = ("part", "doc", "tie", "start", "key", "other", "length", "left")
            part, doc, tie, start, key, other, length, left = (np.concatenate(getattr(held, n)) for n in names)
            order = np.lexsort((start, tie, doc, other, key))
            part, doc, tie, start, key, other, length, left = (x[order] for x in (part, doc, tie, start, key, other, length, left))
            group = np.zeros(len(key), np.int64)
            group[new_keys(key, other)] = 1
            go, mark, (which, begin, size) = settle(doc, tie, start, length, np.cumsum(group) - 1)
            if len(which):
                yield wide(rows_of("interval", shelf(doc[which], tie[which], n_parts), [doc[which], tie[which], begin.astype(np.uint32), size.astype(np.uint32)]))
            raw = [held.raw[i] for i in order[go].tolist()]
            sizes = np.array([len(x) for x in raw], np.uint32)
            yield wide(rows_of("context", part[go], [doc[go], tie[go], start[go].astype(np.uint32), (left[go] * 2 + mark).astype(np.uint32), sizes], raw))

        for batch in batches:
            for part, texts in blocks(batch, "text"):
                places = column(part, "places")
                some = np.zeros(texts.n, bool)
                flagged_rows = np.flatnonzero(places.is_valid().to_numpy(zero_copy_only=False))
                if len(flagged_rows):
                    mine = part.take(pa.array(flagged_rows))
                    few = texts_of(column(mine, "text"))
                    items = unit.read(few)
                    flags = np.zeros(len(items.values), bool)
                    for i, x in enumerate(column(mine, "places").to_pylist()):
                        flags[np.frombuffer(x, "<u4") + items.at[i]] = True
                    low, lead, high, alone = contexts_of(unit, few, items, flags, hot)
                    if len(low):
                        some[flagged_rows[items.text[low]]] = True
                        text = items.text[low]
                        data = few.data.tobytes()
                        begin, end = items.starts[low].tolist(), items.ends[high - 1].tolist()
                        held.raw += [data[a:b] for a, b in zip(begin, end, strict=True)]
                        held.part.append(part_of(few, items, low, lead, high, alone))
                        held.doc.append(integers(mine, "doc")[text])
                        held.tie.append(integers(mine, "tie")[text])
                        held.start.append((low - items.at[text]).astype(np.int64))
                        held.left.append(((lead - low) * 2 + alone).astype(np.int64))
                        held.length.append((high - low).astype(np.int64))
                        # The same items around another anchor are another context.
                        held.key.append(mixed(long_span_hashes(items.values, low, high, 0x9E3779B97F4A7C15) + held.left[-1].astype(U64)))
                        held.other.append(long_span_hashes(items.values, low, high, 0xA24BAED4963EE407))
                        held.size += sum(end) - sum(begin)
                n = texts.n
                empty = [pa.nulls(n, pa.binary())] * len(BLOBS)
                own = untouched(texts)
                kept = pa.array([t if s else None for t, s in zip(column(part, "text").to_pylist(), some.tolist(), strict=True)], pa.string())
                yield pa.RecordBatch.from_arrays(
                    [pa.array(["doc"] * n, pa.string()), pa.nulls(n, pa.int64()), *empty, column(part, "id"), column(part, "doc"), column(part, "tie"), kept, *(pa.array(own[f], types[t]) for f, t in fields)],
                    ["kind", "part", *BLOBS, "id", "doc", "tie", "text", *(f for f, _ in fields)],
                )
                if held.size >= HELD_BYTES:
                    yield from send()
                    held = Held([], [], [], [], [], [], [], [], [])
        if held.size:
            yield from send()

    out = rows.join(flagged, ["doc", "tie"], "left").select("id", "doc", "tie", "text", "places")
    return written(out.mapInArrow(walk, f"{ROWS}, id long, doc long, tie long, text string, {schema}"), "contexts")


@dataclass
class Contexts:
    """A part's contexts: `data` bytes with n + 1 offsets `at`, and where each begins in its document."""

    data: np.ndarray
    at: np.ndarray
    doc: np.ndarray
    tie: np.ndarray
    start: np.ndarray
    #: Items before the anchor, whether it is a hot anchor's window by itself, and the sender's mark.
    left: np.ndarray
    alone: np.ndarray
    mark: np.ndarray


def contexts_in(table: pa.Table) -> Contexts:
    import zstandard

    expand = zstandard.ZstdDecompressor()
    doc, tie, start, mark, sizes = (joined(table, n, k) for n, k in zip("abcde", ("<i8", "<i8", "<u4", "<u4", "<u4"), strict=True))
    data = np.frombuffer(b"".join(expand.decompress(x) for x in table.column("f").to_pylist()), np.uint8)
    return Contexts(data, np.concatenate([[0], np.cumsum(sizes.astype(np.int64))]), doc, tie, start.astype(np.int64), (mark >> 2).astype(np.int64), (mark >> 1) & 1, mark & 1)


def intervals_of(doc: np.ndarray, tie: np.ndarray, start: np.ndarray, length: np.ndarray, n_parts: int) -> pa.Table:
    return as_table(rows_of("interval", shelf(doc, tie, n_parts), [doc, tie, start.astype(np.uint32), length.astype(np.uint32)]))


def compared(walked: DataFrame, compare: Callable[[Contexts], tuple], n_shards: int, n_parts: int) -> DataFrame:
    """doc, tie and intervals (start, length pairs) from `compare`, which returns doc, tie, start and length."""

    def each(table: pa.Table) -> pa.Table:
        return intervals_of(*compare(contexts_in(table)), n_parts)

    columns = ["kind", "part", *BLOBS]
    found = walked.where("kind = 'context'").select(*columns).repartition(max(n_parts, n_shards // 4), "part").groupBy("part").applyInArrow(each, ROWS)
    intervals = walked.where("kind = 'interval'").select(*columns).unionByName(found)

    def by_document(table: pa.Table) -> pa.Table:
        doc, tie, start, length = (joined(table, n, k) for n, k in zip("abcd", ("<i8", "<i8", "<u4", "<u4"), strict=True))
        order = np.lexsort((start, tie, doc))
        doc, tie, pairs = doc[order], tie[order], np.stack([start[order], length[order]], 1)
        at = new_keys(doc, tie)
        each = [np.ascontiguousarray(x, "<u4").tobytes() for x in np.split(pairs, at[1:])] if len(doc) else []
        return pa.table({"doc": doc[at], "tie": tie[at], "intervals": pa.array(each, pa.binary())})

    return written(intervals.repartition(n_parts, "part").groupBy("part").applyInArrow(by_document, "doc long, tie long, intervals binary"), "intervals")


def removed_items(part: pa.RecordBatch, at: np.ndarray) -> np.ndarray:
    """Which items of a block the intervals of its texts cover."""
    edge = np.zeros(at[-1] + 1, np.int64)
    for i, x in enumerate(column(part, "intervals").to_pylist()):
        if x:
            pairs = np.frombuffer(x, "<u4").astype(np.int64).reshape(-1, 2)
            np.add.at(edge, at[i] + pairs[:, 0], 1)
            np.add.at(edge, at[i] + pairs[:, 0] + pairs[:, 1], -1)
    return np.cumsum(edge)[:-1] > 0


def finished(walked: DataFrame, intervals: DataFrame, remove: Callable[[pa.RecordBatch, Texts], dict], schema: str, id_col: str) -> DataFrame:
    """A row for each document: as it was, or `remove` of those with contexts."""
    docs = walked.where("kind = 'doc'")
    names = [f.split()[0] for f in schema.split(", ")]
    plain = docs.where("text is null").select(F.col("id").alias(id_col), *names)

    def each(batches) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, texts in blocks(batch, "text"):
                own = remove(part, texts)
                yield pa.RecordBatch.from_arrays([column(part, "id"), *(pa.array(own[n]) for n in names)], [id_col, *names])

    able = docs.where("text is not null").select("id", "doc", "tie", "text").join(intervals, ["doc", "tie"], "left")
    return plain.unionByName(able.select("id", "text", "intervals").mapInArrow(each, f"{id_col} long, {schema}"))
