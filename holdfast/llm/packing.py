"""Packing documents into training sequences: non-negative least squares over length combinations."""

from __future__ import annotations

import zlib
from itertools import combinations_with_replacement

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import hash_place, n_buckets, running_sum, written
from .textkit import blocks
from .tokens import encoder, is_wide

#: Ids of a sequence, and the grid on which lengths are combined.
WINDOW, GRID = 1024, 8
#: Parts of a combination at most.
DEPTH = 3
#: Grid steps that a greedily packed sequence may leave empty.
SLACK = 2


def least_squares(a: np.ndarray, b: np.ndarray, rounds: int = 2000) -> np.ndarray:
    """x >= 0 that makes |a x - b| least, by the active-set method."""
    gram, right = a.T @ a, a.T @ b
    x, active = np.zeros(a.shape[1]), np.zeros(a.shape[1], bool)
    for _ in range(rounds):
        slope = right - gram @ x
        slope[active] = -np.inf
        best = int(np.argmax(slope))
        if slope[best] <= 1e-9 * max(1.0, np.abs(right).max()):
            break
        active[best] = True
        while True:
            on = np.flatnonzero(active)
            z = np.linalg.lstsq(gram[np.ix_(on, on)], right[on], rcond=None)[0]
            if (z > 0).all():
                x[:] = 0
                x[on] = z
                break
            low = on[z <= 0]
            step = np.min(x[low] / np.maximum(x[low] - z[z <= 0], 1e-300))
            x[on] += step * (z - x[on])
            active &= x > 1e-12
            x[~active] = 0
    return x


def combinations(cells: int, depth: int) -> list[tuple[int, ...]]:
    """All ways to fill `cells` with at most `depth` lengths."""
    found = [(cells,)]
    for d in range(2, depth + 1):
        found += [(*c, cells - sum(c)) for c in combinations_with_replacement(range(1, cells), d - 1) if cells - sum(c) >= c[-1]]
    return found


def plan_sequences(histogram: np.ndarray, depth: int = DEPTH, slack: int = SLACK) -> list[tuple[tuple[int, ...], int]]:
    """Combinations of lengths in grid steps and how often each is used; histogram[i] pieces have i steps.

    The least-squares counts are rounded and cut to what there is; what is left is packed greedily,
    the longest first, as long as sequences get full but for `slack` steps. The histogram's size
    is fixed, so this doesn't grow with the input.
    """
    left = histogram.astype(np.int64).copy()
    cells = len(left) - 1
    plan = []
    if left.sum():
        ways = combinations(cells, depth)
        matrix = np.zeros((cells + 1, len(ways)))
        for j, way in enumerate(ways):
            for part in way:
                matrix[part, j] += 1
        scale = left.sum()
        counts = np.rint(least_squares(matrix, left / scale) * scale).astype(np.int64)
        for j in np.argsort(-counts, kind="stable"):
            need = matrix[:, j].astype(np.int64)
            n = min(counts[j], int((left[need > 0] // need[need > 0]).min()))
            if n > 0:
                plan.append((ways[j], int(n)))
                left -= n * need
    for longest in range(cells, 0, -1):
        while left[longest]:
            way, gap, free = [], cells, left.copy()
            for part in range(longest, 0, -1):
                take = int(min(free[part], gap // part))
                way += [part] * take
                gap -= part * take
            if gap > slack or way[0] != longest:
                break
            need = np.bincount(way, minlength=cells + 1)
            n = int((left[need > 0] // need[need > 0]).min())
            plan.append((tuple(way), n))
            left -= n * need
    return plan


def encoded(docs: DataFrame, vocabulary: str, end_id: int, id_col: str, text: str) -> DataFrame:
    """Written table of row, id, n and ids (compressed little-endian numbers); a null text is empty."""
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text), F.lit("")).alias("text"))

    def encode(batches):
        import zstandard

        coder, press = encoder(vocabulary), zstandard.ZstdCompressor(level=1)
        kind = "<u4" if coder.wide else "<u2"
        for batch in batches:
            for part, _ in blocks(batch, "text"):
                ids, at = coder.encode(part.column("text").to_pylist())
                each = [np.append(ids[at[i] : at[i + 1]], np.uint32(end_id)) for i in range(part.num_rows)]
                packed = [press.compress(x.astype(kind).tobytes()) for x in each]
                yield pa.RecordBatch.from_arrays([part.column("id"), pa.array([len(x) for x in each], pa.int64()), pa.array(packed, pa.binary())], ["id", "n", "ids"])

    kind = rows.schema["id"].dataType.simpleString()
    return written(rows.mapInArrow(encode, f"id {kind}, n long, ids binary").withColumn("row", F.monotonically_increasing_id()), "packing-ids")


def pack_documents(docs: DataFrame, vocabulary: str, end_id: int = 0, id_col: str = "doc_id", text: str = "text", window: int = WINDOW, grid: int = GRID) -> DataFrame:
    """Pieces of documents and their places in sequences of at most `window` ids.

    A document is its ids and `end_id`. Whole windows of it are sequences. The rest has a length on
    the grid, rounded up, and is dealt by its rank among those of that length to the planned
    combinations. What no combination takes is laid end to end and cut at each window, so
    only the last sequence of that stream is short. Ranks and running sums go over buckets of
    a hash; the driver sees the histogram of grid lengths alone.

    Returns doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset. A sequence is padded to the
    window unless its used length is a power of two. Null and empty texts are one piece of
    the end id; repeated rows are documents of their own; an empty table gives no pieces.
    """
    table = encoded(docs, vocabulary, end_id, id_col, text)
    cells = window // grid
    rows = table.select("row", "n", F.floor(F.col("n") / window).cast("long").alias("full"), (F.col("n") % window).alias("rest"))
    rows = rows.withColumn("steps", F.ceil(F.col("rest") / grid).cast("int")).withColumn("place", hash_place("row"))
    # Row counts by length on the grid: `cells` + 1 numbers.
    histogram = np.zeros(cells + 1, np.int64)
    for steps, count in rows.groupBy("steps").count().collect():
        histogram[steps] = count
    buckets = n_buckets(int(histogram.sum()))
    histogram[0] = 0
    plan = plan_sequences(histogram)
    spark = docs.sparkSession
    # Which ranks of a length a combination takes.
    taken, entries, first = np.zeros(cells + 1, np.int64), [], 0
    for way, n in plan:
        for part in sorted(set(way)):
            times = way.count(part)
            entries.append((part, int(taken[part]), int(taken[part] + n * times), first, times))
            taken[part] += n * times
        first += n
    planned = spark.createDataFrame(entries, "steps int, low long, high long, first long, times long")

    rests = running_sum(rows.where("rest > 0").withColumn("one", F.lit(1)), ["steps"], "place", ["row"], "one", "rank", buckets)
    fits = (F.col("r.steps") == F.col("p.steps")) & (F.col("rank") >= F.col("low")) & (F.col("rank") < F.col("high"))
    rests = rests.alias("r").join(F.broadcast(planned).alias("p"), fits, "left")
    sequence = F.col("first") + F.floor((F.col("rank") - F.col("low")) / F.col("times")).cast("long")
    rests = written(rests.select("row", "n", "place", "rest", sequence.alias("sequence")), "packing-rests")
    # Combined ones: their order within the sequence is that of the rows.
    inside = Window.partitionBy("sequence").orderBy("row").rowsBetween(Window.unboundedPreceding, -1)
    combined = rests.where("sequence is not null").withColumn("offset", F.coalesce(F.sum("rest").over(inside), F.lit(0)))
    piece = lambda start, length, seq, offset: F.struct(start.cast("long").alias("start"), length.cast("long").alias("length"), seq.cast("long").alias("sequence"), offset.cast("long").alias("offset"))
    base = F.col("n") - F.col("rest")
    combined = combined.select("row", F.array(piece(base, F.col("rest"), F.col("sequence"), F.col("offset"))).alias("pieces"))
    # The stream, cut at each window: a rest is in one sequence or two.
    stream = running_sum(rests.where("sequence is null").withColumn("all", F.lit(0)), ["all"], "place", ["row"], "rest", "at", buckets)
    seq = F.floor(F.col("at") / window)
    offset = F.col("at") - seq * window
    head = F.least(F.col("rest"), window - offset)
    pieces = F.filter(F.array(piece(base, head, first + seq, offset), piece(base + head, F.col("rest") - head, first + seq + 1, F.lit(0))), lambda p: p["length"] > 0)
    stream = stream.select("row", pieces.alias("pieces"))
    tails = combined.unionByName(stream)
    # Whole windows follow: as many ids as the stream has at most are left out for it.
    streamed = rests.where("sequence is null").agg(F.sum("rest")).first()[0] or 0
    behind = first + -(-streamed // window)
    full = running_sum(rows.where("full > 0").withColumn("all", F.lit(0)), ["all"], "place", ["row"], "full", "before", buckets)
    full = full.select("row", (F.col("before") + behind).alias("whole"))
    out = table.join(full, "row", "left").join(tails, "row", "left")

    names = ["id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    wide = is_wide(vocabulary)

    def cut(batches):
        import zstandard

        expand = zstandard.ZstdDecompressor()
        for batch in batches:
            c = {name: batch.column(i).to_pylist() for i, name in enumerate(batch.schema.names)}
            found = []
            for key, n, packed, whole, tail in zip(c["id"], c["n"], c["ids"], c["whole"], c["pieces"], strict=True):
                ids = np.frombuffer(expand.decompress(packed), "<u4" if wide else "<u2").astype("<u4")
                spots = [(k * window, window, whole + k, 0) for k in range(n // window)]
                spots += [(p["start"], p["length"], p["sequence"], p["offset"]) for p in tail or ()]
                found += [(key, s, m, zlib.crc32(ids[s : s + m].tobytes()), n, q, o) for s, m, q, o in spots]
            columns = list(zip(*found, strict=True)) or [()] * 7
            yield pa.RecordBatch.from_arrays([pa.array(columns[0], batch.schema.field("id").type), *(pa.array(x, pa.int64()) for x in columns[1:])], names)

    kind = table.schema["id"].dataType.simpleString()
    return out.select("id", "n", "ids", "whole", "pieces").mapInArrow(cut, ", ".join(f"{x} {kind if x == 'id' else 'long'}" for x in names)).withColumnRenamed("id", id_col)
