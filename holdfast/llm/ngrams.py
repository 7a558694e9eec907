"""N-gram Jaccard join: MinHash banding finds candidates, full n-gram sets verify them."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .passages import integers, joined, keyed, new_keys, packed, rows_of, unpacked
from .shared import join_checked, join_groups, tasks, written
from .textkit import U64, Texts, blocks, long_span_hashes, mixed, span_hashes

#: Words of a shingle, least similarity, hash functions at most, and recall at that similarity.
WORDS, SIMILARITY, HASHES, RECALL = 5, 0.8, 128, 0.995
#: Band hashes that a task gathers before it sends them.
HELD = 1 << 20
#: Members of a block of a component, and words of these: the sets of two blocks are compared at once.
MEMBERS, MEMBER_WORDS = 2048, 1 << 20
#: Bytes of sets in a batch that a task sends.
SENT = 16 << 20
#: Edges that one task joins to components: 3 MB.
FEW_EDGES = 200_000


def choose_bands(similarity: float = SIMILARITY, recall: float = RECALL, hashes: int = HASHES) -> tuple[int, int]:
    """Bands and rows: the most selective rows whose bands still reach the recall at the similarity."""
    for rows in range(hashes, 0, -1):
        bands = hashes // rows
        if 1 - (1 - similarity**rows) ** bands >= recall:
            return bands, rows
    return hashes, 1


def shingles(texts: Texts, k: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of k words and the text each is of; a shorter text is one run, without words none."""
    texts.words()
    hashes = texts.word_hashes()
    grams, whole = texts.windows(hashes, k)
    n = np.diff(texts.word_at)
    short = np.flatnonzero((n > 0) & (n < k))
    own = span_hashes(hashes, texts.word_at[short], texts.word_at[short + 1], 0x9E3779B97F4A7C15)
    grams, doc = np.append(grams[whole], own), np.append(texts.word_doc[whole], short)
    if len(short):
        order = np.argsort(doc, kind="stable")
        grams, doc = grams[order], doc[order]
    return grams, doc


def signatures(rows: DataFrame, n_hashes: int) -> DataFrame:
    """id, doc, tie, two hashes of the word sequence, its length, and the MinHash values (null without words); `row` is carried if there."""
    own = [n for n in ("id", "doc", "tie", "row") if n in rows.columns]

    def sign(batches):
        seeds = mixed(np.arange(1, n_hashes + 1, dtype=U64) * U64(0x9E3779B97F4A7C15)) | U64(1)
        for batch in batches:
            for part, texts in blocks(batch, "text"):
                grams, doc = shingles(texts)
                at = np.searchsorted(doc, np.arange(texts.n))
                some = np.append(at[1:], len(doc)) > at
                values = np.zeros((n_hashes, texts.n), np.uint32)
                if len(grams):
                    for i, seed in enumerate(seeds):
                        values[i, some] = np.minimum.reduceat(((grams * seed) >> U64(32)).astype(np.uint32), at[some])
                values = np.ascontiguousarray(values.T)
                hashes = texts.word_hashes()
                two = [long_span_hashes(hashes, texts.word_at[:-1], texts.word_at[1:], b).view(np.int64) for b in (0x9E3779B97F4A7C15, 0xA24BAED4963EE407)]
                sig = pa.array([values[i].tobytes() if s else None for i, s in enumerate(some.tolist())], pa.binary())
                get = lambda n: part.column(part.schema.get_field_index(n))  # noqa: B023, E731
                yield pa.RecordBatch.from_arrays([*map(get, own), pa.array(two[0]), pa.array(two[1]), pa.array(np.diff(texts.word_at)), sig], [*own, "h1", "h2", "words", "sig"])

    return rows.select(*own, "text").mapInArrow(sign, ", ".join(f"{n} long" for n in [*own, "h1", "h2", "words"]) + ", sig binary")


def band_edges(reps: DataFrame, bands: int, per_band: int) -> DataFrame:
    """Candidate edges (a, b), a < b: from each node to the least one in a bucket of equal band hashes.

    A task joins what it holds of a bucket to its own least node and sends that one alone.
    """
    n_parts = tasks(reps.sparkSession)

    def star(h: np.ndarray, node: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        order = np.lexsort((node, h))
        h, node = h[order], node[order]
        at = new_keys(h)
        least = np.repeat(node[at], np.diff(np.append(at, len(h))))
        far = node != least
        return h[at], node[at], least[far], node[far]

    def send(h, node):
        h, node, a, b = star(h, node)
        pairs = np.unique(np.stack([a, b], 1), axis=0)
        if len(pairs):
            yield rows_of("edge", np.zeros(len(pairs), np.int64), [pairs[:, 0].copy(), pairs[:, 1].copy()])
        yield rows_of("hash", (h >> U64(33)).astype(np.int64) % n_parts, [h, node])

    def gather(batches):
        held, size = [], 0
        for batch in batches:
            if not batch.num_rows:
                continue
            sig = np.frombuffer(b"".join(batch.column(1).to_pylist()), np.uint32).reshape(batch.num_rows, -1)
            node = batch.column(0).to_numpy()
            for band in range(bands):
                own = sig[:, band * per_band : (band + 1) * per_band].astype(U64)
                h = np.full(len(own), U64(band))
                for c in own.T:
                    h = mixed(h + c)
                held.append((h, node))
                size += len(h)
            if size >= HELD:
                yield from send(*(np.concatenate(x) for x in zip(*held, strict=True)))
                held, size = [], 0
        if size:
            yield from send(*(np.concatenate(x) for x in zip(*held, strict=True)))

    schema = "kind string, part long, a binary, b binary, c binary, d binary, e binary, f binary"
    sent = written(reps.where("sig is not null").select("node", "sig").mapInArrow(gather, schema), "bands")

    def settle(table: pa.Table) -> pa.Table:
        _, _, a, b = star(joined(table, "a", "<u8"), joined(table, "b", "<i8"))
        pairs = np.unique(np.stack([a, b], 1), axis=0)
        return pa.table({"a": pairs[:, 0], "b": pairs[:, 1]})

    def unpack(batches):
        for batch in batches:
            for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                yield pa.RecordBatch.from_arrays([pa.array(unpacked(a, "<i8")), pa.array(unpacked(b, "<i8"))], ["a", "b"])

    settled = sent.where("kind = 'hash'").select("part", "a", "b").groupBy("part").applyInArrow(settle, "a long, b long")
    own = sent.where("kind = 'edge'").select("a", "b").mapInArrow(unpack, "a long, b long")
    return settled.unionByName(own).distinct()


def united(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nodes of these edges, and for each the least node that it is joined to."""
    nodes, both = np.unique(np.append(a, b), return_inverse=True)
    x, y, root = both[: len(a)], both[len(a) :], np.arange(len(nodes))
    while len(x):
        low, high = np.minimum(root[x], root[y]), np.maximum(root[x], root[y])
        apart = low != high
        x, y = x[apart], y[apart]
        np.minimum.at(root, high[apart], low[apart])
        up = root[root]
        while (up != root).any():
            root, up = up, up[up]
    return nodes, nodes[root]


def components(edges: DataFrame, few: int = FEW_EDGES) -> DataFrame:
    """node and label, the least node of its component, for each node of an edge.

    Each round hooks every label to the least one beside it, and carries the edges over to the new
    labels; labels at least halve a round. All of it is joins and aggregates over written tables. When no
    more than `few` edges are left, whatever the input was, one task joins these at once.
    """

    def unite(batches):
        parts = [(batch.column(0).to_numpy(), batch.column(1).to_numpy()) for batch in batches]
        if parts:
            node, root = united(*(np.concatenate(x) for x in zip(*parts, strict=True)))
            yield pa.RecordBatch.from_arrays([pa.array(node), pa.array(root)], ["x", "to"])

    def hooks(rest: DataFrame, small: bool) -> DataFrame:
        if small:
            return rest.coalesce(1).mapInArrow(unite, "x long, to long")
        two = rest.unionByName(rest.select(F.col("y").alias("x"), F.col("x").alias("y")))
        return two.groupBy("x").agg(F.least(F.min("y"), F.first("x")).alias("to"))

    edges = written(edges.select(F.col("a").alias("x"), F.col("b").alias("y")), "edges")
    small = edges.count() <= few
    labels = written(hooks(edges, small).select(F.col("x").alias("node"), F.col("to").alias("label")), "labels")
    if small:
        return labels
    while True:
        ends = edges.join(labels.select(F.col("node").alias("x"), F.col("label").alias("p")), "x")
        ends = ends.join(labels.select(F.col("node").alias("y"), F.col("label").alias("q")), "y").where("p <> q")
        rest = written(ends.select(F.least("p", "q").alias("x"), F.greatest("p", "q").alias("y")).distinct(), "edges")
        left = rest.count()
        if not left:
            break
        hook = written(hooks(rest, left <= few), "hooks")
        labels = labels.join(hook, labels["label"] == hook["x"], "left").select("node", F.coalesce("to", "label").alias("label"))
        labels = written(labels, "labels")
        if left <= few:
            break
    # Labels may be hooked on: follow them to the least.
    while True:
        up = labels.select(F.col("node").alias("label"), F.col("label").alias("to"))
        moved = written(labels.join(up, "label", "left").select("node", F.coalesce("to", "label").alias("label"), (F.coalesce("to", "label") != F.col("label")).alias("moved")), "labels")
        labels = moved.select("node", "label")
        if moved.where("moved").isEmpty():
            return labels


def linked(key: np.ndarray, node: np.ndarray, side: np.ndarray, sets: list[np.ndarray], similarity: float):
    """Verified pairs of nodes within each key, as places in the arrays; sides 0 and 1 pair across only.

    Members with side 2 pair with each other. Small groups count shared shingles by sorting, large
    ones by products of their membership matrices in strips.
    """
    sizes = np.array([len(s) for s in sets], np.int64)
    order = np.argsort(key, kind="stable")
    at = new_keys(key[order])
    bounds = np.append(at, len(order))
    left, right = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    small = [order[a:b] for a, b in zip(bounds[:-1], bounds[1:], strict=True) if b - a <= 16]
    if small:
        who = np.concatenate(small)
        group = np.repeat(np.arange(len(small)), [len(s) for s in small])
        values = np.concatenate([sets[i] for i in who])
        member = np.repeat(who, sizes[who])
        own = mixed(values + np.repeat(group, sizes[who]).astype(U64) * U64(0xA24BAED4963EE407))
        rank = np.argsort(own, kind="stable")
        own, member = own[rank], member[rank]
        codes = []
        for d in range(1, 16):
            same = own[d:] == own[:-d] if len(own) > d else np.zeros(0, bool)
            if not same.any():
                break
            a, b = member[:-d][same], member[d:][same]
            codes.append(np.minimum(a, b) * len(node) + np.maximum(a, b))
        if codes:
            pair, shared = np.unique(np.concatenate(codes), return_counts=True)
            a, b = pair // len(node), pair % len(node)
            good = shared >= similarity * (sizes[a] + sizes[b] - shared) - 1e-9
            left.append(a[good])
            right.append(b[good])
    for i, j in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
        if j - i <= 16:
            continue
        who = order[i:j]
        values, n = np.concatenate([sets[w] for w in who]), len(who)
        member = np.repeat(np.arange(n), sizes[who])
        rank = np.argsort(values, kind="stable")
        values, member = values[rank], member[rank]
        first = np.append(True, values[1:] != values[:-1])
        name = np.cumsum(first) - 1
        common = np.bincount(name)[name] > 1
        name, member = np.unique(name[common], return_inverse=True)[1], member[common]
        shared, strip = np.zeros((n, n), np.float32), 4096
        cuts = np.searchsorted(name, np.arange(0, (name[-1] + 1 if len(name) else 0) + strip, strip))
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            if b > a:
                held = np.zeros((n, strip), np.float32)
                held[member[a:b], name[a:b] % strip] = 1
                shared += held @ held.T
        union = sizes[who][:, None] + sizes[who][None, :] - shared
        a, b = np.nonzero(np.triu((shared >= similarity * union - 1e-6), 1) & (shared > 0))
        left.append(who[a])
        right.append(who[b])
    a, b = np.concatenate(left), np.concatenate(right)
    across = (side[a] != side[b]) | ((side[a] == 2) & (side[b] == 2))
    return a[across], b[across]


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text: str = "text", similarity: float = SIMILARITY, recall: float = RECALL, row: str | None = None, members: int = MEMBERS) -> DataFrame:
    """For each row: rep_id, n_copies, class_id, n_links, first.

    Rows of equal word sequences are copies; the least id of them represents them. Representatives
    are linked if the Jaccard similarity of their sets of 5-word shingles reaches `similarity`.
    Candidates share a band of MinHash values, with bands and rows chosen for `recall`. The
    candidates' components then bring full sets together, where all pairs of a component are verified;
    a component of more than `members` or MEMBER_WORDS is dealt to pairs of blocks, as its links are counted. n_links is the number of linked
    representatives, class_id the least id of those joined by links, `first` marks the one row of a
    class that has it.

    A null text has no words; texts without words are copies of each other and have no links. A text
    of fewer than 5 words is one shingle. A null id is the least. Repeated rows are copies. Ids are
    integers. `row` names a column of unique numbers that is returned too, to find the rows again.
    """
    rows = keyed(docs, id_col, text, [F.col(row).alias("row")] if row else [])
    bands, per_band = choose_bands(similarity, recall)
    signed = signatures(rows, bands * per_band)
    signed = written(signed if row else signed.withColumn("row", F.monotonically_increasing_id()), "signatures")
    known = F.col("id").isNotNull().alias("known")
    best = F.min(F.struct("doc", known, "tie", "row")).alias("best")
    groups = written(signed.groupBy("h1", "h2").agg(best, F.count("*").alias("n_copies")).withColumn("key", F.struct("h1", "h2")), "copies")
    # A representative's row number is its node.
    firsts = groups.select(F.col("best.row").alias("row"))
    reps = written(signed.join(firsts, "row", "left_semi").select(F.col("row").alias("node"), "doc", known, "tie", "words", "sig"), "representatives")
    edges = band_edges(reps, bands, per_band)
    label = components(edges)
    sized = reps.select("node", "doc", "tie", "words").join(label, "node")
    n_blocks = F.greatest(F.ceil(F.count("*") / members), F.ceil(F.sum("words") / MEMBER_WORDS)).cast("long")
    counts = sized.groupBy("label").agg(n_blocks.alias("n_blocks"), F.sum("words").alias("sum"))
    large = written(counts.where("n_blocks > 1").select("label", "n_blocks"), "large-components")
    near = join_checked(sized, large, "label", "left").withColumn("n_blocks", F.coalesce("n_blocks", F.lit(1).cast("long")))
    near = written(near, "candidates")
    n_sent = near.agg(F.sum(F.col("words") * F.col("n_blocks"))).first()[0] or 0
    n_parts = max(tasks(docs.sparkSession), int(n_sent // MEMBER_WORDS))

    def deal(batches):
        types = {"part": pa.int64(), "key": pa.int64(), "node": pa.int64(), "side": pa.int64(), "set": pa.binary()}

        def sent(out):
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types.values(), strict=True)], list(types))

        for batch in batches:
            for part, texts in blocks(batch, "text"):
                grams, doc = shingles(texts)
                at = np.searchsorted(doc, np.arange(texts.n + 1))
                node, group, blocks_of = integers(part, "node"), integers(part, "label"), integers(part, "n_blocks")
                out, size = [], 0
                for i in range(texts.n):
                    own, n = packed(np.unique(grams[at[i] : at[i + 1]])), int(blocks_of[i])
                    block = int(mixed(node[i : i + 1].astype(U64))[0] % U64(n))
                    for j in range(n):
                        low, high = min(block, j), max(block, j)
                        key = int(mixed(mixed(group[i : i + 1].astype(U64)) + U64(low * n + high))[0])
                        out.append(((key >> 20) % n_parts, key - 2**63, int(node[i]), 2 if low == high else int(block == high), own))
                        size += len(own) + 64
                        if size >= SENT:
                            yield sent(out)
                            out, size = [], 0
                if out:
                    yield sent(out)

    def verify(table: pa.Table) -> pa.Table:
        node, side = table.column("node").to_numpy(), table.column("side").to_numpy()
        sets = [unpacked(x, "<u8") for x in table.column("set").to_pylist()]
        a, b = linked(table.column("key").to_numpy(), node, side, sets, similarity)
        # Links of each node here, and a forest of them: each node with the least one it reaches.
        n_links = np.bincount(np.append(a, b), minlength=len(node))
        least, before = node.copy(), None
        while before is None or (before != least).any():
            before = least.copy()
            np.minimum.at(least, a, before[b])
            np.minimum.at(least, b, before[a])
        some = n_links > 0
        return pa.table({"node": node[some], "root": least[some], "n_links": n_links[some]})

    # Not all texts, only those of candidates.
    wanted = join_checked(rows.select("doc", "tie", "text"), near.select("doc", "tie", "node", "label", "n_blocks"), ["doc", "tie"])
    # Rows that repeat id and text would come twice.
    sets = wanted.select("node", "label", "n_blocks", "text").mapInArrow(deal, "part long, key long, node long, side long, set binary")
    sets = sets.dropDuplicates(["key", "node"]) if not signed.groupBy("doc", "tie").count().where("count > 1").isEmpty() else sets
    links = written(sets.repartition(n_parts, "part").groupBy("part").applyInArrow(verify, "node long, root long, n_links long"), "links")
    classes = components(links.where("node <> root").select(F.col("root").alias("a"), F.col("node").alias("b")).distinct())
    n_links = links.groupBy("node").agg(F.sum("n_links").alias("n_links"))
    info = reps.select("node", "doc", "known").join(classes, "node", "left").join(n_links, "node", "left")
    info = written(info.select("node", "doc", "known", F.coalesce("label", "node").alias("label"), F.coalesce("n_links", F.lit(0)).alias("n_links")), "classes")
    least = info.groupBy("label").agg(F.min(F.struct("doc", "known", "node")).alias("least"))
    info = info.join(least, "label").select(F.col("node").alias("rep"), "n_links", F.when(F.col("least.known"), F.col("least.doc")).alias("class_id"), F.col("least.node").alias("class_node"))
    info = written(groups.join(info, groups["best.row"] == info["rep"]).select("key", "n_copies", F.when(F.col("best.known"), F.col("best.doc")).alias("rep_id"), "n_links", "class_id", "class_node"), "groups")
    out = join_groups(signed.select("id", "row", F.struct("h1", "h2").alias("key")), info, "key", "n_copies")
    return out.select(
        F.col("id").alias(id_col), "rep_id", "n_copies", "class_id", "n_links", (F.col("row") == F.col("class_node")).alias("first"), *([F.col("row").alias(row)] if row else [])
    )
