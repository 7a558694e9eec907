"""Stages of the pipeline that bring decisions back to rows, where ids repeat or are null."""

from collections import Counter, defaultdict

import pytest

import corpus_pipeline as pipeline
from holdfast.llm import mixing

SCHEMA = "doc_id long, text string, source string, row int, tie string"


def words(n: int, seed: int) -> list[str]:
    return [f"w{seed}x{i * i % 97}" for i in range(n)]


def near_copies(seed: int) -> list[str]:
    """Three texts in one class of near-duplicates."""
    w = words(200, seed)
    return [" ".join(w), " ".join(w[:-1] + ["other"]), " ".join(["begin"] + w[1:])]


def rows() -> list[tuple]:
    a, b, c, d = map(near_copies, range(4))
    alone = [" ".join(words(60 + k, 10 + k)) for k in range(8)]
    out = [(1, t, "a") for t in a] + [(None, t, "b") for t in b] + [(2, c[0], "a"), (3, c[1], "b"), (3, c[2], None), (4, d[0], "a"), (1, d[1], "b")]
    out += [(1, alone[0], "a"), (None, alone[1], "b"), (None, alone[2], None), (5, alone[3], "a"), (5, alone[4], "a"), (6, alone[5], None), (7, alone[6], "é")]
    # Repeated rows, also of another source, and rows without words.
    out += [(8, alone[7], "a"), (8, alone[7], "a"), (8, alone[7], "b"), (9, None, "a"), (9, "", "a"), (None, None, None)]
    return [(*r, i, f"t{i}") for i, r in enumerate(out)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(rows(), SCHEMA).repartition(3)


def class_of(text: str | None):
    """Near copies here share most words that name their seed."""
    found = Counter(w.split("x")[0] for w in (text or "").split() if "x" in w)
    return found.most_common(1)[0][0] if found else ""


def test_near_duplicates_keep_one_row_of_each_class(spark, docs):
    out = pipeline.distinct_texts(spark, docs, "")
    assert out.columns == docs.columns
    left = [tuple(r) for r in out.collect()]
    assert set(left) <= set(rows()) and len(left) == len(set(left))
    low = lambda d: -(2**63) if d is None else d
    least = defaultdict(list)
    for r in rows():
        least[class_of(r[1])].append(low(r[0]))
    assert Counter((class_of(r[1]), low(r[0])) for r in left) == Counter((c, min(ids)) for c, ids in least.items())
    assert pipeline.distinct_texts(spark, docs.limit(0), "").collect() == []


def test_mixing_takes_each_row_as_often_as_its_own_share(spark, docs):
    mixed = mixing.mix_sources(docs.withColumnRenamed("row", "number"), row="number").collect()
    assert len(mixed) == len(rows())
    texts = {r[3]: r for r in rows()}
    for r in mixed:
        assert (r.doc_id, r.source, r["size"]) == (texts[r.number][0], texts[r.number][2], len((texts[r.number][1] or "").split()))
    want = Counter((r.doc_id, r.source, r["size"]) for r in mixed for _ in r.positions)
    taken, target = Counter(), {r.source: r.target for r in mixed}
    for (_, source, size), n in want.items():
        taken[source] += size * n
    assert all(target[s] - 1 <= taken[s] < target[s] + max(r["size"] for r in mixed) for s in target if target[s])
    out = pipeline.mixed_sources(spark, docs, "")
    assert out.columns == docs.columns
    got = [tuple(r) for r in out.collect()]
    assert set(got) <= set(rows())
    assert Counter((r[0], r[2], len((r[1] or "").split())) for r in got) == want
    assert pipeline.mixed_sources(spark, docs.limit(0), "").collect() == []
