"""Quality rules: hashed n-gram log-likelihood ratio of trusted text against the raw corpus."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import free_name
from .textkit import U64, Texts, blocks, covered, mixed, per_text, repeats

#: Buckets of hashed words and word pairs, fixed whatever the input: the model has as many numbers.
BUCKETS = 1 << 16
#: Added to a bucket's trusted and expected counts, so that rare ones lean to a ratio of 1.
SMOOTHING = 20.0
#: A document is kept from this mean log ratio of an n-gram upwards.
THRESHOLD = -0.4
#: Labels are broadcast up to so many rows, and joined by a shuffle beyond.
LABELS_SENT = 1_000_000
SYMBOL = np.zeros(256, bool)
SYMBOL[list(b"#*$%&|<>")] = True


def ngrams(texts: Texts, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bucket of each word, word pair and last three bytes of a word, and the text it is of."""
    pairs, whole = texts.windows(hashes, 2)
    size = np.minimum(texts.ends - texts.starts, 3)
    last = size.astype(U64) + U64(1 << 40)
    for i in range(3):
        last = last * U64(257) + np.where(size > i, texts.data[np.maximum(texts.ends - 1 - i, 0)], 0).astype(U64)
    every = np.concatenate([hashes, pairs[whole], mixed(last)])
    return (mixed(every) & U64(BUCKETS - 1)).astype(np.int64), np.concatenate([texts.word_doc, texts.word_doc[whole], texts.word_doc])


def base_counts(texts: Texts, hashes: np.ndarray) -> dict[str, np.ndarray]:
    data, n = texts.data, texts.n
    first = (data & 0xC0) != 0x80
    chars = np.zeros(len(data) + 1, np.int64)
    np.cumsum(first, out=chars[1:])
    lengths = chars[texts.ends] - chars[texts.starts]
    n_words = np.diff(texts.word_at)
    word_chars = per_text(lengths, texts.word_at)
    # Lines as they are, none of them hashed.
    n_dup_lines = np.zeros(n, np.int64)
    for i in range(n):
        lines = [x for x in texts.text(i).split(b"\n") if not x.isspace() and x]
        n_dup_lines[i] = len(lines) - len(set(lines))
    three, whole = texts.windows(hashes, 3)
    at = np.flatnonzero(whole)
    many, _ = repeats(mixed(three[at] + texts.word_doc[at].astype(U64) * U64(0xA24BAED4963EE407)))
    n_repeat = per_text(covered(at[many], 3, len(hashes)), texts.word_at)
    return {"n_words": n_words, "word_chars": word_chars, "n_symbols": per_text(SYMBOL[data], texts.at), "n_dup_lines": n_dup_lines, "n_repeat_words": n_repeat}


def ngram_ratios(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text: str = "text") -> np.ndarray:
    """Log of trusted over raw probability of each bucket, from all documents and all labels.

    Trusted are the documents with a label of quality 1; without any, all ratios are 0. Each task
    sums its rows before the shuffle; the driver gets a row a bucket, so a fixed number.
    """
    trusted = labels.where("quality = 1").select(F.col("doc_id").alias("_id")).distinct()
    if labels.count() <= LABELS_SENT:
        trusted = F.broadcast(trusted)
    rows = docs.select(F.col(id_col).alias("_doc"), F.col(text).alias("text"))
    rows = rows.join(trusted, F.col("_doc") == F.col("_id"), "left").select("text", F.col("_id").isNotNull().alias("trusted"))

    def count(batches):
        raw, good = np.zeros(BUCKETS, np.int64), np.zeros(BUCKETS, np.int64)
        for batch in batches:
            for part, texts in blocks(batch, "text"):
                texts.words()
                bucket, doc = ngrams(texts, texts.word_hashes())
                raw += np.bincount(bucket, minlength=BUCKETS)
                mine = np.asarray(part.column("trusted").to_numpy(zero_copy_only=False), bool)
                good += np.bincount(bucket[mine[doc]], minlength=BUCKETS)
        at = np.flatnonzero(raw)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(raw[at]), pa.array(good[at])], ["bucket", "raw", "good"])

    sums = rows.mapInArrow(count, "bucket long, raw long, good long").groupBy("bucket").agg(F.sum("raw").alias("raw"), F.sum("good").alias("good"))
    raw, good = np.zeros(BUCKETS), np.zeros(BUCKETS)
    for bucket, r, g in sums.collect():
        raw[bucket], good[bucket] = r, g
    if not good.sum():
        return np.zeros(BUCKETS)
    return np.log((good + SMOOTHING) / (good.sum() * raw / raw.sum() + SMOOTHING))


def score_quality(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text: str = "text", threshold: float = THRESHOLD, rows_only: bool = False) -> DataFrame:
    """Base counts, score and verdict of each row.

    The score is the mean log ratio of the document's words, word pairs and word ends (0 without words). A
    document is kept if it passes the base rules and its score reaches `threshold`. A null text has
    no words, so it fails. Repeated rows are scored alike, each for itself.
    Other columns are ignored. With `rows_only` the kept rows are returned instead, as they were.
    """
    ratios = ngram_ratios(docs, labels, id_col, text)

    def score(batches):
        for batch in batches:
            for part, texts in blocks(batch, whole):
                texts.words()
                hashes = texts.word_hashes()
                bucket, doc = ngrams(texts, hashes)
                n = np.bincount(doc, minlength=texts.n)
                scores = np.bincount(doc, ratios[bucket], texts.n) / np.maximum(n, 1)
                base = base_counts(texts, hashes)
                failed = (base["n_words"] < 50) | (100 * base["n_repeat_words"] > 50 * base["n_words"])
                kept = ~failed & (scores >= threshold)
                if rows_only:
                    yield part.select(names).filter(pa.array(kept))
                    continue
                columns = [*part.columns[1:], *(pa.array(x.astype(np.int64)) for x in base.values()), pa.array(failed), pa.array(kept), pa.array(scores)]
                yield pa.RecordBatch.from_arrays(columns, [*names, *base, "base_failed", "kept", "score"])

    names = list(docs.columns) if rows_only else [id_col]
    # The texts come first, under a name that no other column has.
    whole = free_name(docs, "whole")
    rows = docs.select(F.col(text).alias(whole), *(F.col(f"`{n}`") for n in names))
    kinds = ", ".join(f"`{n}` {docs.schema[n].dataType.simpleString()}" for n in names)
    counts = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, score double"
    return rows.mapInArrow(score, kinds if rows_only else f"{kinds}, {counts}")
