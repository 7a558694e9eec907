"""From raw documents to packed training sequences, in five stages.

Each stage takes (spark, docs, sf_dir) and works on all that the one before has kept; it is written
as Parquet and read again for the next. All but the last return the columns of the documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from holdfast.llm.exact import without_copies
from holdfast.llm.mixing import mix_sources
from holdfast.llm.ngrams import near_duplicates
from holdfast.llm.packing import pack_documents
from holdfast.llm.quality import score_quality
from holdfast.llm.queries import vocabulary
from holdfast.llm.shared import documents, free_name, written

#: The stages aren't SQL: hashed n-grams, MinHash and tokens.
ORACLE_SQL = None


def numbered(docs: DataFrame, name: str) -> tuple[DataFrame, str]:
    """The documents, written with a number for each row, and its name: ids may repeat or be null, so decisions come back by it."""
    row = free_name(docs, "row_number")
    return written(docs.withColumn(row, F.monotonically_increasing_id()), name), row


def good_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents that the quality rules reject; a null text has no words and goes.

    Each row is judged for itself, whatever its id; a null id is in no label. All columns are kept.
    """
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return score_quality(docs, labels, rows_only=True)


def single_texts(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts: that of the largest id; null is below all, and of repeated rows one stays."""
    return without_copies(docs)


def distinct_texts(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near-duplicates: the one of the least id (null is the least).

    Rows are told by a written number: of repeated rows, and of near copies that share an id or have none, one stays.
    All other columns are kept as they are; an empty table gives an empty one.
    """
    rows, row = numbered(docs, "near-rows")
    first = written(near_duplicates(rows, row=row).where("first").select(row), "near-first")
    # The numbers grow with the documents: merged at every size, never broadcast.
    return rows.join(first.hint("merge"), row, "left_semi").select(*docs.columns)


def mixed_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row of a document for each pass of the mix that takes it, range-sorted by their places in the joint stream.

    The last pass over a source ends within a document, which is taken whole: a source has less than one
    document more than its target. Rows are told by a written number, so null and repeated ids are rows
    like others; documents without words are in no pass; an empty table gives an empty one.
    """
    rows, row = numbered(docs, "mix-rows")
    position = free_name(rows, "position")
    mix = mix_sources(rows, row=row).select(row, F.explode("positions").alias(position))
    mix = written(mix, "mix")
    rows = rows.join(mix.hint("merge"), row)
    return rows.orderBy(position, row).select(*docs.columns)


def packed_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences of at most 1,024 tokens."""
    return pack_documents(docs, vocabulary())


STAGES = [
    ("quality rules", good_documents),
    ("exact dedup", single_texts),
    ("n-gram Jaccard join", distinct_texts),
    ("mixing sources", mixed_sources),
    ("packing", packed_sequences),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = written(docs, f"stage-{i + 1}")
    return docs
