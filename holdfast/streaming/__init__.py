"""Observations that arrive as a stream, against a site index that doesn't."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.resolve import resolve


def resolve_stream(observations: DataFrame, index: DataFrame, path: str, checkpoint: str, **options):
    """Each micro-batch is resolved like a table and appended, partitioned by build. An extension: results are
    those of the batch analysis."""

    def append(rows: DataFrame, batch: int) -> None:
        resolve(rows, index, **options).withColumn("batch", F.lit(batch)).write.mode("append").partitionBy("build_id").parquet(path)

    return observations.writeStream.foreachBatch(append).option("checkpointLocation", checkpoint).start()
