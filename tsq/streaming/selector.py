"""Selectors over streams, and results pulled batch by batch.

A selector is a filter and a projection, so the same plan serves a streaming DataFrame:
register it in a catalog and query it.  Windows and rates of streams keep state without
bound and are refused.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from tsq.engine import Engine
from tsq.errors import Unsupported
from tsq.plans.logical import Scan
from tsq.timemath import Instant


def read_stream(spark: SparkSession, path: str, like: DataFrame, files_per_batch: int = 100) -> DataFrame:
    """New Parquet files of a directory as a stream with the schema of ``like``."""
    return spark.readStream.schema(like.schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def select_stream(engine: Engine, text: str, at: Instant | str | None = None) -> DataFrame:
    """A selector over a registered streaming table."""
    plan = engine.parse(text, at)
    if not isinstance(plan, Scan):
        raise Unsupported("only selectors run over streams")
    return engine.run(plan)


def once_each(stream: DataFrame, time: str, sample_id: str, lateness: str) -> DataFrame:
    """Redelivered samples dropped, those that arrive within ``lateness`` of the first."""
    timed = stream.withColumn(time, F.col(time).cast("timestamp"))  # watermarks need a zone
    return timed.withWatermark(time, lateness).dropDuplicatesWithinWatermark([sample_id])


def pull(df: DataFrame, prefetch: bool = True) -> Iterator[Row]:
    """Rows one partition after another; the driver holds one partition, or two."""
    return df.toLocalIterator(prefetchPartitions=prefetch)
