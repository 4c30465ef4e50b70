"""Helpers shared by the text operators."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wardlight.session import materialize

__all__ = ["doc_key", "materialize", "read_table", "short_lived_shuffles", "slices_by_bytes", "small"]


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def doc_key() -> F.Column:
    """64 bits that tell rows of different id or text apart; repeated rows share one key."""
    return F.xxhash64(F.col("doc_id"), F.col("text"))


@contextmanager
def short_lived_shuffles(spark: SparkSession):
    """Shuffle files of the jobs inside go when their job ends; later jobs must not reuse them."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, None)
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)


def small(batches: Iterator[pa.RecordBatch], rows: int = 512) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of at most `rows`, so that few texts are Python objects at a time."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def slices_by_bytes(texts: list[bytes], most: int) -> Iterator[slice]:
    """Consecutive slices of at most `most` bytes together; a longer text is a slice of its own."""
    start = total = 0
    for i, text in enumerate(texts):
        if i > start and total + len(text) > most:
            yield slice(start, i)
            start, total = i, 0
        total += len(text)
    if start < len(texts):
        yield slice(start, len(texts))
