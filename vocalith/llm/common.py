"""Small helpers shared by the training-data operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vocalith.sources.shared import discard, fresh_path, shared_dir, stored

__all__ = ["A_Z", "discard", "fresh_path", "lower_ascii", "shared_dir", "stored", "table", "total_bytes", "utf8", "words"]

A_Z = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def words(text: Column) -> Column:
    """array<string> of the words of a text; null has none."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), "[ \\t-\\r]+", -1), "")


def lower_ascii(c: Column) -> Column:
    return F.translate(c, A_Z, A_Z.lower())


def total_bytes(docs: DataFrame, column: str) -> tuple[int, int]:
    """Rows, and UTF-8 bytes of a column: two sums, to choose the number of shards."""
    row = docs.agg(F.count(F.lit(1)), F.sum(F.octet_length(F.col(column)))).first()
    return int(row[0]), int(row[1] or 0)


def utf8(batch, name: str) -> list[bytes]:
    """The bytes of a string column of an Arrow batch; null is empty."""
    import pyarrow as pa

    return [x or b"" for x in batch.column(name).cast(pa.binary()).to_pylist()]
