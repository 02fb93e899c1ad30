"""The driver's tables read as a terminology: one view of concepts and edges that the queries share.

Regions, nations, customers, suppliers, parts and orders are concepts, in ranges of their own; foreign keys are is-a
edges from child to parent.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: First identifier of each range.
REGION, NATION, BRAND, TYPE, SIZE = 1_000, 2_000, 3_000, 4_000, 5_000
SUPPLIER, CUSTOMER, ORDER, PART = 10_000_000, 20_000_000, 30_000_000, 40_000_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def is_a(spark: SparkSession, sf_dir: str, customers: bool = True) -> DataFrame:
    """(child, parent): nation - region, supplier - nation, customer - nation."""
    edge = lambda t, c, c0, p, p0: table(spark, sf_dir, t).select((F.col(c) + F.lit(c0)).cast("long").alias("child"), (F.col(p) + F.lit(p0)).cast("long").alias("parent"))
    out = edge("nation", "n_nationkey", NATION, "n_regionkey", REGION).unionByName(edge("supplier", "s_suppkey", SUPPLIER, "s_nationkey", NATION))
    return out.unionByName(edge("customer", "c_custkey", CUSTOMER, "c_nationkey", NATION)) if customers else out
