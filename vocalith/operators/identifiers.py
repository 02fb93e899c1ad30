"""Dense numbers, and identifiers made of them."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vocalith.sources.shared import stored

#: Bits of a row's place in its partition, as Spark numbers rows.
PLACE_BITS = 33


def dense_numbers(rows: DataFrame, order: Sequence[Column | str], name: str = "number", first: int = 1) -> DataFrame:
    """rows with numbers from `first` without gaps, by `order`, which must tell rows apart.

    Rows are sorted by ranges and stored with their partition and place; a number is the place plus the rows of all earlier
    partitions.  Only the partitions' counts, one row for each task, are summed in one place.
    """
    placed = stored(rows.orderBy(*order).withColumn("at_", F.monotonically_increasing_id()), "placed")
    part, place = F.shiftright("at_", PLACE_BITS), F.col("at_").bitwiseAND(F.lit((1 << PLACE_BITS) - 1))
    counts = placed.groupBy(part.alias("part_")).agg(F.count(F.lit(1)).alias("n_"))
    before = F.sum("n_").over(Window.orderBy("part_").rowsBetween(Window.unboundedPreceding, -1))
    starts = counts.select("part_", F.coalesce(before, F.lit(0)).alias("before_"))
    return placed.withColumn("part_", part).join(F.broadcast(starts), "part_").withColumn(name, F.col("before_") + place + first).drop("at_", "part_", "before_")


def supplied(rows: DataFrame, id_column: str, order: Sequence[Column | str], supplier: Callable[[Column], Column], first: int = 1) -> DataFrame:
    """rows whose missing ids are what the supplier makes of their numbers among those without one."""
    missing = dense_numbers(rows.filter(F.col(id_column).isNull()).drop(id_column), order, "number_", first)
    made = missing.withColumn(id_column, supplier(F.col("number_"))).select(rows.columns)
    return rows.filter(F.col(id_column).isNotNull()).unionByName(made)
