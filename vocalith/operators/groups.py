"""Role groups: numbering, containment under subsumption, and antichains.

A group is a set of rows with one group key; containment of one group in another is relational division, counted:
group A is as strong as B if as many rows of B as B has find a row of A that is as strong.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def numbered(rows: DataFrame, owner: Sequence[str], order: Sequence[Column], group: str) -> DataFrame:
    """Consecutive group numbers within an owner, in the order given; rows of group 0 stay there."""
    some = F.col(group) != 0
    rank = F.dense_rank().over(Window.partitionBy(*owner, some).orderBy(*order))
    return rows.withColumn(group, F.when(some, rank).otherwise(0).cast("int"))


def merged_numbers(rows: DataFrame, owner: Sequence[str], part: str, group: str) -> DataFrame:
    """Groups of an owner's several axioms next to each other: group 0 is shared, others follow those of earlier axioms."""
    return numbered(rows, owner, [F.col(part), F.col(group)], group)


def stronger_pairs(left: DataFrame, right: DataFrame, owner: Sequence[str], types: DataFrame, values: DataFrame) -> DataFrame:
    """(owner, row_l, group_l, row_r, group_r): a left row whose type and destination are those of the right row or below.

    left and right: owner, row, grp, typeId, destinationId. types and values: reflexive closures (child, ancestor). The
    closures turn the comparison into equi-joins; no pair of rows is tried.
    """
    up = (
        left.join(types.withColumnsRenamed({"child": "typeId", "ancestor": "type_up"}), "typeId")
        .join(values.withColumnsRenamed({"child": "destinationId", "ancestor": "dest_up"}), "destinationId")
        .select(*owner, F.col("row").alias("row_l"), F.col("grp").alias("group_l"), F.col("type_up").alias("typeId"), F.col("dest_up").alias("destinationId"))
    )
    weak = right.select(*owner, F.col("row").alias("row_r"), F.col("grp").alias("group_r"), "typeId", "destinationId")
    return up.join(weak, [*owner, "typeId", "destinationId"]).select(*owner, "row_l", "group_l", "row_r", "group_r").distinct()


def same_value_pairs(left: DataFrame, right: DataFrame, owner: Sequence[str], types: DataFrame) -> DataFrame:
    """As stronger_pairs, for concrete values: equal as text, of the same type or one below."""
    up = left.join(types.withColumnsRenamed({"child": "typeId", "ancestor": "type_up"}), "typeId").select(
        *owner, F.col("row").alias("row_l"), F.col("grp").alias("group_l"), F.col("type_up").alias("typeId"), "value"
    )
    weak = right.select(*owner, F.col("row").alias("row_r"), F.col("grp").alias("group_r"), "typeId", "value")
    return up.join(weak, [*owner, "typeId", "value"]).select(*owner, "row_l", "group_l", "row_r", "group_r").distinct()


def contained(pairs: DataFrame, sizes: DataFrame, owner: Sequence[str]) -> DataFrame:
    """(owner, strong, weak): groups of which each row of `weak` has a stronger one in `strong`. sizes: owner, grp, n."""
    met = pairs.groupBy(*owner, "group_l", "group_r").agg(F.count_distinct("row_r").alias("met_"))
    need = sizes.select(*owner, F.col("grp").alias("group_r"), F.col("n").alias("need_"))
    return met.join(need, [*owner, "group_r"]).filter("met_ = need_").select(
        *owner, F.col("group_l").alias("strong"), F.col("group_r").alias("weak")
    )


def item_sets(rows: DataFrame, owner: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """Distinct sets of an owner's groups, (owner, grp, items) under the smallest group that has it, and (owner, grp, member).

    rows: owner, grp, item.  Groups with equal items are compared once, however many they are.
    """
    each = rows.groupBy(*owner, "grp").agg(F.array_sort(F.collect_set("item")).alias("items"))
    sets = each.groupBy(*owner, "items").agg(F.min("grp").alias("grp")).select(*owner, "grp", "items")
    members = each.withColumnRenamed("grp", "member").join(sets, [*owner, "items"]).select(*owner, "grp", "member")
    return sets, members


def set_containment(sets: DataFrame, owner: Sequence[str]) -> DataFrame:
    """(owner, strong, weak) of distinct sets: the strong one has all items of the weak one, and more.

    A set that holds another holds its rarest item too, so each set meets only those of its owner with that item that are
    larger, and these are compared whole.
    """
    items = sets.select(*owner, "grp", F.explode("items").alias("item_"))
    seen = items.groupBy(*owner, "item_").agg(F.count(F.lit(1)).alias("seen_"))
    rarest = items.join(seen, [*owner, "item_"]).groupBy(*owner, "grp").agg(F.min_by("item_", F.struct("seen_", "item_")).alias("item_"))
    weak = sets.join(rarest, [*owner, "grp"]).select(*owner, "item_", F.col("grp").alias("weak"), F.col("items").alias("less_"))
    strong = items.join(sets, [*owner, "grp"]).select(*owner, "item_", F.col("grp").alias("strong"), F.col("items").alias("more_"))
    holds = (F.size("more_") > F.size("less_")) & (F.size(F.array_except("less_", "more_")) == 0)
    empty = sets.filter(F.size("items") == 0).select(*owner, F.col("grp").alias("weak"))
    below = empty.join(sets.filter(F.size("items") > 0).select(*owner, F.col("grp").alias("strong")), list(owner))
    return strong.join(weak, [*owner, "item_"]).filter(holds).select(*owner, "strong", "weak").unionByName(below.select(*owner, "strong", "weak"))


def antichain(groups: DataFrame, containment: DataFrame, owner: Sequence[str], order: str) -> DataFrame:
    """Groups that no other contains; of groups that contain each other, the first by `order`."""
    ordered = groups.select(*owner, F.col("grp").alias("strong"), F.col(order).alias("strong_order_"))
    other = groups.select(*owner, F.col("grp").alias("weak"), F.col(order).alias("weak_order_"))
    back = containment.select(*owner, F.col("weak").alias("strong"), F.col("strong").alias("weak"), F.lit(True).alias("back_"))
    beaten = (
        containment.filter("strong <> weak")
        .join(back, [*owner, "strong", "weak"], "left")
        .join(ordered, [*owner, "strong"])
        .join(other, [*owner, "weak"])
        .filter("back_ is null or strong_order_ < weak_order_")
        .select(*owner, F.col("weak").alias("grp"))
        .distinct()
    )
    return groups.join(beaten, [*owner, "grp"], "left_anti")
