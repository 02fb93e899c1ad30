"""States of versioned rows: which version of a component counts, and what is left without an owner.

All are aggregates or anti-joins on the component's key; nothing depends on the order in which rows arrive.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def last_of(rows: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """keys, last_: the last version of each key by `order`, as a struct of all other columns. Of a stream, too."""
    rest = [c for c in rows.columns if c not in keys]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("last_"))


def unpacked(last: DataFrame, columns: Sequence[str], keys: Sequence[str]) -> DataFrame:
    return last.select(*[F.col(c) if c in keys else F.col(f"last_.`{c}`").alias(c) for c in columns])


def latest_state(rows: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """The last version of each key by `order`. max_by combines before the shuffle, so no key's history is sorted."""
    return unpacked(last_of(rows, keys, order), rows.columns, keys)


def overlay(snapshot: DataFrame, delta: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """Snapshot state with a delta on top: any delta row outranks the snapshot's, then the order decides."""
    both = snapshot.withColumn("source_rank", F.lit(0)).unionByName(delta.withColumn("source_rank", F.lit(1)))
    return latest_state(both, keys, [F.col("source_rank"), *order])


def orphans(rows: DataFrame, owner: str, owners: DataFrame, key: str) -> DataFrame:
    """Owners that rows name and that don't exist."""
    named = rows.select(F.col(owner).alias(key)).distinct()
    return named.join(owners.select(key), key, "left_anti")


def retired(rows: DataFrame, owner: str, inactive: DataFrame) -> DataFrame:
    """All rows of inactivated owners."""
    return rows.join(inactive.withColumnRenamed(inactive.columns[0], owner), owner, "left_semi").select(rows.columns)


def newly_inactive(before: DataFrame, now: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Ids that are inactive now and weren't, and those that were and aren't."""
    key = before.columns[0]
    return now.join(before, key, "left_anti"), before.join(now, key, "left_anti")


def ungrouped_roles(roles: DataFrame, children: DataFrame, content_types: DataFrame, default: Sequence[int]) -> DataFrame:
    """(contentTypeId, attributeId): roles of a content type and of its direct children; the default where none is found.

    roles: contentTypeId, attributeId. children: parent, child. content_types: contentTypeId.
    """
    own = content_types.select("contentTypeId", F.col("contentTypeId").alias("from_"))
    below = content_types.join(children, content_types.contentTypeId == children.parent).select("contentTypeId", F.col("child").alias("from_"))
    found = own.unionByName(below).join(roles.withColumnRenamed("contentTypeId", "from_"), "from_").select("contentTypeId", "attributeId").distinct()
    bare = content_types.join(found, "contentTypeId", "left_anti")
    fallback = bare.select("contentTypeId", F.explode(F.array(*[F.lit(x).cast("long") for x in default])).alias("attributeId"))
    return found.unionByName(fallback)
