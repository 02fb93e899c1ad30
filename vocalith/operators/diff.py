"""From published and generated relationships to a delta: matches, moves between groups, reuse of retired ids.

Both sides are one table, dealt once by owner and content, in which equal rows stand beside each other, nulls equal to nulls;
nothing is compared in a loop.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Observation, Window
from pyspark.sql import functions as F

from vocalith.sources.shared import stored


def _null_safe(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str) -> DataFrame:
    """Join on keys that may be null: as structs, which compare null fields as equal."""
    l = left.withColumn("key_", F.struct(*[F.col(k) for k in keys]))
    r = right.withColumn("key_", F.struct(*[F.col(k) for k in keys])).drop(*keys)
    return l.join(r, "key_", how)


def compare(old: DataFrame, new: DataFrame, owner: str, content: Sequence[str], group: str, is_a: int, module: str = "moduleId") -> DataFrame:
    """Changes that turn `old` into `new`: action (add, move, remove), id (null if added), and the row as it shall be.

    old: id, module, owner, content and group; new: owner, content and group; typeId is among content.
    * Equal rows stay; of several old rows equal to one new row, that of the highest module stays.
    * An old row of group 0, no is-a, whose content a new row has in a group of its own becomes that row, with its id,
      unless that new row exists already.
    * Other old rows go and other new rows are added.
    """
    keys = [owner, *content]
    full = [*keys, group]
    none = F.lit(None)
    before = old.select(*full, F.col(module).alias("module_"), F.col("id"), F.lit(False).alias("new_"))
    after = new.select(*full, none.cast(old.schema[module].dataType).alias("module_"), none.cast(old.schema["id"].dataType).alias("id"), F.lit(True).alias("new_"))
    # both sides meet once, dealt by all that makes rows equal; nulls are
    alike = Window.partitionBy(*full)
    first = Window.partitionBy(*full, "new_").orderBy(F.col("module_").desc(), "id")
    both = before.unionByName(after).withColumns({"nth_": F.row_number().over(first), "hit_": F.min("new_").over(alike) != F.max("new_").over(alike)})
    marked = stored(both.filter("not new_ or nth_ = 1"), "marked")
    double = marked.filter("not new_ and hit_ and nth_ > 1")
    loose = marked.filter("not new_ and not hit_")
    fresh = marked.filter("new_ and not hit_").select(*full)
    # alone in their group, counted over all new rows
    alone = marked.filter("new_").groupBy(owner, group).agg(F.count(F.lit(1)).alias("n_")).filter("n_ = 1").select(owner, group)
    targets = fresh.join(alone, [owner, group], "left_semi")
    can_move = loose.filter((F.col(group) == 0) & (F.col("typeId") != is_a)).select("id", *keys)
    met = _null_safe(can_move, targets.withColumnRenamed(group, "to_"), keys, "inner").drop("key_")
    by_row = Window.partitionBy("id").orderBy("to_")
    by_target = Window.partitionBy(F.struct(*keys, F.col("to_"))).orderBy("id")
    moves = met.withColumn("r_", F.row_number().over(by_row)).filter("r_ = 1").withColumn("t_", F.row_number().over(by_target)).filter("t_ = 1")
    moves = stored(moves.select("id", *keys, F.col("to_").alias(group)), "moves")
    gone = loose.join(moves.select("id"), "id", "left_anti").unionByName(double.select("id", *[c for c in loose.columns if c != "id"]))
    added = _null_safe(fresh, moves.select(*full).withColumn("moved_", F.lit(True)), full, "left").filter("moved_ is null")
    out = lambda df, action, id_: df.select(F.lit(action).alias("action"), id_.alias("id"), *full)
    return (
        out(added, "add", F.lit(None).cast("long"))
        .unionByName(out(moves, "move", F.col("id")))
        .unionByName(out(gone, "remove", F.col("id")))
    )


def reuse_ids(added: DataFrame, pool: DataFrame, keys: Sequence[str]) -> DataFrame:
    """added with the id of the retired row that equals it on keys, the most recent one. pool: id, effectiveTime, keys."""
    last = pool.groupBy(*keys).agg(F.max_by("id", F.struct("effectiveTime", "id")).alias("reused_id"))
    return added.join(last, list(keys), "left")


def change_counts(delta: DataFrame, action: str = "action") -> DataFrame:
    return delta.groupBy(action).agg(F.count(F.lit(1)).alias("n"))


def counted(delta: DataFrame) -> tuple[DataFrame, Observation]:
    """delta, and the numbers of its changes, which are taken while it is written: added, moved, removed, inactivated.

    delta: action, inactivated (removed since its owner is inactive now); such rows don't count as removed.
    """
    changes = Observation()
    number = lambda name, is_: F.count(F.when(is_, 1)).alias(name)
    dead = F.coalesce("inactivated", F.lit(False))
    removed = F.col("action") == "remove"
    kinds = (number("added", F.col("action") == "add"), number("moved", F.col("action") == "move"), number("removed", removed & ~dead), number("inactivated", removed & dead))
    return delta.observe(changes, *kinds), changes


def reconcile(published: DataFrame, current: DataFrame, key: str, text: str) -> DataFrame:
    """key, status (new, modified, unchanged, missing) of regenerated texts against published ones, one for each key."""
    p = published.select(key, F.col(text).alias("published"))
    c = current.select(key, F.col(text).alias("current"))
    both = p.join(c, key, "full_outer")
    status = (
        F.when(F.col("published").isNull(), "new")
        .when(F.col("current").isNull(), "missing")
        .when(F.col("published") == F.col("current"), "unchanged")
        .otherwise("modified")
    )
    return both.withColumn("status", status)
