"""Inferred attributes in normal form: own ones and the parents', without what others imply.

Concepts are taken level by level of the inferred hierarchy, so that parents are done first.  What a concept has is a set of
groups, kept once under an id that follows from its rows.  A concept's set follows from its own rows and its parents' sets,
so a level reduces each distinct combination of these once, however many concepts have it, and a concept that adds nothing
to one set shares it.  Redundancy is decided by equi-joins on closures (operators.groups).  A second pass looks again at
concepts with an attribute that starts a property chain, with the graph of the first pass complete.

Rows with the universal modifier mean all values, and are compared with their like only.  The graph isn't used in the first
pass, whose own rows it would have been built from piece by piece.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vocalith.operators import graph, groups
from vocalith.schema import CORE_MODULE
from vocalith.sources.shared import stored

ROW = ["typeId", "destinationId", "value", "universal"]


def with_universal(rows: DataFrame) -> DataFrame:
    """rows whose universal flag is false where they have none."""
    return rows if "universal" in rows.columns else rows.withColumn("universal", F.lit(False))


def _text(columns: Sequence[str]) -> Column:
    return F.concat_ws("/", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns])


def _content_id(rows: DataFrame, key: str) -> DataFrame:
    """(key, set_id) of rows (key, grp, ROW): equal sets of rows have equal ids."""
    return rows.groupBy(key).agg(F.md5(F.concat_ws(";", F.array_sort(F.collect_set(_text(["grp", *ROW]))))).alias("set_id"))


def _candidates(rows: DataFrame) -> DataFrame:
    """rows (conceptId, from_, grp, ROW) by group: each row of group 0 is one of its own. ord: own groups first, then by parent and number."""
    single = F.when(F.col("grp") == 0, _text(ROW)).otherwise("")
    keyed = rows.distinct().withColumn("gkey", F.concat_ws(":", F.col("from_").cast("string"), F.col("grp").cast("string"), single))
    return keyed.withColumn("ord", F.struct("from_", (F.col("grp") == 0).alias("zero_"), "grp", F.col("gkey")))


def _reflexive(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    """What is above each node (child): itself, too, whether pairs know it or not."""
    known = pairs.join(nodes, "child", "left_semi").select("child", "ancestor")
    return known.unionByName(nodes.select("child", F.col("child").alias("ancestor"))).distinct()


def reduce_groups(rows: DataFrame, types: DataFrame, near: DataFrame, chains: DataFrame | None = None, reach: DataFrame | None = None) -> DataFrame:
    """(conceptId, grp, ROW): the antichain of groups, numbered from 1 in order; single rows of group 0 stay there.

    rows: see _candidates. types, near: reflexive closures over all types and destinations of the rows.
    chains: first, second, whole. reach: property, child, ancestor along the graph of `second`.
    """
    # a row's number is its place among the concept's: of rows that imply each other the first stays
    place = F.row_number().over(Window.partitionBy("conceptId").orderBy("ord", *ROW)).cast("long")
    named = rows.withColumn("row", place).withColumnRenamed("grp", "number").withColumnRenamed("gkey", "grp")
    named = stored(named, "candidates")
    plain, concrete = named.filter("value is null"), named.filter("value is not null")
    alike = ["conceptId", "universal"]
    pairs = groups.stronger_pairs(plain, plain, alike, types, near).unionByName(groups.same_value_pairs(concrete, concrete, alike, types)).drop("universal")
    if chains is not None and reach is not None:
        up = plain.join(types.withColumnsRenamed({"child": "typeId", "ancestor": "first"}), "typeId").join(chains, "first")
        far = up.join(reach.withColumnsRenamed({"property": "second", "child": "destinationId", "ancestor": "far_"}), ["second", "destinationId"])
        left = far.select(*alike, F.col("row").alias("row_l"), F.col("grp").alias("group_l"), F.col("whole").alias("typeId"), F.col("far_").alias("destinationId"))
        right = plain.select(*alike, F.col("row").alias("row_r"), F.col("grp").alias("group_r"), "typeId", "destinationId")
        pairs = pairs.unionByName(left.join(right, [*alike, "typeId", "destinationId"]).select("conceptId", "row_l", "group_l", "row_r", "group_r")).distinct()
    pairs = stored(pairs, "pairs")
    inside = pairs.filter("group_l = group_r and row_l <> row_r").select("conceptId", F.col("group_l").alias("grp"), "row_l", "row_r")
    back = inside.select("conceptId", "grp", F.col("row_r").alias("row_l"), F.col("row_l").alias("row_r"), F.lit(True).alias("back_"))
    weak = inside.join(back, ["conceptId", "grp", "row_l", "row_r"], "left").filter("back_ is null or row_l < row_r").select("conceptId", "grp", F.col("row_r").alias("row")).distinct()
    kept = named.join(weak, ["conceptId", "grp", "row"], "left_anti")
    gone = weak.select("conceptId", F.col("grp").alias("group_r"), F.col("row").alias("row_r"))
    sizes = kept.groupBy("conceptId", "grp").agg(F.count(F.lit(1)).alias("n"), F.min("ord").alias("ord"))
    containment = groups.contained(pairs.join(gone, ["conceptId", "group_r", "row_r"], "left_anti"), sizes.drop("ord"), ["conceptId"])
    best = groups.antichain(sizes, containment, ["conceptId"], "ord").select("conceptId", "grp", F.col("ord").alias("place"))
    rows = kept.drop("ord").join(best, ["conceptId", "grp"])
    rank = F.dense_rank().over(Window.partitionBy("conceptId", F.col("number") != 0).orderBy("place"))
    return rows.select("conceptId", F.when(F.col("number") == 0, 0).otherwise(rank).cast("int").alias("grp"), *ROW).distinct()


def _first_pass(own: DataFrame, parents: DataFrame, level: DataFrame, types: DataFrame, near: DataFrame) -> DataFrame:
    """(conceptId, grp, ROW), level by level."""
    mine = stored(_content_id(own.select("conceptId", "grp", *ROW), "conceptId").withColumnRenamed("set_id", "own_id"), "own-sets")
    first = mine.groupBy("own_id").agg(F.min("conceptId").alias("conceptId"))
    own_rows = stored(own.join(first, "conceptId").select("own_id", "grp", *ROW).distinct(), "own-rows")
    has = sets = None  # (conceptId, set_id) and (set_id, grp, ROW)
    for n in range(int(level.agg(F.max("level")).first()[0] or 0) + 1):
        here = level.filter(F.col("level") == n).select(F.col("node").alias("conceptId"))
        keyed = here.join(mine, "conceptId", "left").withColumn("above", F.array().cast("array<string>"))
        if has is not None:
            up = parents.withColumnRenamed("child", "conceptId").join(here, "conceptId", "left_semi").join(has.withColumnRenamed("conceptId", "parent"), "parent")
            listed = F.array_distinct(F.transform(F.array_sort(F.collect_list(F.struct("parent", "set_id"))), lambda x: x["set_id"]))
            above = up.groupBy("conceptId").agg(listed.alias("above"))
            keyed = here.join(mine, "conceptId", "left").join(above, "conceptId", "left").withColumn("above", F.coalesce("above", F.array().cast("array<string>")))
        keyed = keyed.filter(F.col("own_id").isNotNull() | (F.size("above") > 0))
        shares = F.col("own_id").isNull() & (F.size("above") == 1)
        keyed = stored(keyed.withColumn("key", F.when(~shares, F.md5(F.concat_ws("|", F.coalesce("own_id", F.lit("")), F.concat_ws(",", "above"))))), "keys")
        found = keyed.filter("key is null").select("conceptId", F.element_at("above", 1).alias("set_id"))
        work = keyed.filter("key is not null").groupBy("key").agg(F.min("own_id").alias("own_id"), F.min("above").alias("above"))
        if not keyed.filter("key is not null").isEmpty():
            rows = work.join(own_rows, "own_id").select(F.col("key").alias("conceptId"), F.lit(0).alias("from_"), "grp", *ROW)
            if sets is not None:
                theirs = work.select("key", F.posexplode("above").alias("i", "set_id")).join(sets, "set_id")
                rows = rows.unionByName(theirs.select(F.col("key").alias("conceptId"), (F.col("i") + 1).alias("from_"), "grp", *ROW))
            reduced = stored(reduce_groups(_candidates(rows), types, near), "reduced")
            ids = _content_id(reduced, "conceptId").withColumnRenamed("conceptId", "key")
            found = found.unionByName(keyed.filter("key is not null").join(ids, "key").select("conceptId", "set_id"))
            one = ids.groupBy("set_id").agg(F.min("key").alias("conceptId"))
            new = reduced.join(one, "conceptId").select("set_id", "grp", *ROW)
            sets = stored(new, "sets") if sets is None else sets.unionByName(stored(new.join(sets.select("set_id").distinct(), "set_id", "left_anti"), "sets"))
        found = stored(found, "has")
        has = found if has is None else has.unionByName(found)
        if n % graph.MERGED == graph.MERGED - 1:
            has, sets = stored(has, "has"), sets if sets is None else stored(sets, "sets")
    if sets is None:
        return own.select("conceptId", "grp", *ROW).limit(0)
    return stored(has.join(sets, "set_id").select("conceptId", "grp", *ROW), "first")


def inferred_attributes(own: DataFrame, parents: DataFrame, types: DataFrame, is_a: DataFrame, chains: DataFrame | None = None) -> DataFrame:
    """(conceptId, grp, ROW) of all concepts. own: conceptId, grp, ROW. types and is_a: closures, child to ancestor."""
    own, parents = stored(with_universal(own), "nf"), stored(parents, "nf")
    types = stored(_reflexive(types, own.select(F.col("typeId").alias("child")).distinct()), "types")
    near = stored(_reflexive(is_a, own.select(F.col("destinationId").alias("child")).filter("child is not null").distinct()), "near")
    level = stored(graph.levels(parents).unionByName(
        own.select(F.col("conceptId").alias("node"), F.lit(0).alias("level")).distinct()
    ).groupBy("node").agg(F.max("level").alias("level")), "levels")
    first = _first_pass(own, parents, level, types, near)
    if chains is None or chains.isEmpty():
        return first
    reach, nodes = None, stored(first.select(F.col("destinationId").alias("child")).filter("child is not null").distinct(), "nodes")
    for p in [r.second for r in chains.select("second").distinct().collect()]:  # properties of chains are few
        edges = first.filter(F.col("typeId") == p).filter("destinationId is not null").select(F.col("conceptId").alias("child"), F.col("destinationId").alias("parent"))
        # what is reached along the graph, and then up the hierarchy; a path from a destination meets destinations alone
        along = graph.closure(edges.join(nodes, "child", "left_semi")).unionByName(nodes.select("child", F.col("child").alias("ancestor")))
        up = along.withColumnRenamed("ancestor", "mid").join(is_a.withColumnRenamed("child", "mid"), "mid").select("child", "ancestor")
        one = along.unionByName(up).distinct().withColumn("property", F.lit(p).cast("long"))
        reach = one if reach is None else reach.unionByName(one)
    again = first.join(chains.select(F.col("first").alias("typeId")).distinct(), "typeId", "left_semi").select(F.col("conceptId").alias("child")).distinct()
    mine = own.withColumnRenamed("conceptId", "child").join(again, "child", "left_semi").select(F.col("child").alias("conceptId"), F.lit(0).cast("long").alias("from_"), "grp", *ROW)
    theirs = parents.join(again, "child", "left_semi").join(first.withColumnRenamed("conceptId", "parent"), "parent").select(F.col("child").alias("conceptId"), F.col("parent").alias("from_"), "grp", *ROW)
    reach = stored(reach, "reach")
    # concepts with equal candidates, their parents' included, are reduced once
    rows = stored(_candidates(mine.unionByName(theirs)), "second-rows")
    content = F.md5(F.concat_ws(";", F.array_sort(F.collect_set(_text(["from_", "grp", *ROW])))))
    keys = stored(rows.groupBy("conceptId").agg(content.alias("key")), "second-keys")
    one = stored(keys.groupBy("key").agg(F.min("conceptId").alias("conceptId")), "second-sets")
    reduced = reduce_groups(rows.join(one, "conceptId", "left_semi"), types, near, chains, reach)
    named = stored(reduced.join(one, "conceptId").drop("conceptId"), "second")
    second = stored(keys.join(named, "key").select("conceptId", "grp", *ROW), "second")
    return first.join(again.withColumnRenamed("child", "conceptId"), "conceptId", "left_anti").unionByName(second)


def stable_numbers(new: DataFrame, published: DataFrame, core: int = CORE_MODULE) -> DataFrame:
    """new with the group numbers of equal published groups; a group that holds such a number takes the other's.

    Of equal published groups one of the core module counts, then the smallest number; published: conceptId, grp, ROW,
    and moduleId if modules are known.  Both sides are dealt once, by concept; groups are equal if their rows' 128-bit hashes
    are, joined without an order.  Where no two of a concept's groups claim one number each takes what it wants; only the other
    concepts need exchanges that follow one another: a fold over the concept's groups.
    """
    new, published = with_universal(new), with_universal(published)
    modules = published if "moduleId" in published.columns else published.withColumn("moduleId", F.lit(None).cast("long"))
    other = ~F.coalesce(F.col("moduleId") == core, F.lit(False))
    side = lambda df, old, other_: df.select("conceptId", "grp", *ROW, F.lit(old).alias("old_"), other_.alias("other_"))
    hashed = lambda seed: F.xxhash64(F.lit(seed), "typeId", "destinationId", F.coalesce("value", F.lit("")), "universal")
    both = side(new, False, F.lit(False)).unionByName(side(modules.filter("grp <> 0"), True, other)).repartition("conceptId")
    both = both.withColumns({"a_": hashed(1), "b_": hashed(2)})
    # a row that a group has twice counts once
    again = F.row_number().over(Window.partitionBy("conceptId", "old_", "grp", "a_", "b_").orderBy("a_"))
    within = Window.partitionBy("conceptId", "old_", "grp")
    once = lambda c: F.bit_xor(F.when(F.col("again_") == 1, F.col(c))).over(within)
    # a row of group 0 is a group of its own
    own = lambda c, whole: F.when(F.col("grp") == 0, c).otherwise(whole)
    of_group = both.withColumn("again_", again).withColumns({
        "x_": own(F.col("a_"), once("a_")), "y_": own(F.col("b_"), once("b_")),
        "n_": own(F.lit(1), F.count(F.when(F.col("again_") == 1, 1)).over(within)), "other_": F.max("other_").over(within),
    })
    best = F.min(F.when(F.col("old_"), F.struct("other_", "grp"))).over(Window.partitionBy("conceptId", "x_", "y_", "n_"))
    marked = stored(of_group.withColumn("wanted", best["grp"]).filter("not old_").select("conceptId", "grp", *ROW, "wanted"), "wanted")
    # group 0's rows with one wanted number are equal, and so one group
    claim = lambda c, asked: F.struct(F.col(c).alias("number"), F.lit(asked).alias("asked"))
    claims = marked.select("conceptId", "grp", F.explode(F.array(claim("grp", False), claim("wanted", True))).alias("c"))
    claimed = claims.filter("c.number is not null").groupBy("conceptId", "c.number").agg(F.max("c.asked").alias("asked"), F.min("grp").alias("low"), F.max("grp").alias("high"))
    crowded = stored(claimed.filter("asked and low <> high").select("conceptId").distinct(), "crowded")
    if crowded.isEmpty():
        return marked.select("conceptId", F.coalesce("wanted", "grp").alias("grp"), *ROW)
    part = F.when(F.col("grp") == 0, _text(ROW)).otherwise(F.lit(""))
    marked = marked.withColumn("part", part)
    mine = marked.join(crowded, "conceptId", "left_semi").select("conceptId", "grp", "part", "wanted").distinct()
    group = F.struct("grp", "part", "wanted", F.col("grp").alias("to"))
    each = mine.groupBy("conceptId").agg(F.sort_array(F.collect_list(group)).alias("all"))

    def exchange(state, i):
        me = F.get(state, i)
        moved = F.transform(state, lambda g, j: g.withField("to", F.when(j == i, me["wanted"]).when(g["to"] == me["wanted"], me["to"]).otherwise(g["to"])))
        return F.when(me["wanted"].isNull() | (me["to"] == me["wanted"]), state).otherwise(moved)

    folded = F.aggregate(F.sequence(F.lit(0), F.size("all") - 1), F.col("all"), exchange)
    renumbered = each.select("conceptId", F.explode(folded).alias("g")).select("conceptId", "g.grp", "g.part", "g.to")
    joined = marked.join(stored(renumbered, "exchanged"), ["conceptId", "grp", "part"], "left")
    return joined.select("conceptId", F.coalesce("to", "wanted", "grp").alias("grp"), *ROW)
