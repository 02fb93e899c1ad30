"""Subsumption by completion rules for the EL family, as a semi-naive fixpoint over two tables.

sub(c, d): c is subsumed by d.  link(c, r, d): every c has an r to some d.  Each round joins what is new on one side
of each rule with what is known on the other; the new pairs are those that an anti-join leaves.  Rules and notation
follow the published calculi (Baader, Brandt and Lutz 2005; Kazakov, Krötzsch and Simančík 2014).
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vocalith.functions.axioms import object_id
from vocalith.operators import graph
from vocalith.sources.shared import stored


#: The class without members.
BOTTOM = object_id("owl:Nothing")


def _with_bottom(rules: DataFrame) -> DataFrame:
    """What has a role to nothing is nothing: for each role, where the class without members is named at all."""
    named = rules.filter((F.col("a") == BOTTOM) | (F.col("b") == BOTTOM) | (F.col("c") == BOTTOM))
    if named.isEmpty():
        return rules
    roles = rules.filter("rule = 'exists'").select(F.col("b").alias("role")).distinct()
    # a number that no expression has, since its text isn't one
    some = (-F.abs(F.xxhash64(F.lit("some of nothing"), "role")) - 2).alias("a")
    none, null = F.lit(None).cast("long"), F.lit(None).cast("int")
    exists = roles.select(F.lit("exists").alias("rule"), some, F.col("role").alias("b"), F.lit(BOTTOM).alias("c"), null.alias("n"))
    told = roles.select(F.lit("told").alias("rule"), some, F.lit(BOTTOM).alias("b"), none.alias("c"), null.alias("n"))
    return rules.unionByName(exists).unionByName(told)


def unsatisfiable(subsumed: DataFrame) -> DataFrame:
    """concept: those below the class without members."""
    return subsumed.filter(F.col("ancestor") == BOTTOM).select(F.col("child").alias("concept")).distinct()


def _union(frames: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames).distinct()


def binary_intersections(member: DataFrame, told: DataFrame) -> tuple[DataFrame, DataFrame]:
    """((left, right, both), (child, parent)): intersections as steps of two, and what the last step of each is below.

    member: d, x. Members are ordered by how few concepts are told to be below them, the rarest first, and each prefix of two
    or more is one auxiliary concept, which intersections with the same prefix share.
    """
    times = told.groupBy(F.col("parent").alias("d")).agg(F.count(F.lit(1)).alias("times"))
    ranked = member.join(times, "d", "left").groupBy("x").agg(F.array_sort(F.collect_set(F.struct(F.coalesce("times", F.lit(0)).alias("times"), "d"))).alias("all"))
    listed = ranked.select("x", F.transform("all", lambda m: m["d"]).alias("m"))
    # numbers that no expression has, since their text isn't one
    prefix = lambda n: F.when(n == 1, F.get("m", F.lit(0))).otherwise(-F.abs(F.xxhash64(F.lit("all of"), F.slice("m", F.lit(1), n))) - 2)
    steps = listed.filter(F.size("m") > 1).select("m", F.explode(F.sequence(F.lit(2), F.size("m"))).alias("k"))
    pairs = steps.select(prefix(F.col("k") - 1).alias("left"), F.get("m", F.col("k") - 1).alias("right"), prefix(F.col("k")).alias("both")).distinct()
    return pairs, listed.select(prefix(F.size("m")).alias("child"), F.col("x").alias("parent"))


class Intersections:
    """What a concept is below because it is below both sides of a step.

    Of a pair of a new side and the sides that could complete it, the fewer are tried: the steps that have the new side, or the
    sides that the concept is below. So a side that thousands of steps have costs a concept no more than the sides it has itself.
    """

    def __init__(self, pairs: DataFrame):
        self.pairs = pairs
        count = lambda side: pairs.groupBy(F.col(side).alias("d")).agg(F.count(F.lit(1)).alias(f"{side}s"))
        self.sides = stored(count("left").join(count("right"), "d", "full_outer"), "sides")
        self.known: DataFrame | None = None

    def whole(self, new_sub: DataFrame) -> DataFrame:
        """(c, d) that follow from new subsumption (c, d) and what was told before."""
        new = stored(new_sub.join(self.sides, "d"), "new-sides")
        self.known = known = new if self.known is None else self.known.unionByName(new)
        had = known.join(new.select("c").distinct(), "c", "left_semi").groupBy("c").agg(F.count("lefts").alias("has_left"), F.count("rights").alias("has_right"))
        ahead = stored(new.join(had, "c"), "new-sides")
        by_step, by_side = [], []
        for mine, other in (("left", "right"), ("right", "left")):
            here = ahead.filter(f"{mine}s is not null").select("c", F.col("d").alias(mine), (F.col(f"{mine}s") <= F.col(f"has_{other}")).alias("few"))
            by_step.append(here.filter("few").join(self.pairs, mine).select("c", F.col(other).alias("d"), "both"))
            theirs = known.filter(f"{other}s is not null").select("c", F.col("d").alias(other))
            by_side.append(here.filter("not few").join(theirs, "c").select("c", "left", "right"))
        steps = reduce(DataFrame.unionByName, by_step).join(known.select("c", "d"), ["c", "d"], "left_semi").select("c", "both")
        sides = reduce(DataFrame.unionByName, by_side).join(self.pairs, ["left", "right"]).select("c", "both")
        return steps.unionByName(sides).select("c", F.col("both").alias("d"))

    def merge(self) -> None:
        self.known = stored(self.known, "sides")


def collapsed(rules: DataFrame) -> tuple[DataFrame, DataFrame | None]:
    """rules in which one number stands for all classes that are told to be below each other; and (member, rep) of these, if there are any.

    So n concepts with one definition cost each round what one costs, and not n times n.  The smallest named member stands for
    its class.  An intersection keeps its own number among members, since a class may be defined by several.
    """
    told = rules.filter("rule = 'told' and a <> b").select(F.col("a").alias("child"), F.col("b").alias("parent")).distinct()
    back = told.select(F.col("parent").alias("child"), F.col("child").alias("parent"))
    mutual = stored(told.join(back, ["child", "parent"], "left_semi"), "mutual")
    if mutual.isEmpty():
        return rules, None
    classes = graph.components(mutual)
    reps = classes.groupBy("set_id").agg(F.coalesce(F.min(F.when(F.col("member") > 0, F.col("member"))), F.min("member")).alias("rep"), F.max(F.col("member") == BOTTOM).alias("none_"))
    # what is nothing stays as it is, since nothing has a number of its own
    same = stored(classes.join(reps.filter("not none_"), "set_id").select("member", "rep"), "same")
    moved = same.filter("member <> rep")

    def named(df: DataFrame, c: str, where) -> DataFrame:
        met = df.join(moved.select(F.col("member").alias(c), F.col("rep").alias("rep_")), c, "left")
        return met.withColumn(c, F.when(where, F.coalesce("rep_", c)).otherwise(F.col(c))).select(rules.columns)

    rule = F.col("rule")
    out = named(named(named(rules, "a", rule.isin("told", "member", "exists")), "b", rule == "told"), "c", rule == "exists")
    none, null = F.lit(None).cast("long"), F.lit(None).cast("int")
    whole = rules.filter("rule = 'member'").select(F.col("b").alias("member")).distinct().join(moved, "member")
    ends = whole.select(F.lit("told").alias("rule"), F.col("member").alias("a"), F.col("rep").alias("b"), none.alias("c"), null.alias("n"))
    return out.unionByName(ends.select(rules.columns)).distinct(), same.filter("member > 0")


def shared_leaves(rules: DataFrame) -> tuple[DataFrame, DataFrame | None]:
    """rules with one for all named concepts that nothing is told about but the same parents; and (member, rep) of the others, if there are any.

    A leaf is named as the child of told rows alone: nothing can be below it, and what it is below follows from its parents.  So
    leaves with the same parents differ by their number alone, and the smallest goes through the fixpoint for all.
    """
    told = F.col("rule") == "told"
    named = rules.select(F.explode(F.array(F.when(~told, F.col("a")), "b", "c")).alias("a")).filter("a > 0").distinct()
    ends = rules.filter(told).filter("a > 0").select("a", "b").join(named, "a", "left_anti")
    keyed = stored(ends.groupBy(F.col("a").alias("member")).agg(F.sort_array(F.collect_set("b")).alias("key")), "leaves")
    reps = stored(keyed.groupBy("key").agg(F.min("member").alias("rep"), F.count(F.lit(1)).alias("n_")).filter("n_ > 1").select("key", "rep"), "leaf-sets")
    leaves = stored(keyed.join(reps, "key").filter("member <> rep").select("member", "rep"), "leaves")
    if leaves.isEmpty():
        return rules, None
    return rules.join(leaves.select(F.col("member").alias("a")), "a", "left_anti").select(rules.columns), leaves


def with_leaves(pairs: DataFrame, leaves: DataFrame | None) -> DataFrame:
    """pairs (child and another column), and those of leaves that a child stands for."""
    if leaves is None:
        return pairs
    theirs = pairs.withColumnRenamed("child", "rep").join(leaves.withColumnRenamed("member", "child"), "rep")
    return pairs.unionByName(theirs.select(pairs.columns))


def saturate(rules: DataFrame, max_rounds: int = 200) -> DataFrame:
    """(child, ancestor): strict subsumption among named concepts, and under BOTTOM those that nothing can be.

    rules: see functions.axioms.normalised.
    """
    rules, leaves = shared_leaves(stored(rules, "rules"))
    found, same = saturated(rules, max_rounds)
    found = with_leaves(found, leaves)
    if same is None:
        return found
    of = lambda df, c: df.join(same.select(F.col("rep").alias(c), "member"), c, "left").withColumn(c, F.coalesce("member", c)).select("child", "ancestor")
    each = same.select("rep", F.col("member").alias("child")).join(same.select("rep", F.col("member").alias("ancestor")), "rep").filter("child <> ancestor")
    return of(of(found, "child"), "ancestor").unionByName(each.select("child", "ancestor"))


def saturated(rules: DataFrame, max_rounds: int = 200) -> tuple[DataFrame, DataFrame | None]:
    """What saturate finds, with one concept for all that are told to be the same; and (member, rep) of these, if there are any."""
    rules, same = collapsed(stored(_with_bottom(rules), "rules"))
    if same is not None:
        rules = stored(rules, "rules")
    return _fixpoint(rules, max_rounds), same


def _fixpoint(rules: DataFrame, max_rounds: int) -> DataFrame:
    pick = lambda rule, *names: rules.filter(F.col("rule") == rule).select(*[F.col(c).alias(n) for c, n in zip("abcn", names, strict=False) if n])
    exists = pick("exists", "x", "role", "filler")
    member = pick("member", "d", "x")
    chain = pick("chain", "first", "second", "whole")
    pairs, heads = binary_intersections(member, pick("told", "child", "parent"))
    whole = Intersections(stored(pairs, "steps"))
    told = graph.closure(pick("told", "child", "parent").unionByName(heads))
    told = told.select(F.col("child").alias("d"), F.col("ancestor").alias("e"))
    role_edges = pick("role", "child", "parent")
    roles = _union([
        graph.closure(role_edges), role_edges.select(F.col("child"), F.col("child").alias("ancestor")),
        role_edges.select(F.col("parent").alias("child"), F.col("parent").alias("ancestor")),
    ])
    roles = stored(roles.select(F.col("child").alias("role"), F.col("ancestor").alias("up")), "roles")
    subjects = _union([
        rules.select(F.col("a").alias("c")).filter("rule = 'told' and a > 0"),
        rules.select(F.col("b").alias("c")).filter("rule = 'told' and b > 0"), exists.select(F.col("filler").alias("c")),
        member.select(F.col("d").alias("c")).filter("c > 0"),
    ])
    start = subjects.select("c", F.col("c").alias("d"))
    sub = new_sub = stored(_union([start, start.join(told, "d").select("c", F.col("e").alias("d"))]), "sub")

    def lifted(links: DataFrame) -> DataFrame:
        """links with every super-role of their roles."""
        up = links.join(roles, "role", "left").select("c", F.coalesce("up", "role").alias("role"), "filler")
        return up.distinct()

    # properties are few, part of the schema and not of the data
    reflexive = [r.role for r in pick("reflexive", "role").distinct().collect()]
    each = F.explode(F.array(*[F.lit(r).cast("long") for r in reflexive]))
    own = lifted(subjects.select("c", each.alias("role"), F.col("c").alias("filler"))) if reflexive else None
    has_chain = not chain.isEmpty()
    link = None
    triggers = exists.select(F.col("filler").alias("d"), F.col("role"), F.col("x"))
    for number in range(max_rounds):
        # links from what is newly subsumed by an existential
        links = [new_sub.join(exists.withColumnRenamed("x", "d"), "d").select("c", "role", "filler")]
        if link is None and own is not None:
            links.append(own)
        if link is not None and has_chain:
            links += _chained(new_link, link, chain)
        found = lifted(_union(links))
        new_link = stored(found if link is None else found.join(link, ["c", "role", "filler"], "left_anti"), "link")
        all_link = new_link if link is None else link.unionByName(new_link)
        # existentials above: a filler that is, newly or by a new link, subsumed by the filler of one
        step = lambda s: s.join(triggers, "d").select(F.col("c").alias("filler"), "role", "x")
        up = [_meet(step(sub), new_link), _meet(step(new_sub), all_link)]
        derived = _union([*up, whole.whole(new_sub)])
        derived = _union([derived, derived.join(told, "d").select("c", F.col("e").alias("d"))])
        link = all_link
        new_sub = stored(derived.join(sub, ["c", "d"], "left_anti"), "sub")
        if new_sub.isEmpty() and (not has_chain or new_link.isEmpty()):
            return sub.filter((F.col("c") > 0) & ((F.col("d") > 0) | (F.col("d") == BOTTOM)) & (F.col("c") != F.col("d"))).select(F.col("c").alias("child"), F.col("d").alias("ancestor"))
        sub = sub.unionByName(new_sub)
        if number % graph.MERGED == graph.MERGED - 1:
            sub, link = stored(sub, "sub"), stored(link, "link")
            whole.merge()
    raise RuntimeError("classification has not settled")


def _meet(fillers: DataFrame, links: DataFrame) -> DataFrame:
    return fillers.join(links, ["filler", "role"]).select("c", F.col("x").alias("d"))


def _chained(new: DataFrame, known: DataFrame, chain: DataFrame) -> list[DataFrame]:
    def pairs(left: DataFrame, right: DataFrame) -> DataFrame:
        a = left.join(chain.withColumnRenamed("first", "role"), "role").select("c", F.col("filler").alias("mid"), F.col("second").alias("role"), "whole")
        b = right.select(F.col("c").alias("mid"), "role", "filler")
        return a.join(b, ["mid", "role"]).select("c", F.col("whole").alias("role"), "filler")

    return [pairs(new, known), pairs(known, new)]


def taxonomy(subsumed: DataFrame, concepts: DataFrame, same: DataFrame | None = None, leaves: DataFrame | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(parents, equivalence sets, closure over representatives) of strict subsumption among named concepts.

    same, leaves: (member, rep) of concepts of which the subsumption knows one alone, see saturated and shared_leaves.  In a set of equivalent concepts the smallest has the real parents; each other one has it as its only parent.
    Concepts that nothing can be have no place.
    """
    nothing = unsatisfiable(subsumed)
    subsumed = subsumed.filter(F.col("ancestor") != BOTTOM)
    for end in ("child", "ancestor"):
        subsumed = subsumed.join(nothing.withColumnRenamed("concept", end), end, "left_anti").select("child", "ancestor")
    subsumed = stored(subsumed, "subsumed")
    sets = graph.equivalents(subsumed)
    if same is not None:
        own = same.join(nothing.withColumnRenamed("concept", "rep"), "rep", "left_anti")
        known = sets.withColumnRenamed("member", "rep")
        # a set has all members of each of its own, and the smallest of the smallest stands for it
        sets = sets.unionByName(own.join(known, "rep", "left").select(F.coalesce("set_id", "rep").alias("set_id"), "member")).distinct()
        sets = sets.join(sets.groupBy("set_id").agg(F.count(F.lit(1)).alias("n_")).filter("n_ > 1").select("set_id"), "set_id", "left_semi")
    sets = stored(sets, "sets")
    rep = sets.filter("member <> set_id")
    name = lambda df, c: df.join(rep.select(F.col("member").alias(c), F.col("set_id").alias("r_")), c, "left").withColumn(c, F.coalesce("r_", c)).drop("r_")
    strict = stored(name(name(subsumed, "child"), "ancestor").filter("child <> ancestor").distinct(), "strict")
    parents = graph.direct_parents(strict).unionByName(rep.select(F.col("member").alias("child"), F.col("set_id").alias("parent")))
    return with_leaves(parents, leaves), sets, with_leaves(strict, leaves)
