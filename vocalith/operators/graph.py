"""Hierarchies: closures as semi-naive fixpoints, levels, reductions and equivalence sets."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vocalith.sources.shared import discard, stored


#: Rounds after which the tables of an iteration become one, so that a plan doesn't grow with their number.
MERGED = 4
#: Direct parents that are found one for each round, before the rest of a node's are compared with each other.
ROUNDS = 4


def closure(edges: DataFrame) -> DataFrame:
    """(child, ancestor): all pairs along edges (child, parent), cycles included once.

    A round joins the last round's pairs with all pairs, so paths double in length and a depth of n takes log n rounds.
    What is known is taken out by an anti-join, and both are written to the shared folder.
    """
    step = edges.select("child", F.col("parent").alias("ancestor")).filter("child <> ancestor").distinct()
    known = frontier = stored(step, "closure")
    pieces, rounds = [known], 0
    while True:
        onward = known.select(F.col("child").alias("ancestor"), F.col("ancestor").alias("next"))
        pairs = frontier.join(onward, "ancestor").select("child", F.col("next").alias("ancestor")).distinct()
        frontier = stored(pairs.join(known, ["child", "ancestor"], "left_anti"), "closure")
        if frontier.isEmpty():
            return known
        known, rounds = known.unionByName(frontier), rounds + 1
        pieces.append(frontier)
        if rounds % MERGED == 0:
            known = stored(known, "closure")
            discard(*pieces[:-1])
            pieces = [known, frontier]


def reflexive(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    """pairs with (n, n) for each node."""
    return pairs.unionByName(nodes.select(F.col(nodes.columns[0]).alias("child"), F.col(nodes.columns[0]).alias("ancestor"))).distinct()


def descendants(edges: DataFrame, roots: DataFrame, max_depth: int | None = None) -> DataFrame:
    """node: all below the roots. Only the frontier meets the edges, so the rest of the hierarchy isn't closed.

    Raises if something is deeper than max_depth.
    """
    known = frontier = stored(roots.select(F.col(roots.columns[0]).alias("node")).distinct(), "below")
    step = edges.select("child", F.col("parent").alias("node")).distinct()
    found, depth = frontier.limit(0), 0
    while max_depth is None or depth < max_depth:
        below = frontier.join(step, "node").select(F.col("child").alias("node")).distinct()
        frontier = stored(below.join(known, "node", "left_anti"), "below")
        if frontier.isEmpty():
            return found
        found, known, depth = found.unionByName(frontier), known.unionByName(frontier), depth + 1
        if depth % MERGED == 0:
            found, known = stored(found, "below"), stored(known, "below")
    raise ValueError(f"the hierarchy is deeper than {max_depth}")


def direct_parents(pairs: DataFrame, told: DataFrame | None = None) -> DataFrame:
    """(child, parent) of a strict closure (child, ancestor) without those that another pair implies.

    Of a node's ancestors the deepest, which has most ancestors of its own, is a direct parent, and what is above it is none;
    of those left the deepest is the next, and so on.  So a round asks one question for each pair that is left, whether the
    deepest is below, and the closure is never joined with itself.  After ROUNDS rounds the few nodes with more parents
    compare what is left of theirs with each other.

    told: edges (child, parent) among which all direct ones are, if such are known; only these are tried then.
    """
    pairs = pairs.select("child", "ancestor")
    left = pairs if told is None else told.select("child", F.col("parent").alias("ancestor")).filter("child <> ancestor").distinct()
    depth = pairs.groupBy(F.col("child").alias("ancestor")).agg(F.count(F.lit(1)).alias("depth"))
    left = stored(left.join(depth, "ancestor", "left").select("child", "ancestor", F.coalesce("depth", F.lit(0)).alias("depth")), "left")
    above = pairs.select(F.col("child").alias("deepest"), "ancestor")
    found = []
    for _ in range(ROUNDS):
        deepest = left.groupBy("child").agg(F.max_by("ancestor", F.struct("depth", "ancestor")).alias("deepest"))
        marked = left.join(deepest, "child")
        found.append(stored(deepest.select("child", F.col("deepest").alias("parent")), "parents"))
        rest = marked.filter("ancestor <> deepest").join(above, ["deepest", "ancestor"], "left_anti").select("child", "ancestor", "depth")
        left = stored(rest, "left")
        if left.isEmpty():
            return reduce(DataFrame.unionByName, found)
    implied = left.join(left.select("child", F.col("ancestor").alias("deepest"), F.col("depth").alias("below")), "child").filter("below > depth")
    implied = implied.join(above, ["deepest", "ancestor"], "left_semi").select("child", "ancestor").distinct()
    last = left.join(implied, ["child", "ancestor"], "left_anti").select("child", F.col("ancestor").alias("parent"))
    return reduce(DataFrame.unionByName, [*found, last])


def levels(edges: DataFrame) -> DataFrame:
    """(node, level): the longest path up; nodes without parents have level 0. Each round settles one level."""
    step = stored(edges.select("child", "parent").filter("child <> parent").distinct(), "levels")
    nodes = step.select(F.col("child").alias("node")).unionByName(step.select(F.col("parent").alias("node"))).distinct()
    left, done, level = stored(nodes, "levels"), None, 0
    while True:
        waiting = step.join(left.withColumnRenamed("node", "parent"), "parent", "left_semi").select(F.col("child").alias("node"))
        ready = stored(left.join(waiting, "node", "left_anti").withColumn("level", F.lit(level)), "levels")
        if ready.isEmpty():
            if not left.isEmpty():
                inner = step.join(left.withColumnRenamed("node", "child"), "child", "left_semi").join(left.withColumnRenamed("node", "parent"), "parent", "left_semi")
                some = strong_components(inner).orderBy("set_id", "member").limit(5).collect()
                raise ValueError(f"the hierarchy has a cycle: {', '.join(str(r.member) for r in some)}")
            return done if done is not None else ready
        left = stored(left.join(ready, "node", "left_anti"), "levels")
        done, level = ready if done is None else done.unionByName(ready), level + 1
        if level % MERGED == 0:
            done = stored(done, "levels")


def equivalents(subsumed: DataFrame) -> DataFrame:
    """(set_id, member) of nodes that subsume each other; set_id is the smallest. subsumed: child, ancestor, strict."""
    back = subsumed.select(F.col("ancestor").alias("child"), F.col("child").alias("ancestor"))
    mutual = subsumed.select("child", "ancestor").join(back, ["child", "ancestor"], "left_semi")
    sets = mutual.groupBy("child").agg(F.min("ancestor").alias("m_"))
    return sets.select(F.least("child", "m_").alias("set_id"), F.col("child").alias("member"))


def _dealt(df: DataFrame) -> DataFrame:
    """A table of nodes to be joined with, dealt by its keys: a broadcast of each round would pass all of it through the driver."""
    return df.hint("merge")


def _trimmed(edges: DataFrame) -> DataFrame:
    """edges without those of nodes that nothing leads to or from: they are in no cycle."""
    for _ in range(MERGED):
        before = edges.count()
        below, above = edges.select(F.col("child").alias("node")).distinct(), edges.select(F.col("parent").alias("node")).distinct()
        inner = edges.join(_dealt(above.withColumnRenamed("node", "child")), "child", "left_semi").join(_dealt(below.withColumnRenamed("node", "parent")), "parent", "left_semi")
        edges = stored(inner.select("child", "parent"), "trimmed")
        if edges.count() == before:
            break
    return edges


def _smallest_below(edges: DataFrame) -> DataFrame:
    """(node, colour): the smallest node from which each is reached. What a node's colour has as colour reaches the node, too, so steps double."""
    nodes = edges.select(F.col("child").alias("node")).unionByName(edges.select(F.col("parent").alias("node"))).distinct()
    colours = stored(nodes.withColumn("colour", F.col("node")), "colours")
    while True:
        along = edges.join(_dealt(colours.withColumnRenamed("node", "child")), "child").select(F.col("parent").alias("node"), "colour")
        jump = colours.join(_dealt(colours.select(F.col("node").alias("colour"), F.col("colour").alias("next"))), "colour").select("node", F.col("next").alias("colour"))
        least = colours.unionByName(along).unionByName(jump).groupBy("node").agg(F.min("colour").alias("colour"))
        changed = stored(least.join(_dealt(colours.withColumnRenamed("colour", "was")), "node").withColumn("moved", F.col("colour") < F.col("was")), "colours")
        discard(colours)
        colours = changed.select("node", "colour")
        if changed.filter("moved").isEmpty():
            return colours


def components(edges: DataFrame) -> DataFrame:
    """(set_id, member) of all nodes of edges (child, parent) that go both ways; set_id is the smallest that a node is joined with."""
    return _smallest_below(edges).select(F.col("colour").alias("set_id"), F.col("node").alias("member"))


def strong_components(edges: DataFrame) -> DataFrame:
    """(set_id, member) of the nodes (child, parent) that reach each other, sets of two or more; set_id is the smallest.

    Colouring after Orzan: what no cycle can hold is trimmed; each node takes the smallest node that reaches it as its colour;
    and of a colour's nodes those that reach it are its set.  These go, and so do edges between colours; the rest is coloured again.
    No closure is built: a round is as large as the edges that are left.
    """
    left = stored(edges.select("child", "parent").filter("child <> parent").distinct(), "edges")
    found = left.select(F.col("child").alias("set_id"), F.col("child").alias("member")).limit(0)
    while not (left := _trimmed(left)).isEmpty():
        colours = _smallest_below(left)
        same = left.join(_dealt(colours.select(F.col("node").alias("child"), F.col("colour").alias("mine"))), "child").join(_dealt(colours.select(F.col("node").alias("parent"), "colour")), "parent").filter("mine = colour")
        same = stored(same.select("child", "parent", "colour"), "same")
        reached = front = stored(colours.filter("node = colour"), "reached")
        while True:
            back = same.join(_dealt(front.select(F.col("node").alias("parent"))), "parent").select(F.col("child").alias("node"), "colour").distinct()
            front = stored(back.join(_dealt(reached), ["node", "colour"], "left_anti"), "reached")
            if front.isEmpty():
                break
            reached = stored(reached.unionByName(front), "reached")
        several = reached.groupBy("colour").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
        found = found.unionByName(reached.join(_dealt(several), "colour").select(F.col("colour").alias("set_id"), F.col("node").alias("member")))
        gone = reached.select("node")
        rest = same.join(_dealt(gone.withColumnRenamed("node", "child")), "child", "left_anti").join(_dealt(gone.withColumnRenamed("node", "parent")), "parent", "left_anti")
        left = stored(rest.select("child", "parent"), "edges")
    return found


def chain_closure(edges: DataFrame, is_a: DataFrame) -> DataFrame:
    """(child, ancestor): along one property's edges, and then up the is-a closure of what is reached."""
    reached = closure(edges)
    up = reached.join(is_a.select(F.col("child").alias("mid_"), F.col("ancestor").alias("top_")), F.col("ancestor") == F.col("mid_"))
    return reached.unionByName(up.select("child", F.col("top_").alias("ancestor"))).distinct()
