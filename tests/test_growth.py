"""Steps whose work grew faster than it had to: what they do now, and that their results are those of plain definitions."""

import random
import re

from vocalith.functions.axioms import object_id
from vocalith.operators import classify, normal_form
from vocalith.schema import CORE_MODULE
from vocalith.sources.shared import stored

NEW = "conceptId long, grp int, typeId long, destinationId long, value string"


def folded(new, old):
    """Group numbers by the definition: of a concept's groups, in order, each takes the number it wants from who has it."""
    text = lambda r: f"{r[2]}/{'' if r[3] is None else r[3]}/{r[4] or ''}/false"
    sets, core = {}, {}
    for r in old:
        if r[1]:
            sets.setdefault((r[0], r[1]), set()).add(r[2:5])
            core[r[0], r[1]] = core.get((r[0], r[1]), True) and r[5] == CORE_MODULE
    out, groups = [], {}
    for r in new:
        groups.setdefault(r[0], {}).setdefault((r[1], text(r) if r[1] == 0 else ""), set()).add(r[2:5])
    to = {}
    for c, own in groups.items():
        names = sorted(own)
        wanted = {g: min(((not core[k], k[1]) for k, s in sets.items() if k[0] == c and s == own[g]), default=(0, None))[1] for g in names}
        at = {g: g[0] for g in names}
        for g in names:
            if wanted[g] is not None and at[g] != wanted[g]:
                mine = at[g]
                for other in names:
                    if at[other] == wanted[g]:
                        at[other] = mine
                at[g] = wanted[g]
        to |= {(c, *g): n for g, n in at.items()}
    for r in new:
        out.append((r[0], to[r[0], r[1], text(r) if r[1] == 0 else ""], *r[2:5]))
    return sorted(out, key=repr)


def numbered(spark, new, old):
    found = normal_form.stable_numbers(spark.createDataFrame(new, NEW), spark.createDataFrame(old, f"{NEW}, moduleId long"))
    return sorted([tuple(r) for r in found.select("conceptId", "grp", "typeId", "destinationId", "value").collect()], key=repr)


def test_stable_numbers_follow_the_definition(spark):
    rng = random.Random(3)
    row = lambda c: (c, rng.randrange(5), rng.randrange(2), *rng.choice(((7, None), (8, None), (None, "#1"), (None, ""))))
    new = [row(c) for c in range(60) for _ in range(rng.randrange(1, 9))]
    old = [(*row(c), rng.choice((CORE_MODULE, 1, None))) for c in range(5, 60) for _ in range(rng.randrange(1, 9))]
    assert numbered(spark, new, old) == folded(new, old)
    calm = [(c, g, g, 7, None) for c in range(9) for g in range(4)]
    there = [(c, 60 - g, g, 7, None, 1) for c in range(9) for g in range(4)] * 2
    assert numbered(spark, calm, there) == folded(calm, there)


def test_groups_are_compared_by_rows_and_not_by_joined_text(spark):
    one, two = [(1, 1, 5, None, "a/false;5//b")], [(1, 9, 5, None, "a", 1), (1, 9, 5, None, "b", 1)]
    assert numbered(spark, one, two) == [(1, 1, 5, None, "a/false;5//b")]


def test_both_sides_of_stable_numbers_are_dealt_once(spark, monkeypatch):
    plans = {}

    def kept(df, what="round", by=None):
        plans[what] = df._jdf.queryExecution().executedPlan().toString()
        return stored(df, what, by)

    monkeypatch.setattr(normal_form, "stored", kept)
    numbered(spark, [(1, 1, 5, 7, None)], [(1, 4, 5, 7, None, 1)])
    assert len(re.findall(r"Exchange hashpartitioning\(conceptId", plans["wanted"])) == plans["wanted"].count("Exchange ") == 1
    assert "Aggregate" not in plans["wanted"]  # no group's rows are collected
    assert "exchanged" not in plans  # nor is a concept folded that has no number claimed twice


RULES = "rule string, a long, b long, c long, n int"


def test_leaves_with_the_same_parents_are_one_in_the_fixpoint(spark):
    told = lambda *pairs: [("told", a, b, None, None) for a, b in pairs]
    leaves = [(c, p) for c in range(100, 140) for p in ((2, -5) if c % 2 else (2,))]
    # 5 has a child and 6 is a filler: neither is a leaf, though both have a leaf's parents; 150 and 151 are nothing
    rest = told((2, 1), (5, 2), (6, 2), (160, 5), (-5, 3), (150, 2), (150, object_id("owl:Nothing")), (151, 2), (151, object_id("owl:Nothing")))
    rules = spark.createDataFrame(told(*leaves) + rest + [("exists", -5, 900, 6, None)], RULES)
    left, shared = classify.shared_leaves(rules)
    assert sorted(tuple(r) for r in shared.collect()) == sorted([(c, 100 + c % 2) for c in range(102, 140)] + [(151, 150)])
    found, same = classify.saturated(left)
    assert same is None and found.filter("child between 102 and 140").isEmpty()
    above = lambda c: {1, 2, 3} if c % 2 else {1, 2}
    each = {(r.child, r.ancestor) for r in classify.saturate(rules).filter("child between 100 and 140").collect()}
    assert each == {(c, x) for c in range(100, 140) for x in above(c)}
    parents, _, strict = classify.taxonomy(found, None, same, shared)
    got = sorted(tuple(r) for r in parents.collect())
    assert got == sorted([(2, 1), (5, 2), (6, 2), (160, 5)] + [(c, p) for c in range(100, 140) for p in ((2, 3) if c % 2 else (2,))])
    assert {(r.child, r.ancestor) for r in strict.filter("child between 100 and 140").collect()} == each


def test_leaves_without_company_change_nothing(spark):
    rules = spark.createDataFrame([("told", 7, 1, None, None), ("told", 8, 2, None, None)], RULES)
    assert classify.shared_leaves(rules)[1] is None
    assert sorted(tuple(r) for r in classify.saturate(rules).collect()) == [(7, 1), (8, 2)]
