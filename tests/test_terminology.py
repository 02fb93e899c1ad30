"""Terminology operators on small tables, against plain Python."""

import random
from itertools import product

import pytest
from pyspark.sql import functions as F

from vocalith.functions import axioms, values
from vocalith.operators import classify, diff, graph, groups, identifiers, normal_form, state
from vocalith.schema import IS_A, ROLE_GROUP


def pairs(df, *names):
    return {tuple(r[n] for n in names) for r in df.collect()}


def closed(edges):
    out = set(edges)
    while True:
        more = {(a, d) for a, b in out for c, d in out if b == c} - out
        if not more:
            return out
        out |= more


def test_closure_levels_and_reduction(spark):
    edges = [(2, 1), (3, 1), (4, 2), (4, 3), (5, 4), (5, 1), (6, 5)]
    df = spark.createDataFrame(edges, "child long, parent long")
    found = graph.closure(df)
    assert pairs(found, "child", "ancestor") == closed(edges)
    assert pairs(graph.direct_parents(found), "child", "parent") == set(edges) - {(5, 1)}
    assert pairs(graph.levels(df), "node", "level") == {(1, 0), (2, 1), (3, 1), (4, 2), (5, 3), (6, 4)}
    below = graph.descendants(df, spark.createDataFrame([(2,)], "node long"))
    assert pairs(below, "node") == {(4,), (5,), (6,)}


def test_cycles_end(spark):
    df = spark.createDataFrame([(1, 2), (2, 1), (3, 2)], "child long, parent long")
    assert pairs(graph.closure(df), "child", "ancestor") == closed({(1, 2), (2, 1), (3, 2)})
    assert pairs(graph.equivalents(graph.closure(df).filter("child <> ancestor")), "set_id", "member") == {(1, 1), (1, 2)}
    with pytest.raises(ValueError):
        graph.levels(df)


def test_states(spark):
    old = spark.createDataFrame([(1, 10, True), (1, 20, False), (2, 10, True)], "id long, t int, active boolean")
    new = spark.createDataFrame([(1, 5, True), (3, 1, False)], "id long, t int, active boolean")
    assert pairs(state.latest_state(old, ["id"], [F.col("t")]), "id", "active") == {(1, False), (2, True)}
    assert pairs(state.overlay(old, new, ["id"], [F.col("t")]), "id", "t", "active") == {(1, 5, True), (2, 10, True), (3, 1, False)}


def test_changes_follow_the_protocol(spark):
    schema = "id long, moduleId long, s long, typeId long, d long, value string, g int"
    old = spark.createDataFrame(
        [(1, 5, 1, IS_A, 9, None, 0), (2, 5, 1, 7, 3, None, 0), (3, 5, 1, 7, 4, None, 1), (4, 9, 1, 7, 4, None, 1), (5, 5, 2, 8, None, "#1", 0)], schema
    )
    new = spark.createDataFrame([(1, IS_A, 9, None, 0), (1, 7, 3, None, 2), (1, 7, 4, None, 1), (2, 8, None, "#2", 0)], "s long, typeId long, d long, value string, g int")
    found = diff.compare(old, new, "s", ["typeId", "d", "value"], "g", IS_A)
    assert pairs(found, "action", "id", "s", "value", "g") == {("move", 2, 1, None, 2), ("remove", 3, 1, None, 1), ("remove", 5, 2, "#1", 0), ("add", None, 2, "#2", 0)}


def test_reuse_takes_the_latest(spark):
    pool = spark.createDataFrame([(10, 1, 5), (11, 2, 5), (12, 3, 6)], "id long, effectiveTime int, k long")
    added = spark.createDataFrame([(5,), (7,)], "k long")
    assert pairs(diff.reuse_ids(added, pool, ["k"]), "k", "reused_id") == {(5, 11), (7, None)}


def test_antichain_keeps_the_first_of_equals(spark):
    sets = {1: {"a"}, 2: {"a", "b"}, 3: {"a", "b"}, 4: {"c"}, 5: set("abc")}
    sizes = spark.createDataFrame([(1, k, len(v), k) for k, v in sets.items()], "owner long, grp long, n long, ord long")
    contained = [(1, a, b) for a, b in product(sets, sets) if sets[b] <= sets[a] and sets[a] & sets[b]]
    found = groups.antichain(sizes, spark.createDataFrame(contained, "owner long, strong long, weak long"), ["owner"], "ord")
    assert pairs(found, "grp") == {(5,)}
    some = spark.createDataFrame([c for c in contained if 5 not in c[1:]], "owner long, strong long, weak long")
    assert pairs(groups.antichain(sizes.filter("grp < 5"), some, ["owner"], "ord"), "grp") == {(2,), (4,)}


TEXTS = [
    f"EquivalentClasses(:5 ObjectIntersectionOf(:4 ObjectSomeValuesFrom(:{ROLE_GROUP} ObjectIntersectionOf(ObjectSomeValuesFrom(:10 :2) ObjectSomeValuesFrom(:11 :3)))))",
    f'SubClassOf(:6 ObjectIntersectionOf(:4 ObjectSomeValuesFrom(:{ROLE_GROUP} ObjectSomeValuesFrom(:10 :3)) DataHasValue(:12 "5"^^xsd:integer)))',
    "SubClassOf(:7 :5)",
]


def test_axioms_to_rows_and_back(spark):
    df = spark.createDataFrame([(str(i), i, t) for i, t in enumerate(TEXTS)], "axiom_id string, component long, axiom string")
    rows = axioms.relationships(df).filter("side = 'right'").select(F.col("left_concept").alias("conceptId"), "grp", "typeId", F.coalesce("destinationId", "right_concept").alias("destinationId"), "kind", "text", "primitive")
    ungrouped = spark.createDataFrame([(12,)], "attributeId long")
    back = axioms.class_axioms(axioms.class_expressions(rows, ungrouped), rows.filter("not primitive").select("conceptId").distinct())
    assert pairs(back, "axiom") == {(t,) for t in TEXTS}


def test_conversion_cases():
    assert axioms.convert("TransitiveObjectProperty(:1)") is None
    assert axioms.convert("SubObjectPropertyOf(ObjectPropertyChain(:1 :2) :3)") is None
    assert axioms.convert("SubObjectPropertyOf( :1   :2 )")[4] == [(0, IS_A, 2, None, None)]
    gci = f"SubClassOf(ObjectIntersectionOf(:4 ObjectSomeValuesFrom(:{ROLE_GROUP} ObjectSomeValuesFrom(:10 :2))) :8)"
    assert axioms.convert(gci)[2:4] == ([(0, IS_A, 4, None, None), (1, 10, 2, None, None)], 8)
    assert axioms.convert(gci, skip_gci=True) is None
    assert axioms.convert("SubClassOf(:1 ObjectIntersectionOf(:2 ObjectSomeValuesFrom(:roleGroup ObjectSomeValuesFrom(:3 :4))))")[4][1] == (1, 3, 4, None, None)
    for bad in ("SubClassOf(:1", "SubClassOf(:1 ObjectSomeValuesFrom(:2 :3))", "SubClassOf(:1 :2 :3)", "", 'SubClassOf(:1 ObjectIntersectionOf(:2 DataHasValue(:3 "x"^^xsd:boolean)))'):
        with pytest.raises(ValueError):
            axioms.convert(bad)


def test_values(spark):
    df = spark.createDataFrame([("#1",), ("#2.50",), ('"a"b"',), (None,)], "v string").withColumn("c", values.concrete(F.col("v")))
    assert [r.c and tuple(r.c) for r in df.collect()] == [("INTEGER", "1"), ("DECIMAL", "2.50"), ("STRING", 'a"b'), None]
    assert [r[0] for r in df.filter("v is not null").select(values.concrete_text(F.col("c.kind"), F.col("c.text"))).collect()] == ["#1", "#2.50", '"a"b"']


def entailed(rules):
    """Subsumption by the same rules on Python sets, until nothing is new."""
    told = {(a, b) for r, a, b, *_ in rules if r == "told"}
    exists = {(a, b, c) for r, a, b, c, _ in rules if r == "exists"}
    need = {}
    for r, a, b, _, n in rules:
        if r == "member":
            need.setdefault((b, n), set()).add(a)
    roles = {(a, b) for r, a, b, *_ in rules if r == "role"}
    chain = {(a, b, c) for r, a, b, c, _ in rules if r == "chain"}
    names = {x for r, a, b, c, _ in rules for x in ((a, b) if r == "told" else (c,) if r == "exists" else (a,) if r == "member" else ())}
    sub, link = {(x, x) for x in names}, set()
    while True:
        new = {(c, e) for c, d in sub for x, e in told if x == d}
        new |= {(c, x) for c in {c for c, _ in sub} for (x, n), m in need.items() if len({d for d in m if (c, d) in sub}) == n}
        new |= {(c, x) for c, r, d in link for x, s, e in exists if s == r and (d, e) in sub}
        more = {(c, r, f) for c, d in sub for x, r, f in exists if x == d}
        more |= {(c, s, d) for c, r, d in link for a, s in roles if a == r}
        more |= {(c, t, f) for c, r, d in link for e, s, f in link for x, y, t in chain if d == e and (r, s) == (x, y)}
        if new <= sub and more <= link:
            return {(c, d) for c, d in sub if c > 0 and d > 0 and c != d}
        sub |= new
        link |= more


@pytest.mark.parametrize("seed", [1, 2])
def test_classification_against_plain_rules(spark, seed):
    rng = random.Random(seed)
    role = lambda: rng.choice([100, 101, 102])
    texts = ["SubObjectPropertyOf(:100 :101)", "SubObjectPropertyOf(ObjectPropertyChain(:101 :102) :101)", "TransitiveObjectProperty(:102)"]
    for c in range(1, 13):
        parts = [f":{rng.randrange(1, 13)}", f"ObjectSomeValuesFrom(:{role()} :{rng.randrange(1, 13)})"]
        if rng.random() < 0.4:
            parts.append(f"ObjectSomeValuesFrom(:{ROLE_GROUP} ObjectSomeValuesFrom(:{role()} :{rng.randrange(1, 13)}))")
        kind = "EquivalentClasses" if rng.random() < 0.4 else "SubClassOf"
        texts.append(f"{kind}(:{c} ObjectIntersectionOf({' '.join(parts)}))")
    rules = sorted({r for t in texts for r in axioms.normal_rows(t)}, key=str)
    normal = axioms.normalised(spark.createDataFrame([(t,) for t in texts], "axiom string"))
    assert pairs(normal, "rule", "a", "b", "c", "n") == set(rules)
    found = pairs(classify.saturate(normal), "child", "ancestor")
    names = set(range(1, 13))
    assert {(a, b) for a, b in found if a in names and b in names} == {(a, b) for a, b in entailed(rules) if a in names and b in names}


def reach(edges):
    """All pairs along edges, by search."""
    after = {}
    for a, b in edges:
        after.setdefault(a, set()).add(b)
    out = set()
    for a in after:
        seen, todo = set(), [a]
        while todo:
            for b in after.get(todo.pop(), ()):
                if b not in seen:
                    seen.add(b)
                    todo.append(b)
        out |= {(a, b) for b in seen}
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_components_are_what_reaches_each_other(spark, seed):
    rng = random.Random(seed)
    edges = {(rng.randrange(80), rng.randrange(80)) for _ in range(85)} | {(100 + i, 100 + (i + 1) % 9) for i in range(9)} | {(7, 100), (200, 201), (5, 5)}
    pairs_ = reach(edges)
    want = {(min(y for y in {x, *{b for a, b in pairs_ if a == x and (b, x) in pairs_}}), x) for x in {a for e in edges for a in e} if any(a == x and b != x and (b, x) in pairs_ for a, b in pairs_)}
    df = spark.createDataFrame(sorted(edges), "child long, parent long")
    assert pairs(graph.strong_components(df), "set_id", "member") == want
    assert {x for s, x in want if s == 100} == set(range(100, 109))
    assert graph.strong_components(df.limit(0)).isEmpty()
    with pytest.raises(ValueError, match="cycle: "):
        graph.levels(df)


@pytest.mark.parametrize("told", [False, True])
def test_direct_parents_of_nodes_with_many(spark, told):
    rng = random.Random(4)
    edges = {(a, b) for a in range(1, 60) for b in range(a) if rng.random() < 0.06} | {(70, b) for b in range(0, 60, 4)} | {(71, 70), (71, 8)}
    closed_ = reach(edges)
    want = {(a, b) for a, b in closed_ if not any((a, m) in closed_ and (m, b) in closed_ for m in range(80))}
    assert max(sum(a == x for a, _ in want) for x in range(80)) > graph.ROUNDS
    found = graph.direct_parents(spark.createDataFrame(sorted(closed_), "child long, ancestor long"), spark.createDataFrame(sorted(edges), "child long, parent long") if told else None)
    assert pairs(found, "child", "parent") == want


def test_intersections_with_shared_prefixes(spark):
    rng = random.Random(6)
    names = [f":{i}" for i in range(1, 9)]
    texts = [f"SubClassOf(:{20 + i} ObjectIntersectionOf({' '.join(rng.sample(names, rng.randrange(2, 7)))}))" for i in range(12)]
    texts += [f"EquivalentClasses(:{40 + i} ObjectIntersectionOf({' '.join(rng.sample(names, rng.randrange(1, 5)))} :1))" for i in range(12)]
    texts += [f"SubClassOf(ObjectIntersectionOf(:{40 + i} :{rng.randrange(1, 9)}) :{60 + i})" for i in range(8)]
    normal = axioms.normalised(spark.createDataFrame([(t,) for t in texts], "axiom string"))
    rules = {r for t in texts for r in axioms.normal_rows(t)}
    found = pairs(classify.saturate(normal), "child", "ancestor")
    keep = lambda found: {(a, b) for a, b in found if 20 <= a and 40 <= b}
    assert keep(found) == keep(entailed(rules))
    assert keep(found)


def test_sets_hold_others_by_their_rarest_item(spark):
    rng = random.Random(9)
    made = {(o, g): sorted(set(rng.choices("abcdefg", k=rng.randrange(6)))) for o in range(3) for g in range(14)}
    distinct = {}
    for (o, g), items in sorted(made.items()):
        distinct.setdefault((o, tuple(items)), g)
    rows = [(o, g, list(items)) for (o, items), g in distinct.items()]
    found = groups.set_containment(spark.createDataFrame(rows, "owner int, grp int, items array<string>"), ["owner"])
    want = {(o, g, h) for o, g, a in rows for p, h, b in rows if o == p and set(b) < set(a)}
    assert pairs(found, "owner", "strong", "weak") == want


def test_numbers_have_no_gaps(spark):
    rows = spark.range(0, 1000, 1, 7).select(((F.col("id") * 37) % 1000).alias("k"), F.when(F.col("id") % 4 == 0, F.col("id") + 5000).alias("id"))
    assert [r.number for r in identifiers.dense_numbers(rows, ["k"], first=5).orderBy("k").collect()] == list(range(5, 1005))
    assert identifiers.dense_numbers(rows.limit(0), ["k"]).isEmpty()
    made = {r.k: r.id for r in identifiers.supplied(rows, "id", ["k"], lambda n: -n).collect()}
    given = {r.k: r.id for r in rows.collect()}
    missing = sorted(k for k, i in given.items() if i is None)
    assert made == given | {k: -n for n, k in enumerate(missing, 1)}


def test_counts_are_taken_while_the_delta_is_written(spark, tmp_path):
    rows = [("add", None), ("add", False), ("move", False), ("remove", False), ("remove", True), ("remove", True)]
    delta, counts = diff.counted(spark.createDataFrame(rows, "action string, inactivated boolean"))
    delta.write.parquet(str(tmp_path / "delta"))
    assert counts.get == {"added": 2, "moved": 1, "removed": 1, "inactivated": 2}


def test_universal_rows_are_compared_with_their_like(spark):
    row = "conceptId long, grp int, typeId long, destinationId long, value string, universal boolean"
    own = spark.createDataFrame([(1, 0, 5, 11, None, False), (2, 1, 5, 10, None, False), (2, 2, 5, 10, None, True), (2, 3, 5, 11, None, True), (3, 0, 5, 11, None, True)], row)
    parents = spark.createDataFrame([(2, 1), (3, 1)], "child long, parent long")
    is_a = spark.createDataFrame([(10, 11)], "child long, ancestor long")
    found = normal_form.inferred_attributes(own, parents, spark.createDataFrame([], "child long, ancestor long"), is_a)
    assert pairs(found, "conceptId", "grp", "destinationId", "universal") == {(1, 0, 11, False), (2, 1, 10, False), (2, 2, 10, True), (3, 0, 11, False), (3, 0, 11, True)}
    schema = "id long, moduleId long, s long, typeId long, universal boolean, g int"
    old = spark.createDataFrame([(1, 5, 1, 7, True, 1)], schema)
    changes = diff.compare(old, spark.createDataFrame([(1, 7, False, 1)], "s long, typeId long, universal boolean, g int"), "s", ["typeId", "universal"], "g", IS_A)
    assert pairs(changes, "action", "id", "universal") == {("remove", 1, True), ("add", None, False)}


def test_concepts_that_add_nothing_share_their_parents_set(spark):
    """Against each concept by itself: shared combinations, parents in other orders, and parents without rows."""
    rng = random.Random(12)
    row = "conceptId long, grp int, typeId long, destinationId long, value string"
    parents = {(c, p) for c in range(4, 40) for p in rng.sample(range(c if c < 12 else 12), 1 + (c % 3 == 0))}
    own = [(c, g, rng.choice([5, 6]), rng.randrange(50, 54), None) for c in range(0, 40, 3) for g in range(rng.randrange(3))]
    frames = spark.createDataFrame(own, row), spark.createDataFrame(sorted(parents), "child long, parent long")
    closures = spark.createDataFrame([(6, 5)], "child long, ancestor long"), spark.createDataFrame([(50, 51), (52, 53)], "child long, ancestor long")
    found = {}
    for r in normal_form.inferred_attributes(*frames, *closures).collect():
        found.setdefault(r.conceptId, set()).add((r.grp, r.typeId, r.destinationId))
    stronger = lambda a, b: (a[0] == b[0] or a == (6, a[1]) and b[0] == 5) and (a[1] == b[1] or (a[1], b[1]) in {(50, 51), (52, 53)})
    done = {}
    for c in range(40):
        sources = [(0, {(g, t, d) for o, g, t, d, _ in own if o == c})] + [(p + 1, done[p]) for p in sorted(p for x, p in parents if x == c)]
        units = []
        for _, rows in sources:
            for g in sorted({g for g, *_ in rows}, key=lambda g: (g == 0, g)):
                inside = [{(t, d)} for _, t, d in sorted(r for r in rows if r[0] == 0)] if g == 0 else [{(t, d) for n, t, d in rows if n == g}]
                units += [(g, x) for x in inside]
        units = [(g, {a for a in x if not any(b != a and stronger(b, a) for b in x)}) for g, x in units]
        holds = lambda a, b: all(any(stronger(x, y) for x in a) for y in b)
        kept = [u for i, u in enumerate(units) if not any(holds(v[1], u[1]) and (not holds(u[1], v[1]) or j < i) for j, v in enumerate(units) if j != i)]
        numbers = iter(range(1, 99))
        done[c] = {(n, *x) for g, u in kept for n in [0 if g == 0 else next(numbers)] for x in u}
    assert found == {c: rows for c, rows in done.items() if rows}


def test_components_pass_no_table_of_a_round_through_the_driver(spark, monkeypatch):
    plans, keep = [], graph.stored
    monkeypatch.setattr(graph, "stored", lambda df, *a: plans.append(df._jdf.queryExecution().executedPlan().toString()) or keep(df, *a))
    edges = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (3, 4)], "child long, parent long")
    assert {(r.set_id, r.member) for r in graph.strong_components(edges).collect()} == {(1, 1), (1, 2), (1, 3)}
    assert any("SortMergeJoin" in p for p in plans) and not any("BroadcastHashJoin" in p for p in plans)


def test_the_second_pass_reduces_equal_candidates_once(spark, monkeypatch):
    """Ten concepts in two kinds, with a chain: three reductions, one of them of nations, and each concept has its own rows."""
    seen, plain = [], normal_form.reduce_groups

    def reduce_groups(rows, types, near, chains=None, reach=None):
        seen.append(rows.select("conceptId").distinct().count())
        return plain(rows, types, near, chains, reach)

    monkeypatch.setattr(normal_form, "reduce_groups", reduce_groups)
    made = [(2, 0, 3, 1), (4, 0, 3, 1)]
    for i in range(10):
        near = 2 if i < 6 else 4
        made += [(100 + i, 1, 1, near), (100 + i, 2, 1, 1), (100 + i, 3, 3, near), (100 + i, 4, 3, 1)]
    own = spark.createDataFrame([(c, g, t, d, None) for c, g, t, d in made], "conceptId long, grp int, typeId long, destinationId long, value string")
    none, parents = spark.createDataFrame([], "child long, ancestor long"), spark.createDataFrame([], "child long, parent long")
    chains = spark.createDataFrame([(1, 3, 1), (3, 3, 3)], "first long, second long, whole long")
    found = normal_form.inferred_attributes(own, parents, none, none, chains)
    want = {(2, 0, 3, 1), (4, 0, 3, 1)} | {(100 + i, g, t, 2 if i < 6 else 4) for i in range(10) for g, t in ((1, 1), (2, 3))}
    assert pairs(found, "conceptId", "grp", "typeId", "destinationId") == want
    assert seen[-1] == 3  # both nations have the same rows, whose role starts a chain, too
