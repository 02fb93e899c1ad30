"""Spelling variants, exact Jaccard joins and hard negatives: against brute force."""

import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from tests.llm.fixtures import docs, empty, rows
from vocalith.llm import negatives, partenum, set_links, spellings

# -- spelling variants -------------------------------------------------------------------------------------------------------


def lower(text):
    return re.sub("[A-Z]+", lambda m: m[0].lower(), text or "")


def plain_counts(pairs, least_count):
    n = Counter()
    for d, text in pairs:
        for run in re.findall("[a-zÀ-ÿ]+", lower(text)):
            h = zlib.crc32(f"{'' if d is None else d}:{run}".encode())
            if h % 199 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            n[run] += len(run) >= 6
    return {w: c for w, c in n.items() if c >= least_count}


def one_edit(a, b):
    if abs(len(a) - len(b)) > 1 or a == b:
        return False
    i = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))  # noqa: B905
    return a[i + (len(a) >= len(b)) :] == b[i + (len(b) >= len(a)) :]


def plain_variants(n):
    near = {w: [x for x in n if one_edit(w, x)] for w in n}
    form = {}
    for w, others in near.items():
        best = min(others, key=lambda x: (-n[x], x), default=None)
        form[w] = best if best is not None and n[best] >= 5 * n[w] else None

    def root(w):
        return w if form[w] is None else root(form[w])

    return sorted((w, form[w], root(w), n[w], len(near[w]), n[form[w]] if form[w] else None) for w in n)


def test_spelling_variants_are_those_of_all_pairs(spark, monkeypatch):
    rng = random.Random(5)
    monkeypatch.setattr(spellings, "SPLIT", 4)
    base = ["".join(rng.choice("abenorst") for _ in range(rng.randrange(6, 11))) for _ in range(40)] + ["éléphantß", "aaaaaaaa", "aaaaaaa", "abababab", "babababa"]
    made = []
    for w in base:
        made += [w] * rng.choice([5, 6, 40, 200])
        for _ in range(4):
            i = rng.randrange(len(w))
            other = rng.choice([w[:i] + w[i + 1 :], w[:i] + rng.choice("abeÿé") + w[i:], w[:i] + rng.choice("abeÀ") + w[i + 1 :]])
            made += [other] * rng.choice([4, 5, 7, 30])
    rng.shuffle(made)
    pairs = [(i if i % 7 else None, " ".join(made[i * 20 : i * 20 + 20]).capitalize() + "1" * (i % 2)) for i in range(len(made) // 20 + 1)]
    pairs += [(900, None), (901, ""), (902, "·" * 300), (903, "x" * 3000), (904, " ".join(["y" * 900] * 6)), (905, " ".join(["y" * 901] * 7))]
    pairs += pairs[:3]
    found = sorted(tuple(r) for r in spellings.variants(spark.createDataFrame(pairs, "doc_id long, text string")).select("word", "form", "root", "n", "n_near", "form_n").collect())
    want = plain_variants(plain_counts(pairs, 5))
    assert found == want
    assert sum(w[1] is not None for w in want) > 10
    assert len(want) > 60
    assert spellings.variants(empty(spark)).count() == 0
    assert spellings.variants(docs(spark)).count() == len(plain_counts([(d, t) for d, t, *_ in rows()], 5))


def test_pivots_are_the_cheapest_disjoint_grams():
    rng = random.Random(2)
    for _ in range(300):
        places = sorted(rng.sample(range(12), rng.randrange(3, 8)))
        costs = [rng.randrange(20) for _ in places]
        cost = dict(zip(places, costs, strict=True))
        chosen = spellings.pivotal(places, costs)
        pairs = [(a, b) for a in places for b in places if b - a >= 2]
        assert chosen in pairs
        assert sum(cost[i] for i in chosen) == min(cost[a] + cost[b] for a, b in pairs)


def test_words_one_edit_apart_share_a_key():
    rng = random.Random(3)
    words = {"".join(rng.choice("abc") for _ in range(rng.randrange(6, 9))) for _ in range(400)}
    frequency = Counter(w[i : i + 2] for w in words for i in range(len(w) - 1))
    keyed = {w: tuple(map(set, spellings.keys(w, frequency))) for w in words}
    pairs = [(a, b) for a in words for b in words if a < b and one_edit(a, b)]
    assert len(pairs) > 300
    assert all(keyed[a][0] & keyed[b][1] or keyed[b][0] & keyed[a][1] for a, b in pairs)


# -- Jaccard joins -----------------------------------------------------------------------------------------------------------


def grams(text, n=3):
    w = lower(text).encode().split()
    return {tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))} if w else set()


def plain_components(pairs, num, den, n=3):
    sets, parent = [grams(t, n) for _, t in pairs], list(range(len(pairs)))

    def find(i):
        return i if parent[i] == i else find(parent[i])

    for i, a in enumerate(sets):
        for j in range(i):
            if a and den * len(a & sets[j]) >= num * len(a | sets[j]):
                parent[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(pairs):
        least[find(i)] = min(least.get(find(i), math.inf), math.inf if d is None else d)
    return [(d, len(s), None if least[find(i)] == math.inf else least[find(i)]) for i, ((d, _), s) in enumerate(zip(pairs, sets, strict=True))]


def edited(rng):
    """Groups of edited copies, most of which are alike only through others, and texts of all small sizes."""
    made = []
    for g in range(5):
        base = [f"w{g}x{rng.randrange(500)}" for _ in range(rng.choice([60, 150, 400]))]
        for i in range(30):
            copy = list(base)
            for _ in range(rng.randrange(1 + len(base) // 40)):
                copy[rng.randrange(len(copy))] = f"new{rng.random()}"
            if i % 9 == 0:
                copy.append("end")
            made.append((g * 100 + i, " ".join(copy)))
    for n in range(1, 24):
        text = " ".join(f"s{i}" for i in range(n))
        made += [(1000 + n, text), (1100 + n, text.upper()), (1200 + n, text + " more")]
    return [*made, (2000, None), (2001, ""), (2002, " \n"), (None, made[0][1]), (None, "only words without an id"), made[3]]


@pytest.mark.parametrize("part", [4096, 7])
def test_partenum_links_all_pairs_that_are_alike(spark, monkeypatch, part):
    monkeypatch.setattr(set_links, "PART", part)
    pairs = edited(random.Random(4))
    found = partenum.jaccard_components(spark.createDataFrame(pairs, "doc_id long, text string")).collect()
    want = plain_components(pairs, 9, 10)
    assert sorted(map(tuple, found), key=str) == sorted(want, key=str)
    assert 30 < len({w[2] for w in want}) < len(pairs) - 60
    if part == 4096:
        assert partenum.jaccard_components(empty(spark)).count() == 0
        have = partenum.jaccard_components(docs(spark)).select("doc_id", "n_shingles", "component_id").collect()
        assert sorted(map(tuple, have), key=str) == sorted(plain_components([(d, t) for d, t, *_ in rows()], 9, 10), key=str)


def test_sets_alike_by_nine_tenths_share_a_signature():
    rng = np.random.default_rng(6)
    for _ in range(400):
        size = int(rng.choice([3, 9, 10, 19, 20, 40, 90, 300, 1000]))
        common, a, b = (rng.integers(0, 1 << 63, n).astype(np.uint64) for n in (size, rng.integers(0, size // 9 + 1), rng.integers(0, size // 9 + 1)))
        if 10 * size < 9 * (size + len(a) + len(b)) or not len(a) + len(b):
            continue
        x, y = np.unique(np.concatenate([common, a])), np.unique(np.concatenate([common, b]))
        assert np.intersect1d(partenum.signatures(x), partenum.signatures(y)).size


def test_sketches_never_differ_in_more_bits_than_sets_do():
    rng = np.random.default_rng(7)
    for _ in range(300):
        n = int(rng.integers(1, 3000))
        x = rng.integers(0, 1 << 63, n).astype(np.uint64)
        y = np.concatenate([x[int(rng.integers(0, n)) // 8 :], rng.integers(0, 1 << 63, int(rng.integers(0, 60))).astype(np.uint64)])
        table = set_links.sketch_table([set_links.parity(x), set_links.parity(y)])
        assert np.bitwise_count(table[0] ^ table[1]).sum() <= len(np.setxor1d(x, y))


@pytest.mark.parametrize("closest", [1, 2])
def test_crowded_buckets_lose_no_component(spark, closest):
    """One bucket holds everything: stars and closest pairs can't do, the rest decides."""
    from pyspark.sql import functions as F

    rng = np.random.default_rng(8 + closest)
    sets, base = [], rng.integers(0, 1 << 62, 100)
    for _ in range(60):
        copy = base.copy()
        change = rng.random(100) < rng.choice([0.02, 0.05, 0.1])
        copy[change] = rng.integers(0, 1 << 62, int(change.sum()))
        sets.append(np.unique(copy))
    made = [(i, len(s), s.tolist(), set_links.parity(s.astype(np.uint64))) for i, s in enumerate(sets)]
    table = spark.createDataFrame(made, "node long, n long, ids array<long>, sketch binary")
    buckets = set_links.met(table.select("node").withColumn("key", F.lit(5).cast("long")))
    found = {(r.a, r.b) for r in set_links.links(buckets, table, 9, 10).collect()}
    alike = {(i, j) for i in range(60) for j in range(i + 1, 60) if 10 * len(np.intersect1d(sets[i], sets[j])) >= 9 * len(np.union1d(sets[i], sets[j]))}

    def groups(pairs):
        label = list(range(60))
        for _ in range(60):
            for a, b in pairs:
                label[a] = label[b] = min(label[a], label[b])
        return label

    assert {(min(p), max(p)) for p in found} <= alike
    assert groups(found) == groups(alike)
    assert len(set(groups(alike))) > 5


# -- hard negatives ----------------------------------------------------------------------------------------------------------


def plain_negatives(table):
    kept = []
    for vec_id, v, label in table:
        if label is None or v is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        kept.append((vec_id, (label + 1) % 10 if vec_id is not None and vec_id % 7 == 0 else label, [math.floor(256 * x) for x in v]))
    out = []
    last = lambda i: (i is None, i or 0)
    for a, label, v in kept:
        if a is None or a % 100:
            continue
        scored = sorted(((sum(x * y for x, y in zip(v, w)), i, m) for i, m, w in kept), key=lambda s: (-s[0], last(s[1])))  # noqa: B905
        for p, i, _ in [s for s in scored if s[2] == label and s[1] != a][:5]:
            fits = [s for s in scored if s[2] != label and 30 * p <= 100 * s[0] <= 90 * p]
            out += [(a, i, r, s[1], p, s[0]) for r, s in enumerate(fits[:10], 1)]
    return out


VECTORS = "vec_id long, embedding array<float>, label int, key string, score int"


def vectors(rng, n):
    centres = rng.normal(size=(6, 12))
    made = []
    for i in range(n):
        v = (centres[rng.integers(6)] + rng.normal(size=12) * 0.7).astype(np.float32) * 0.2
        made.append((i, v.tolist(), int(rng.integers(10))))
    same = made[5][1]
    made += [(5000 + i, same, i % 3) for i in range(40)]
    made += [(6000, None, 1), (6100, same, None), (6200, [1.0, None, 2.0], 1), (6300, [float("nan")] * 12, 1), (6400, [float("inf")] * 12, 2)]
    made += [(6500, [0.5] * 5, 3), (6501, [0.25] * 20, 4), (None, same, 1), (None, same, 2), (6600, [], 1), (6700, [100.0] * 12, 5), (6701, [90.0] * 12, 6), (6702, [95.0] * 12, 5), made[11], made[12]]
    return [(*m, "k", 1) for m in made]


@pytest.mark.parametrize(("anchors", "stretch"), [(1 << 15, 1 << 13), (4, 100)])
def test_hard_negatives_are_those_of_all_scores(spark, monkeypatch, anchors, stretch):
    monkeypatch.setattr(negatives, "ANCHORS", anchors)
    monkeypatch.setattr(negatives, "LEAST_STRETCH", stretch)
    monkeypatch.setattr(negatives, "STRETCH", stretch)
    made = vectors(np.random.default_rng(9), 900)
    found = negatives.hard_negatives(spark.createDataFrame(made, VECTORS)).select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
    have, want = [tuple(r) for r in found.collect()], plain_negatives([m[:3] for m in made])
    assert len(want) > 200
    assert sorted(have, key=str) == sorted(want, key=str)
    assert negatives.hard_negatives(spark.createDataFrame([], VECTORS)).count() == 0


def test_scores_beyond_a_double_are_exact():
    block = negatives.Block(True, 3)
    big = negatives.LARGEST
    v = np.array([[big, big, 1]], "<i4")
    block.add({"ids": np.array([0], "<i8").tobytes(), "labels": np.array([1], "<i8").tobytes(), "keys": np.array([0], "<i8").tobytes(),
               "edges": np.array([[1 << 62, -(1 << 62)]], "<i8").tobytes(), "width": 3, "vectors": v.tobytes()})
    block.ready()
    rest = np.array([[big, big, i] for i in (1, 3, 2, 3)], "<i4")
    block.meet({"ids": np.array([9, 8, 7, 6], "<i8").tobytes(), "labels": np.ones(4, "<i8").tobytes(), "width": 3, "vectors": rest.tobytes()})
    out = defaultdict(list)
    for r in block.results().to_pylist():
        out[r["key"]].append((r["score"] - 2 * big * big, r["id"]))
    assert out[0] == [(3, 6), (3, 8), (2, 7)]


def test_stretches_of_windows_answer_like_all_of_them(monkeypatch):
    import numpy as np

    from vocalith.llm import repeats

    rng = np.random.default_rng(1)
    passage = rng.integers(97, 100, 400).astype(np.uint8)
    data = np.concatenate([np.concatenate([rng.integers(97, 123, 300).astype(np.uint8), passage]) for _ in range(60)])
    begin = np.arange(len(data) - repeats.SPAN + 1)
    value = begin // 700
    whole = repeats.longest_previous_factors(data, begin, value) >= repeats.SPAN
    sizes, one = [], repeats.longest_previous_factors
    monkeypatch.setattr(repeats, "SORTED", 8000)
    monkeypatch.setattr(repeats, "longest_previous_factors", lambda d, b, v: sizes.append(len(b)) or one(d, b, v))
    assert (repeats.whole_matches(data, begin, value) == whole).all() and whole.sum() > 10_000
    assert len(sizes) > 5 and sum(sizes) == len(begin)
