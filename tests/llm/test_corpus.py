"""Operators that compare documents with each other: against brute force."""

import hashlib
import math
import random
import tracemalloc
import zlib
from collections import Counter, defaultdict
from html.parser import HTMLParser

import numpy as np
import pytest
import xxhash

from tests.llm.fixtures import docs, empty, rows
from vocalith.llm import batches, language_model, packing, repeats, simhash, style_tree, token_files, tokenize
from vocalith.llm.common import stored


@pytest.fixture
def small_batches(monkeypatch):
    monkeypatch.setattr(batches.batched, "__defaults__", (1 << 14,))
    monkeypatch.setattr(batches.bucket_bits, "__defaults__", (1 << 14,))
    monkeypatch.setattr(batches, "scaled", lambda size: 1.0)


def ids_of(vocabulary, text):
    return tokenize.tokenizer(vocabulary).library.encode(text or "", add_special_tokens=False).ids


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


# -- packing and token files -----------------------------------------------------------------------------------------------


def test_index_holds_a_posting_in_few_bytes():
    rng = np.random.default_rng(1)
    some = [(rng.zipf(1.3, 1500) % 60000).astype(np.uint16) for _ in range(2000)]
    postings = sum(len(np.unique(x)) for x in some)
    tracemalloc.start()
    try:
        index = packing.Index(some)
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert len(index.rare.doc) + len(index.common.doc) == postings
    assert peak < 50 * postings  # bytes; 66 with 8-byte numbers for all postings at once


def test_packing_places_every_token_once(spark):
    pieces = packing.pack(docs(spark), shard_tokens=20_000).collect()
    by_sequence = defaultdict(list)
    for p in pieces:
        by_sequence[p.sequence_id].append(p)
    for parts in by_sequence.values():
        at = 0
        for p in sorted(parts, key=lambda p: p.offset):
            assert p.offset == at
            at += p.length
        assert at == 1024 or at & (at - 1) == 0
    want = Counter()
    for doc_id, text, *_ in rows():
        ids = [*ids_of(tokenize.BYTE_BPE, text), 0]
        want[doc_id] += len(ids)
        mine = [p for p in pieces if p.doc_id == doc_id]
        assert any(p.doc_tokens == len(ids) for p in mine)
        for p in mine:
            if p.doc_tokens == len(ids):
                assert p.ids_crc32 == crc(ids[p.start : p.start + p.length])
    have = Counter()
    for p in pieces:
        have[p.doc_id] += p.length
    assert have == want
    assert packing.pack(empty(spark)).count() == 0


def test_neighbours_follow_bm25():
    rng = np.random.default_rng(3)
    some = [np.append(rng.choice(400, rng.integers(5, 90)), np.arange(1000, 1000 + 3 * i)).astype(np.uint16) for i in range(90)]
    index = packing.Index(some)
    length = np.mean([len(d) for d in some])
    df = Counter(t for d in some for t in set(d.tolist()))

    def score(q, d):
        tf = Counter(some[d].tolist())
        out = 0.0
        for t in set(some[q].tolist()) & set(tf):
            idf = math.log((len(some) - df[t] + 0.5) / (df[t] + 0.5))
            if idf > 0 and df[t] <= packing.COMMON * len(some):
                out += idf * tf[t] * 2.2 / (tf[t] + 1.2 * (0.25 + 0.75 * len(some[d]) / length))
        return out

    for q in range(len(some)):
        found = list(index.neighbours(q, np.zeros(len(some), bool)))
        scores = [score(q, d) for d in found]
        assert scores == sorted(scores, reverse=True) or all(abs(a - b) < 1e-9 or a > b for a, b in zip(scores, scores[1:], strict=False))
        assert set(found) == {d for d in range(len(some)) if d != q and score(q, d) > 0}
        used = np.zeros(len(some), bool)
        used[found[::2]] = True
        assert list(index.neighbours(q, used)) == [d for d in found if not used[d]]


def test_shards_hold_documents_with_their_near_copies(spark):
    rng = random.Random(5)
    words = [[f"{t}{rng.randrange(900)}" for _ in range(300)] for t in "klmn"]
    made = []
    for i in range(240):
        base = [rng.choice(words[i % 4]) for _ in range(80)]
        made += [(2 * i, " ".join(base)), (2 * i + 1, " ".join([*base, "end"]))]
    table = spark.createDataFrame(made, "doc_id long, text string")
    places = packing.fit(packing.sampled(table, len(made), tokenize.BYTE_BPE))
    spread = packing.placed(stored(packing.encoded(table, tokenize.BYTE_BPE, places), "encoded"), 12_000)[0].collect()
    shard = {r.doc_id: r.shard for r in spread}
    assert len(set(shard.values())) > 5
    assert sum(shard[2 * i] == shard[2 * i + 1] for i in range(240)) > 216
    # a group of copies above an eighth of a shard doesn't stay together
    copies = spark.createDataFrame([(i, made[0][1]) for i in range(300)], "doc_id long, text string")
    met = packing.placed(stored(packing.encoded(copies, tokenize.BYTE_BPE), "encoded"), 12_000, 0)[0].groupBy("shard").count().collect()
    assert len(met) > 3 and max(r["count"] for r in met) < 150


def test_a_window_takes_the_seeds_nearest():
    a, b, c = np.array([1, 2, 3, 4], np.uint16), np.array([9, 8, 7, 6], np.uint16), np.array([1, 2, 3, 5], np.uint16)
    far = [np.array([50 + i, 60 + i, 70 + i, 80 + i], np.uint16) for i in range(6)]
    pieces = packing.pack_shard([a, b, c, *far], 8)
    assert [(p[0], p[3]) for p in pieces[:2]] == [(0, 0), (2, 0)]


def test_a_window_takes_those_that_share_common_terms_alone():
    """Terms in over a tenth of a shard rank documents too, where no rarer one is left."""
    own = [np.array([100 + i, 130 + i, 160 + i, 190 + i], np.uint16) for i in range(20)]
    for d in (0, 9, 12):
        own[d] = np.array([1, 2, 3, 300 + d], np.uint16)
    pieces = packing.pack_shard(own, 8)
    assert [p[0] for p in pieces[:2]] == [0, 9]


def test_token_files_read_back(spark, tmp_path):
    found = token_files.checksums(token_files.token_files(docs(spark), f"file://{tmp_path}/t")).collect()
    every = sorted(rows(), key=lambda r: (r[0] is not None, r[0] or 0))
    ordered = sorted(found, key=lambda r: r.start)
    at = 0
    for (doc_id, text, *_), r in zip(every, ordered, strict=True):
        ids = [*ids_of(tokenize.WORD_BPE, text), 1]
        assert (r.doc_id, r.start, r.n_tokens, r.ids_crc32) == (doc_id, at, len(ids), crc(ids))
        at += len(ids)
    assert token_files.token_files(empty(spark), f"file://{tmp_path}/e").count() == 0


def test_token_files_of_many_ranges_and_a_hot_id(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(token_files, "RANGE_BYTES", 4000)
    monkeypatch.setattr(token_files, "BLOCK", 3)
    rng = random.Random(2)
    made = [(7 if i % 3 == 0 else rng.randrange(-50, 400), f"word{i} " * rng.randrange(1, 40)) for i in range(600)] + [(None, "none")] * 40
    path = f"file://{tmp_path}/t"
    found = sorted(token_files.token_files(spark.createDataFrame(made, "doc_id long, text string"), path).collect(), key=lambda r: r.start)
    assert [r.doc_id for r in found] == sorted((d for d, _ in made), key=lambda d: (d is not None, d or 0))
    at = 0
    for r in found:
        assert r.start == at and r.n_tokens == len(r.ids)
        at += r.n_tokens
    files = spark.read.parquet(path).groupBy("file").count().collect()
    assert len(files) > 10 and max(r["count"] for r in files) < 100
    some = token_files.read(spark, path, 100, 200)
    assert sorted((r.doc_id, r.start) for r in some.collect()) == sorted((r.doc_id, r.start) for r in found if r.doc_id is not None and 100 <= r.doc_id <= 200)
    plan = some._jdf.queryExecution().toString()
    assert "GreaterThanOrEqual(doc_id,100)" in plan
    assert "ids" not in token_files.read(spark, path).select("start")._jdf.queryExecution().executedPlan().toString().split("ReadSchema: ")[1].split("\n")[0]


def test_token_files_have_dictionaries_deltas_row_groups_and_page_indexes(spark, tmp_path, monkeypatch):
    import pyarrow.parquet as pq

    monkeypatch.setitem(token_files.WRITER, "parquet.block.size", str(1 << 16))
    rng = random.Random(1)
    made = [(i, " ".join(rng.choice(("stone", "river", "old")) for _ in range(300))) for i in range(3000)]
    token_files.write(spark.createDataFrame(made, "doc_id long, text string"), f"file://{tmp_path}/t")
    groups = 0
    for file in tmp_path.glob("t/*.parquet"):
        meta = pq.ParquetFile(file).metadata
        groups += meta.num_row_groups
        for g in range(meta.num_row_groups):
            columns = {meta.row_group(g).column(c).path_in_schema: meta.row_group(g).column(c) for c in range(meta.num_columns)}
            ids, doc_id = columns["ids.list.element"], columns["doc_id"]
            assert "RLE_DICTIONARY" in ids.encodings and "DELTA_BINARY_PACKED" in doc_id.encodings
            assert all(c.has_offset_index and c.has_column_index for c in (ids, doc_id))
            assert doc_id.statistics.has_min_max
    assert groups > 1


# -- repeated passages -------------------------------------------------------------------------------------------------------


def removed(every):
    first, out = {}, []
    order = sorted(every, key=lambda r: (r[0] is None, r[0] or 0))
    for doc_id, text, *_ in order:
        data, key = (text or "").encode(), math.inf if doc_id is None else doc_id
        mask = np.zeros(len(data), bool)
        for p in range(len(data) - 49):
            if first.setdefault(data[p : p + 50], key) < key:
                mask[p : p + 50] = True
        out.append((doc_id, data, mask))
    return out


@pytest.mark.parametrize("hot", [4096, 2])
def test_later_copies_go(spark, small_batches, monkeypatch, hot):
    monkeypatch.setattr(repeats, "HOT", hot)  # from so many runs on, an anchor's windows go to buckets of their own
    every = rows()
    found = defaultdict(list)
    for r in repeats.digest(repeats.remove_repeats(docs(spark))).collect():
        found[r.doc_id].append((r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256))
    want = defaultdict(list)
    for doc_id, data, mask in removed(every):
        spans = int((np.diff(np.concatenate([[0], mask.view(np.int8)])) == 1).sum())
        want[doc_id].append((len(data), int(mask.sum()), spans, hashlib.sha256(np.frombuffer(data, np.uint8)[~mask].tobytes()).hexdigest()))
    assert {k: sorted(v) for k, v in found.items()} == {k: sorted(v) for k, v in want.items()}
    assert sum(x[1] for v in found.values() for x in v) > 0
    kept = repeats.without_repeats(docs(spark))
    assert kept.columns == docs(spark).columns
    assert repeats.remove_repeats(empty(spark)).count() == 0


def test_longest_previous_factors_match_the_definition():
    rng = np.random.default_rng(5)
    texts = [bytes(rng.choice([97, 98], 120).tolist()) for _ in range(6)]
    texts[3] = texts[0][10:90] + texts[1][:40]
    data = np.frombuffer(b"".join(t + bytes([i]) * 50 for i, t in enumerate(texts)), np.uint8)
    begin, value = [], []
    for i in range(6):
        begin += range(170 * i, 170 * i + 120)
        value += [5 - i if i % 2 else i] * 120
    begin, value = np.array(begin), np.array(value)
    found = repeats.longest_previous_factors(data, begin, value)
    raw = data.tobytes()
    for n in range(0, len(begin), 7):
        mine = raw[begin[n] : begin[n] + 50]
        best = 0
        for m in np.flatnonzero(value < value[n]):
            other = raw[begin[m] : begin[m] + 50]
            best = max(best, next((k for k in range(50) if mine[k] != other[k]), 50))
        assert found[n] == best


# -- near duplicates -----------------------------------------------------------------------------------------------------------


def plain_fingerprint(text):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    shingles = [b" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or [b" ".join(words)]
    h = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def plain_components(prints):
    keys = sorted(set(prints))
    parent = {k: k for k in keys}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(keys):
        for b in keys[i:]:
            if (a ^ b).bit_count() <= 2:
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return {k: find(k) for k in keys}


def test_near_duplicates_against_all_pairs(spark):
    every = rows()
    found = sorted(((r.doc_id, r.fp & (1 << 64) - 1, r.component_id) for r in simhash.near_duplicates(docs(spark)).collect()), key=str)
    prints = [(d, plain_fingerprint(t)) for d, t, *_ in every]
    roots = plain_components([p for _, p in prints])
    least = {}
    for d, p in prints:
        if d is not None:
            least[roots[p]] = min(least.get(roots[p], d), d)
    assert found == sorted(((d, p, least.get(roots[p])) for d, p in prints), key=str)
    kept = simhash.deduplicate(docs(spark))
    assert kept.columns == docs(spark).columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted(set(least.values()))
    assert simhash.near_duplicates(empty(spark)).count() == 0
    assert simhash.deduplicate(empty(spark)).count() == 0


@pytest.mark.parametrize("bound", [2048, 3])
def test_links_in_crowded_buckets_are_exact(spark, monkeypatch, bound):
    monkeypatch.setattr(simhash, "BUCKET", bound)
    rng = random.Random(2)
    centre = rng.getrandbits(64)
    prints = {centre ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64)) ^ (rng.getrandbits(64) if rng.random() < 0.3 else 0) for _ in range(150)}
    nodes = spark.createDataFrame([(p - (1 << 64) if p >> 63 else p,) for p in prints], "fp long")
    pairs = simhash.components(simhash.links(nodes)).collect()
    unsigned = lambda x: x & (1 << 64) - 1
    groups = defaultdict(set)
    for r in pairs:
        groups[r.root] |= {unsigned(r.node), unsigned(r.root)}
    want = defaultdict(set)
    for k, root in plain_components(prints).items():
        want[root].add(k)
    assert sorted(map(sorted, groups.values())) == sorted(sorted(v) for v in want.values() if len(v) > 1)


def test_rows_without_an_id_of_their_own_are_deduplicated_by_text(spark):
    texts = [" ".join(f"{topic}{i * i}" for i in range(60)) for topic in ("sea", "hill", "road", "moon", "wood")]
    made = [(None, texts[0]), (None, texts[0]), (None, texts[1]), (1, texts[2]), (None, texts[2]), (2, texts[3]), (2, texts[4]), (2, texts[4])]
    kept = simhash.deduplicate(spark.createDataFrame(made, "doc_id long, text string")).collect()
    want = [(None, texts[0]), (None, texts[1]), (1, texts[2]), (2, texts[3]), (2, texts[4])]
    assert sorted(map(str, map(tuple, kept))) == sorted(map(str, want))
    one = spark.createDataFrame([(None, texts[0]), (1, texts[1]), (None, texts[1])], "doc_id long, text string")
    assert sorted(r.text for r in simhash.deduplicate(one).collect()) == sorted(texts[:2])


@pytest.mark.parametrize("part", [4096, 5])
def test_the_pipeline_finds_all_near_copies(spark, monkeypatch, part):
    import corpus_pipeline

    from vocalith.llm import set_links

    monkeypatch.setattr(set_links, "PART", part)
    rng, made = random.Random(11), []
    for g in range(8):
        base = [f"w{g}x{rng.randrange(400)}" for _ in range(120)]
        for i in range(14):
            copy = list(base)
            for _ in range(rng.randrange(4)):
                copy[rng.randrange(120)] = f"new{rng.random()}"
            made.append((g * 100 + i, " ".join(copy)))
    made += [(2000, None), (2001, ""), (2002, "a b"), (2003, "A  b"), (None, made[0][1])]

    def grams(text):
        w = (text or "").lower().split()
        return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()

    sets, parent = [grams(t) for _, t in made], list(range(len(made)))

    def find(i):
        return i if parent[i] == i else find(parent[i])

    for i, a in enumerate(sets):
        for j in range(i):
            if a == sets[j] or 5 * len(a & sets[j]) >= 4 * len(a | sets[j]):
                parent[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(made):
        least[find(i)] = min(least.get(find(i), 1 << 40), (1 << 40) if d is None else d)
    assert len(least) < 60
    stage = dict(corpus_pipeline.STAGES)["near_duplicates"]
    kept = stage(spark, spark.createDataFrame(made, "doc_id long, text string"), "")
    assert sorted(r.doc_id for r in kept.collect()) == sorted(least.values())


def test_the_pipeline_finds_copies_by_fingerprints_where_no_band_meets(spark):
    """Two pairs alike by 9 of 11 shingles that share none of the minhash bands; and texts of equal fingerprints that are less alike."""
    import corpus_pipeline

    from vocalith.llm import near_copies, set_links

    made = []
    for g in (6434, 116600):
        refrain = " ".join(f"w{g}x{i}" for i in range(9))
        made += [(g, " ".join([refrain] * 60 + ["end"])), (g + 1, " ".join([refrain] * 60 + ["other"]))]
        one, two = (near_copies.bands(set_links.shingles(t.encode(), 5), *near_copies._coefficients()) for _, t in made[-2:])
        assert not set(one) & set(two)
        made.append((g + 2, " ".join([refrain] * 60 + [f"own{i}" for i in range(9)])))
    table = spark.createDataFrame(made, "doc_id long, text string")
    kept = dict(corpus_pipeline.STAGES)["near_duplicates"](spark, table, "")
    assert sorted(r.doc_id for r in kept.collect()) == [6434, 6436, 116600, 116602]


# -- language model --------------------------------------------------------------------------------------------------------------


def test_scores_against_plain_counts(spark, small_batches, monkeypatch):
    kept = {}
    learn = language_model.learn_weights
    monkeypatch.setattr(language_model, "learn_weights", lambda h, n, v: kept.setdefault("w", learn(h, n, v)))
    found = sorted((tuple(r) for r in language_model.score(docs(spark)).collect()), key=str)
    weights, every = kept["w"], rows()
    tokens = [(d, [*(t or "").encode().lower().split(), b" end"]) for d, t, *_ in every]
    one, two = Counter(), Counter()
    for d, t in tokens:
        if not language_model.held_out(d):
            one.update(t)
            two.update(zip([b" start", *t[:-1]], t, strict=True))
    n, v = sum(one.values()), len(one)
    one[b" start"] = one[b" end"]
    want = []
    for d, t in tokens:
        base = sum(math.log10((one[x] + 1) / (n + v + 1)) for x in t)
        score = 0.0
        for u, x in zip([b" start", *t[:-1]], t, strict=True):
            a, b, c = weights[0 if not one[u] else min(1 + int(math.log2(one[u])), language_model.BUCKETS - 1)]
            score += math.log10(a * two[u, x] / max(one[u], 1) + b * one[x] / n + c / (v + 1))
        want.append((d, language_model.held_out(d), len(t), sum(one[x] > 0 for x in t), n, base, score))
    want.sort(key=str)
    assert [f[:5] for f in found] == [w[:5] for w in want]
    assert np.allclose([f[5:] for f in found], [w[5:] for w in want])
    held = [(f[2], f[5], f[6]) for f in found if f[1]]
    assert held
    assert sum(h[2] for h in held) > sum(h[1] for h in held)  # better than add-one counts on what it hasn't seen
    assert language_model.score(empty(spark)).count() == 0


def test_held_out_texts_change_no_other_score(spark, small_batches):
    made = [(i, " ".join(t.split()[:3000]) if t else t) for i, t, *_ in rows() if i is not None]
    held = {i for i, _ in made if language_model.held_out(i)}
    assert held
    score = lambda some: {r.doc_id: r.score for r in language_model.score(spark.createDataFrame(some, "doc_id long, text string")).collect()}
    one, other = score(made), score([(i, "zzz qqq" if i in held else t) for i, t in made])
    assert {i for i in one if not math.isclose(one[i], other[i])} <= held
    assert any(not math.isclose(one[i], other[i]) for i in held)


def test_weights_are_those_of_counts_without_the_tuning_documents(spark, small_batches, monkeypatch):
    kept, learn = {}, language_model.learn_weights
    monkeypatch.setattr(language_model, "learn_weights", lambda h, n, v: kept.setdefault("all", (h, learn(h, n, v), n, v))[1])
    rng = random.Random(8)
    made = [(i, " ".join(rng.choice("abcdefgh") + rng.choice("xy") * (rng.random() < 0.1) for _ in range(40))) for i in range(60)]
    language_model.score(spark.createDataFrame(made, "doc_id long, text string")).collect()
    histogram, weights, n, v = kept["all"]
    tokens = {i: [*t.encode().split(), b" end"] for i, t in made}
    pairs = lambda t: zip([b" end", *t[:-1]], t, strict=True)
    train = [i for i in tokens if not language_model.held_out(i)]
    one, two, want = Counter(x for i in train for x in tokens[i]), Counter(p for i in train for p in pairs(tokens[i])), Counter()
    none, step = -(1 << 20), language_model.STEPS
    tuned = [i for i in train if language_model.fold(i) == language_model.TUNING]
    for i in tuned:
        ones, twos = one - Counter(tokens[i]), two - Counter(pairs(tokens[i]))
        for u, x in pairs(tokens[i]):
            bucket = min(1 + int(math.log2(ones[u])), language_model.BUCKETS - 1) if ones[u] else 0
            want[bucket, round(step * math.log2(twos[u, x] / ones[u])) if twos[u, x] else none, round(step * math.log2(ones[x])) if ones[x] else none] += 1
    assert tuned
    assert {tuple(h[:3]): h[3] for h in histogram.tolist()} == want
    # plain expectation-maximisation of one bucket on the same rounded ratios
    bucket = max({b for b, *_ in want}, key=lambda b: sum(c for k, c in want.items() if k[0] == b))
    w = [1 / 3] * 3
    for _ in range(language_model.ITERATIONS):
        share = [1.0] * 3
        for (b, pair, word), c in want.items():
            if b == bucket:
                p = [w[0] * (2 ** (pair / step) if pair != none else 0), w[1] * (2 ** (word / step) / n if word != none else 0), w[2] / (v + 1)]
                share = [s + c * x / sum(p) for s, x in zip(share, p, strict=True)]
        w = [s / sum(share) for s in share]
    assert np.allclose(weights[bucket], w)


def test_weights_sum_to_one_and_leave_room_for_the_unknown():
    histogram = np.array([[3, -4, 20, 50], [3, -(1 << 20), 8, 10], [5, -(1 << 20), -(1 << 20), 7]], np.int64)
    w = language_model.learn_weights(histogram, 1000, 200)
    assert np.allclose(w.sum(axis=1), 1)
    assert (w[:, 2] > 0).all()
    assert w[5, 2] > w[3, 2]


# -- web pages --------------------------------------------------------------------------------------------------------------------


PAGE = (
    "<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var a='</p>';</script></head><body><header>Site</header>"
    "<nav><ul><li><a href='/'>Home</a></ul></nav><div class=\"cookie-notice\">We bake</div><article><h1>Head &amp; line</h1><p>One  <b>two\n</b>three<br>four<p>five</p>"
    "<div class='comments'><p>first!</p></div></article><aside>more</aside><form><input>go</form><footer>&copy; us</footer></body></html>"
)


def test_only_the_article_is_left():
    assert style_tree.main_text(PAGE) == "Head & line\nOne two three four\nfive"


@pytest.mark.parametrize("page", ["", "<", "<p", "<div><p>x", "</p></div>", "<!-- never closed", "<script>x", "plain &lt;text&gt;", "<p>a<table><tr><td>b<td>c</table>"])
def test_broken_pages_are_read_to_their_end(page):
    assert isinstance(style_tree.main_text(page), str)
    assert style_tree.main_text("<div><p>x") == "x"
    assert style_tree.main_text("plain &lt;text&gt;") == "plain <text>"


@pytest.mark.parametrize(
    "page", ['<div class="share-price"><p>T', '<article><section class="related-work"><p>T', "<div data-id=related data-role=navigation><p>T", "<p title=it's>T", '<p title="a > b">T', '<div class="layout has-sidebar"><article>T', '<article class="post comments-open">T', '<main class="search-results">T', '<div class="sidebar"><article>T', "<main id=comments>T"]
)
def test_class_words_around_the_article_leave_it(page):
    assert style_tree.main_text(page) == "T"
    assert style_tree.main_text("<p>if 3 < 5 then x") == "if 3 < 5 then x"
    assert style_tree.main_text("<p>1 < 2 is true") == "1 < 2 is true"
    assert style_tree.main_text("<p title=it's>Hello isn't it</p>") == "Hello isn't it"
    assert style_tree.main_text('<p>x <a href="cut') == "x"
    assert style_tree.main_text("<main>T</main><div class=comments><article>C</article></div><div class=cookie-notice>N</div>") == "T"


def test_site_trees_drop_what_all_pages_say(spark):
    rng = random.Random(4)
    made = []
    for i in range(60):
        body = "".join(f"<p>{rng.random()} words {rng.random()}</p>" for _ in range(3))
        made.append((i, f"http://site.org/{i}", f"<body><div class=strip>Same on all pages</div><div class=body>{body}</div></body>"))
    made += [(100, None, None), (101, "http://alone.org/", "<div class=strip>Only here</div>"), (0, *made[0][1:])]
    pages = spark.createDataFrame(made, "page_id long, url string, html string")
    for bound in (1 << 17, 0):
        found = {r.page_id: r.text for r in style_tree.extract(pages, bound).collect()}
        assert all("Same" not in found[i] and found[i].count("words") == 3 for i in range(60))
        assert found[100] == "" and found[101] == "Only here"
    assert style_tree.extract(pages.limit(0)).count() == 0


def test_trees_decide_inside_the_article(spark):
    page = "<body><main class=body><div class=box>Buy this everywhere</div><p>text {}</p></main></body>"
    pages = spark.createDataFrame([(i, "http://a.org/x", page.format(i)) for i in range(40)], "page_id long, url string, html string")
    assert {r.page_id: r.text for r in style_tree.extract(pages).collect()} == {i: f"text {i}" for i in range(40)}


def test_copies_do_not_make_the_tree_remove_their_text(spark):
    page = "<body><div class=strip>Same on all pages</div><div class=body><p>{}</p></div></body>"
    made = [(i, "http://a.org/x", page.format("copied words" if i < 90 else f"unique words {i}")) for i in range(100)]
    made += [(i, "http://b.org/x", "<div class=body><p>only this</p></div>") for i in range(200, 206)]
    pages = spark.createDataFrame(made, "page_id long, url string, html string")
    for bound in (1 << 17, 0):
        found = {r.page_id: r.text for r in style_tree.extract(pages, bound).collect()}
        assert all(found[i] == ("copied words" if i < 90 else f"unique words {i}") for i in range(100))
        assert all(found[i] == "only this" for i in range(200, 206))


class Tree(HTMLParser):
    """A second reader of well-formed pages: nested lists of (label, children), texts as strings."""

    def __init__(self, page):
        super().__init__()
        self.root = ("", [])
        self.open = [self.root]
        self.feed(page)
        self.close()

    def handle_starttag(self, tag, attrs):
        node = (".".join([tag, *sorted(dict(attrs).get("class", "").split())]), [])
        self.open[-1][1].append(node)
        self.open.append(node)

    def handle_endtag(self, tag):
        self.open.pop()

    def handle_data(self, data):
        if data.strip():
            self.open[-1][1].append(" ".join(data.split()))

    def leaves(self):
        """(labels from the top, text)."""

        def walk(node, above):
            for x in node[1]:
                if isinstance(x, str):
                    yield above, x
                else:
                    yield from walk(x, (*above, x[0]))

        return list(walk(self.root, ()))

    def shapes(self):
        def walk(node, above):
            if any(not isinstance(x, str) for x in node[1]):
                yield above, tuple(x[0] for x in node[1] if not isinstance(x, str))
            for x in node[1]:
                if not isinstance(x, str):
                    yield from walk(x, (*above, x[0]))

        return {at: shape for at, shape in walk(self.root, ()) if at}


def texts_by_definition(pages):
    """(page_id, text) of pages (page_id, host, html) by entropies counted page by page."""
    hosts, out = defaultdict(list), {}
    for page_id, host, page in pages:
        hosts[host].append((page_id, Tree(page)))
    for trees in hosts.values():
        distinct = {tuple(t for _, t in tree.leaves()): tree for _, tree in trees}.values()
        said, shapes, seen = defaultdict(Counter), defaultdict(Counter), Counter()
        for tree in distinct:
            texts = {(at[:i], text) for at, text in tree.leaves() for i in range(1, len(at) + 1)}
            for node, text in texts:
                said[node][text] += 1
            for node in {node for node, _ in texts}:
                seen[node] += 1
            for node, shape in tree.shapes().items():
                shapes[node][shape] += 1

        def importance(node):
            m = seen[node]
            if m < 2:
                return 1.0
            total = sum(said[node].values())
            # a text on n pages is spread evenly over them: its entropy is log n
            content = sum(n * (1 - math.log(n) / math.log(m)) for n in said[node].values()) / total
            all_ = sum(shapes[node].values())
            shape = -sum(n / all_ * math.log(n / all_) for n in shapes[node].values()) / math.log(m) if all_ else 0.0
            return 0.9 * content + 0.1 * shape

        noisy = {node for node in seen if (seen[node] * importance(node) + 2) / (seen[node] + 2) < 0.3}
        for page_id, tree in trees:
            leaves = [(at, text) for at, text in tree.leaves() if at[0] != "nav"]
            if inside := [(at, text) for at, text in leaves if at[0] == "article"]:
                leaves = inside
            below = lambda at: at[1:] if at[0] == "article" else at
            kept = [text for at, text in leaves if not any(at[: len(at) - len(below(at)) + i] in noisy for i in range(1, len(below(at)) + 1))]
            out[page_id] = "\n".join(kept or [text for _, text in leaves])
    return out


def test_extraction_against_entropies_by_definition(spark):
    rng, made = random.Random(12), []
    for host, size in (("a.org", 40), ("b.org", 12), ("c.org", 5), ("d.org", 3), ("e.org", 1)):
        strips = [f"strip {i} of {host}" for i in range(4)]
        for i in range(size):
            body = "".join(f"<p>{rng.random()} {host}</p>" for _ in range(rng.randrange(1, 4)))
            notes = "".join(f'<div class="n{k}"><p>{rng.choice(strips) if k else strips[0]}</p></div>' for k in range(rng.randrange(1, 4)))
            page = f'<nav><p>{rng.random()}</p></nav><div class="top"><p>{strips[1]}</p></div>'
            page += f"<article>{notes}{body}</article>" if rng.random() < 0.5 else f'<div class="body">{body}</div>{notes}'
            made.append((host, page))
    made += [made[0]] * 30 + [made[45]] * 3
    made = [(i, *x) for i, x in enumerate(made)]
    want = texts_by_definition(made)
    table = spark.createDataFrame([(i, f"http://{h}/{i}", p, "clash", "clash") for i, h, p in made], "page_id long, url string, html string, host_ string, noisy_ string")
    plain = {i: style_tree.main_text(p) for i, _, p in made}
    assert sum(plain[i] != want[i] for i in want) > 20  # the trees decide
    for bound in (1 << 17, 0):
        assert {r.page_id: r.text for r in style_tree.extract(table, bound).collect()} == want


# -- the whole --------------------------------------------------------------------------------------------------------------------


def test_pipeline_stages(spark):
    import corpus_pipeline

    from vocalith.llm.common import stored

    current = docs(spark).select("doc_id", "text", "lang", "source", "n_chars")
    columns = current.columns
    seen = {}
    for name, stage in corpus_pipeline.STAGES:
        before = current
        current = stored(stage(spark, current, ""), name)
        seen[name] = (before, current)
        if name != "lexical_packing":
            assert current.columns == columns
    first, second = seen["quality_rules"]
    assert 0 < second.count() < first.count()
    mixed, packed = seen["lexical_packing"]
    assert packed.selectExpr("sum(length)").first()[0] == sum(len(ids_of(tokenize.BYTE_BPE, r.text)) + 1 for r in mixed.collect())


def test_pipeline_stages_on_empty_tables_and_clashing_names(spark):
    import corpus_pipeline

    nothing = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
    clashing = docs(spark).selectExpr("doc_id", "text", "source", "n_chars", "1 as copies", "'x' as node", "'y' as kept", "2L as fp_", "3 as size", "'z' as row_")
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, nothing, "").count() == 0, name
        if name != "lexical_packing":
            assert stage(spark, nothing, "").columns == nothing.columns
            clashing_out = stage(spark, clashing, "")
            assert clashing_out.columns == clashing.columns, name
            assert 0 < clashing_out.count() <= 3 * clashing.count()


def test_texts_longer_than_every_chunk(spark, monkeypatch):
    """Texts that cross the bounds of pieces that are hashed at a time."""
    from vocalith.llm import anchors

    monkeypatch.setattr(anchors, "CHUNK", 1 << 12)
    monkeypatch.setattr(anchors, "LONGEST", 64)
    monkeypatch.setattr(simhash, "SLICE", 100)
    monkeypatch.setattr(tokenize, "SLICE_BYTES", 1 << 12)
    rng = random.Random(3)
    long = " ".join(f"w{rng.randrange(9000)}" for _ in range(6000))
    same = "z" * 9000
    made = [(1, long), (2, "start " + long[5000:30000] + " end"), (3, same), (4, same[:400]), (5, "é" * 3000)]
    table = spark.createDataFrame(made, "doc_id long, text string")
    found = {r.doc_id: r for r in repeats.digest(repeats.remove_repeats(table)).collect()}
    for doc_id, data, mask in removed(made):
        assert found[doc_id].n_removed == int(mask.sum())
        assert found[doc_id].kept_sha256 == hashlib.sha256(np.frombuffer(data, np.uint8)[~mask].tobytes()).hexdigest()
    for _, text in made:
        w = text.lower().encode().split()
        grams = [b" ".join(w[i : i + 3]) for i in range(max(1, len(w) - 2))]
        h = [xxhash.xxh64_intdigest(g, 42) for g in grams]
        assert simhash.fingerprint(text.encode()) == sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))
        assert tokenize.tokenizer(tokenize.BYTE_BPE).ids(text.encode()).tolist() == ids_of(tokenize.BYTE_BPE, text)
