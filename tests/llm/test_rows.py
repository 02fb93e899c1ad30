"""Operators that look at rows one by one, or sum over sources: against plain Python."""

import hashlib
import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest

from tests.llm.fixtures import COLUMNS, docs, empty, rows
from vocalith.llm import media, mixing, quality, tokenize, urls


def repeated_words(words):
    seen, covered = {}, set()
    for i in range(len(words) - 7):
        seen.setdefault(tuple(words[i : i + 8]), []).append(i)
    for at in seen.values():
        if len(at) > 1:
            covered.update(j for i in at for j in range(i, i + 8))
    return len(covered)


def test_ledger_measures_every_text(spark):
    found = quality.apply_policy(quality.ledger(docs(spark).select("doc_id", "text", "words_"))).collect()
    assert len(found) == len(rows())
    for r in found:
        text = r.text or ""
        words = [w.decode() for w in text.encode().split()]
        lines = [x for x in text.split("\n") if x.encode().split()]
        assert (r.n_words, r.word_chars) == (len(words), sum(map(len, words)))
        assert r.n_symbols == sum(c in "#*$%&|<>" for c in text)
        assert r.n_dup_lines == len(lines) - len(set(lines))
        assert r.n_repeat_words == repeated_words(words)
        assert r.kept == (r.fail_mask & quality.mask(quality.POLICIES[quality.CURRENT]) == 0)
        assert bool(r.fail_mask & 1) == (len(words) < 20)


def test_policies_and_ablation_read_the_mask(spark):
    ledger = quality.ledger(docs(spark))
    report = {r.rule: r for r in quality.ablation(ledger).collect()}
    masks = [r.fail_mask for r in ledger.collect()]
    for i, name in enumerate(quality.RULES):
        assert report[name].n_failed == sum(m >> i & 1 for m in masks)
        assert report[name].n_only_this == sum(m == 1 << i for m in masks)
    assert quality.apply_policy(ledger, "base").filter("kept").count() >= quality.apply_policy(ledger, "v2").filter("kept").count()


def test_quality_filter_keeps_columns_and_empty_tables(spark):
    kept = quality.quality_filter(docs(spark))
    assert kept.columns == docs(spark).columns
    assert quality.quality_filter(empty(spark)).count() == 0


def fill(sizes, weights, cap):
    """Targets by repeated sharing of the excess."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    target, open_, left = {}, set(order), sum(sizes.values())
    while open_:
        level = left / sum(w[s] for s in open_)
        full = {s for s in open_ if cap * sizes[s] <= level * w[s]}
        if not full:
            return target | {s: level * w[s] for s in open_}
        target |= {s: float(cap * sizes[s]) for s in full}
        left -= sum(cap * sizes[s] for s in full)
        open_ -= full
    return target


def test_targets_fill_up_to_their_caps(spark):
    planned = mixing.plan(docs(spark)).collect()
    sizes = Counter()
    for r in planned:
        assert r.size == len((r.text or "").encode().split())
        sizes[r.source] += r.size
    want = fill(dict(sizes), mixing.WEIGHTS, mixing.CAP)
    for r in planned:
        assert r.source_size == sizes[r.source]
        assert r.target == pytest.approx(want[r.source])
        assert 0 <= r.copies <= 3
    again = {(r.doc_id, r.copies) for r in mixing.plan(docs(spark)).collect()}
    assert again == {(r.doc_id, r.copies) for r in planned}


def test_mixture_is_near_its_targets(spark):
    rng = random.Random(1)
    some = [(i, "w " * rng.randrange(1, 60), "en", f"s{i % 3}" if i % 7 else None, 0, "", 0) for i in range(4000)]
    planned = mixing.plan(spark.createDataFrame(some, COLUMNS)).collect()
    taken, target = Counter(), {}
    for r in planned:
        taken[r.source] += r.size * r.copies
        target[r.source] = r.target
    assert all(abs(taken[s] / t - 1) < 0.1 for s, t in target.items())
    mixed = mixing.mix(spark.createDataFrame(some, COLUMNS))
    assert mixed.count() == sum(r.copies for r in planned)
    assert mixed.columns == [c.split()[0] for c in COLUMNS.split(", ")]
    assert mixing.mix(empty(spark)).count() == 0


def test_image_round_trip(spark):
    found = {}
    for r in media.describe(media.to_media(docs(spark).select("doc_id", "text", "size"))).collect():
        found.setdefault(r.doc_id, r)
    for doc_id, text, *_ in rows():
        data = media.payload((text or "").encode())
        r = found[doc_id]
        assert (r.n_bytes, r.payload_bytes, r.size) == (len((text or "").encode()), len(data), r.size)
        assert r.payload_sha256 == hashlib.sha256(data).hexdigest()
        assert r.tail_crc32 == zlib.crc32(data[-16:])
    assert media.describe(media.to_media(empty(spark).select("doc_id", "text"))).count() == 0


def frequencies(data):
    """The feature by its definition: means of a 32 x 32 grid's cells, then each cosine sum by itself."""
    grey = np.frombuffer(data, np.uint8).reshape(-1, 64, 3).mean(axis=2)
    h, w = grey.shape
    cell = lambda i, n: range(i * n // 32, max((i + 1) * n // 32, i * n // 32 + 1))
    small = [[np.mean([grey[y, x] for y in cell(i, h) for x in cell(j, w)]) for j in range(32)] for i in range(32)]
    cos = [[math.cos(math.pi * (k + 0.5) * f / 32) for k in range(32)] for f in range(8)]
    low = [round(sum(cos[u][i] * cos[v][j] * small[i][j] for i in range(32) for j in range(32)), 6) for u in range(8) for v in range(8)]
    middle = sorted(low[1:])[31]
    return f"{sum(int(x > middle) << (63 - i) for i, x in enumerate(low)):016x}"


def test_media_features_by_definition(spark):
    rng = random.Random(8)
    some = [(i, "".join(rng.choice("abcdefgh \néß日") for _ in range(n))) for i, n in enumerate((0, 5, 191, 192, 193, 700, 6500, 20000))]
    for r in media.describe(media.to_media(spark.createDataFrame(some, "doc_id long, text string"))).collect():
        data = media.payload(some[r.doc_id][1].encode())
        png = media.encode_png(data)
        assert (r.media_bytes, r.media_sha256) == (len(png), hashlib.sha256(png).hexdigest())
        assert r.feature == frequencies(data), len(data)


def filtered(image, kinds):
    """Rows filtered by the definition, byte by byte."""
    h, w, c = image.shape
    flat, out = image.reshape(h, -1).astype(int), []
    for y, kind in enumerate(kinds):
        row = [kind]
        for x in range(w * c):
            a = flat[y, x - c] if x >= c else 0
            b = flat[y - 1, x] if y else 0
            d = flat[y - 1, x - c] if y and x >= c else 0
            near = min((a, b, d), key=lambda v: abs(a + b - d - v))
            row.append((flat[y, x] - (0, a, b, (a + b) // 2, near)[kind]) & 255)
        out.append(row)
    return np.array(out, np.uint8)


@pytest.mark.parametrize("channels", [1, 3, 4])
def test_unfilter_knows_all_filters(channels):
    rng = np.random.default_rng(channels)
    image = rng.integers(0, 256, (23, 9, channels), np.uint8)
    kinds = [0, 1, 1, 2, 2, 2, 3, 4, 4, 0, 2, 1, 3, 3, 4, 2, 2, 1, 0, 4, 3, 2, 1]
    assert (media.unfilter(filtered(image, kinds), channels).reshape(image.shape) == image).all()


def test_broken_images_are_refused():
    png = media.encode_png(media.payload(b"hello"))
    assert media.decode_png(png).tobytes() == media.payload(b"hello")
    for broken in (png[:-1], png[:60] + b"\0" + png[61:], b"x" + png[1:], png[:40]):
        with pytest.raises(ValueError):
            media.decode_png(broken)


@pytest.mark.parametrize("vocabulary", [tokenize.BYTE_BPE, tokenize.WORD_BPE])
def test_units_give_the_tokenizers_ids(vocabulary):
    t = tokenize.tokenizer(vocabulary)
    texts = [r[1] or "" for r in rows()] + [
        "a   b  c", "It's  we'll\n\n foo\n", "<|endoftext|>x <|endoftext|> y", "é é", " lead", "trail \n ", "a\tb\r\nc", "a\x01 b", "x ​ y  z", "ÀÉ ½²³ª º",
    ]
    for text in texts:
        assert t.ids(text.encode()).tolist() == t.library.encode(text, add_special_tokens=False).ids, text


URLS = [
    None, "", "no scheme", "http://A.example.COM/en/x", "https://www.example.com/en/y?q#f", "http://x.net/es/", "http://x.net/es", "http://net/fr/1",
    "http://evilnet/fr/1", "ftp://b.org", "http://casino.example.org/p.html", "http://www.casino.example.org/p/", "http://casino.example.org/q", "http://ok.org/p?x=/en/", "http://ok.org#/en/",
]


def verdict(url):
    if not url or "://" not in url:
        return "", "", None
    rest = url.split("://", 1)[1].split("#")[0].split("?")[0]
    host, slash, path = rest.partition("/")
    host, path = host.lower(), slash + path
    fits = [(len(h + p), h + p, v) for h, p, v in urls.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return host, path, max(fits, default=None)


def test_urls_are_judged_by_the_longest_rule_then_the_list(spark):
    pages = spark.createDataFrame(list(enumerate(URLS)), "page_id long, url string").withColumnRenamed("url", "url")
    listed = spark.createDataFrame([("casino.example.org/p",), ("casino.example.org/p",), (None,)], "canonical string")
    for bound in (1 << 20, 0):  # the filter sent to all, and joined
        found = {r.page_id: r for r in urls.judge(pages, listed, broadcast_bytes=bound).collect()}
        assert len(found) == len(URLS)
        for i, url in enumerate(URLS):
            host, path, rule = verdict(url)
            r = found[i]
            assert (r.host, r.path) == (host, path)
            if rule:
                assert (r.rule, r.verdict) == rule[1:]
            else:
                assert r.rule is None
                assert r.verdict == ("block" if host.endswith("casino.example.org") and path in ("/p.html", "/p/") else "allow"), url


def test_only_possible_hits_are_shuffled(spark, tmp_path):
    spark.range(500).selectExpr("id as page_id", "concat('http://h', id % 50, '.org/', id) as url").write.parquet(str(tmp_path / "pages"))
    pages = spark.read.parquet(str(tmp_path / "pages"))
    listed = urls.parsed(pages.filter("page_id % 100 = 0")).select("canonical")
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        judged = urls.judge(pages, listed)
        missed, possible = (p.toString() for p in (judged._jdf.queryExecution().executedPlan().children().apply(i) for i in (0, 1)))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    of_pages = lambda plan: plan[: plan.index("BroadcastExchange")] if "BroadcastExchange" in plan else plan
    assert "Exchange hashpartitioning" not in of_pages(missed)
    assert "Exchange hashpartitioning(canonical" in possible
    assert judged.filter("verdict = 'block'").count() == 5


def test_empty_lists_and_tables(spark):
    none = spark.createDataFrame([], "canonical string")
    pages = spark.createDataFrame([], "page_id long, url string")
    assert urls.judge(pages, none).count() == 0
    some = spark.createDataFrame([(1, "http://a.org/")], "page_id long, url string")
    assert [r.verdict for r in urls.judge(some, none).collect()] == ["allow"]


def test_bloom_filter_has_no_false_negatives(spark):
    pages = spark.range(3000).selectExpr("id as page_id", "concat('http://h', id % 50, '.org/', id) as url")
    listed = urls.parsed(pages).filter("page_id % 3 = 0").select("canonical")
    found = urls.judge(pages, listed).collect()
    assert all((r.verdict == "block") == (r.page_id % 3 == 0) for r in found)
