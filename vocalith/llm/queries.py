"""The registered queries of this subpackage, one for each operator, over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vocalith.llm import language_model, media, mixing, negatives, packing, partenum, quality, repeats, simhash, spellings, style_tree, token_files, urls
from vocalith.llm.common import stored, table


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    measured = quality.ledger(table(spark, sf_dir, "documents").select("doc_id", "text")).drop("text")
    rows = quality.sole_rules(quality.apply_policy(stored(measured, "ledger")))
    base = F.col("fail_mask").bitwiseAND(F.lit(quality.mask(quality.BASE))) != 0
    return rows.select(
        "doc_id", *quality.MEASURES, "fail_mask", base.alias("base_failed"), (F.col("kept") & ~base).alias("kept"), "sole_rule"
    )


def op2_style_tree_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = style_tree.extract(table(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return found.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


def op3_lexical_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


def op4_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.describe(media.to_media(table(spark, sf_dir, "documents").select("doc_id", "text")))


def op5_suffix_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.digest(repeats.remove_repeats(table(spark, sf_dir, "documents").select("doc_id", "text")))


def op6_simhash_pivots(spark: SparkSession, sf_dir: str) -> DataFrame:
    members = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return members.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op7_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files.checksums(token_files.token_files(table(spark, sf_dir, "documents")))


def op8_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = mixing.plan(table(spark, sf_dir, "documents").select("doc_id", "source", "text"))
    return rows.select(
        "doc_id", "size", "source_size", F.col("target").cast("double"), (F.col("size") * F.col("copies")).alias("taken")
    )


def op9_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return urls.judge(pages, urls.listed_urls(pages)).select("page_id", "host", "path", "rule", "verdict")


def op10_interpolated_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_model.score(table(spark, sf_dir, "documents"))


def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spellings.variants(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op12_partenum_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return partenum.jaccard_components(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return negatives.hard_negatives(table(spark, sf_dir, "embeddings"))


QUERIES = {f.__name__: f for f in (
    op1_quality_rules, op2_style_tree_text, op3_lexical_packing, op4_media_columns, op5_suffix_repeats, op6_simhash_pivots, op7_token_files, op8_mix_sources, op9_url_filter, op10_interpolated_lm,
    op11_spelling_variants, op12_partenum_jaccard, op13_hard_negatives,
)}

_BITS = " + ".join(f"CASE WHEN {rule} THEN {1 << i} ELSE 0 END" for i, rule in enumerate(quality.RULES.values()))
_SOLE = " ".join(f"WHEN {1 << i} THEN '{name}'" for i, name in enumerate(quality.RULES))

SQL = {
    "op1_quality_rules": rf"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT rid, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS w,
        list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l FROM d),
g AS (SELECT rid, i, array_to_string(w[i:i + 7], ' ') AS g
      FROM (SELECT rid, w, unnest(range(1, len(w) - 6)) AS i FROM w WHERE len(w) >= 8)),
r AS (SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, g) AS c FROM g) WHERE c > 1),
v AS (SELECT rid, sum(least(8, coalesce(nxt - i, 8))) AS n
      FROM (SELECT rid, i, lead(i) OVER (PARTITION BY rid ORDER BY i) AS nxt FROM r) GROUP BY rid),
m AS (SELECT doc_id, len(w) AS n_words, length(regexp_replace(t, '[\x20\x09-\x0D]+', '', 'g')) AS word_chars,
        length(regexp_replace(t, '[^#*$%&|<>]+', '', 'g')) AS n_symbols, len(l) AS n_lines,
        len(l) - len(list_distinct(l)) AS n_dup_lines, coalesce(n, 0) AS n_repeat_words,
        length(regexp_replace(t, '[^A-Z]+', '', 'g')) AS n_capitals,
        length(regexp_replace(t, '[^!]+', '', 'g')) AS n_exclamation
      FROM d JOIN w USING (rid) LEFT JOIN v USING (rid)),
k AS (SELECT *, {_BITS} AS fail_mask FROM m)
SELECT doc_id, n_words::BIGINT AS n_words, word_chars::BIGINT AS word_chars, n_symbols::BIGINT AS n_symbols,
  n_lines::BIGINT AS n_lines, n_dup_lines::BIGINT AS n_dup_lines, n_repeat_words::BIGINT AS n_repeat_words,
  n_capitals::BIGINT AS n_capitals, n_exclamation::BIGINT AS n_exclamation, fail_mask::BIGINT AS fail_mask,
  (fail_mask & {quality.mask(quality.BASE)}) <> 0 AS base_failed,
  (fail_mask & {quality.mask(quality.POLICIES[quality.CURRENT])}) = 0 AS kept,
  CASE fail_mask & {quality.mask(quality.POLICIES[quality.CURRENT])} {_SOLE} END AS sole_rule
FROM k""",
    "op11_spelling_variants": rf"""
WITH RECURSIVE tab(i, c, k) AS (SELECT i, i::BIGINT, 0 FROM range(256) t(i) UNION ALL SELECT i, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, k + 1 FROM tab WHERE k < 8),
crc AS (SELECT list(c ORDER BY i) AS t FROM tab WHERE k = 8),
r AS (SELECT coalesce(doc_id::VARCHAR, '') AS id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{spellings.LETTERS}')) AS run FROM documents),
d AS (SELECT id, run, count(*) AS times FROM r GROUP BY ALL),
b AS (SELECT *, flatten(list_transform(string_split(id || ':' || run, ''), lambda x: CASE WHEN unicode(x) < 128 THEN [unicode(x)::BIGINT]
    ELSE [(192 | (unicode(x) >> 6))::BIGINT, (128 | (unicode(x) & 63))::BIGINT] END)) AS bytes FROM d),
h AS (SELECT run, times, xor(list_reduce(list_prepend(4294967295::BIGINT, bytes), lambda c, x: xor(c >> 8, t[xor(c & 255, x) + 1])), 4294967295) AS h FROM b, crc),
w AS (SELECT CASE WHEN h % {spellings.DAMAGED} = 0 THEN substr(run, 1, (h % length(run))::INT) || substr(run, (h % length(run))::INT + 2) ELSE run END AS word, sum(times)::BIGINT AS n
  FROM h GROUP BY 1 HAVING length(word) >= {spellings.LEAST_LENGTH} AND sum(times) >= {spellings.LEAST_COUNT}),
cut AS (SELECT word, n, i, substr(word, 1, i::INT) || substr(word, i::INT + 2) AS part FROM (SELECT word, n, unnest(range(length(word))) AS i FROM w) UNION ALL SELECT word, n, -1, word FROM w),
near AS (SELECT DISTINCT a.word, a.n, b.word AS other, b.n AS other_n FROM cut a JOIN cut b ON a.part = b.part AND a.word <> b.word AND (a.i = b.i OR a.i = -1 OR b.i = -1)),
best AS (SELECT word, n, count(*) AS n_near, min((-other_n, other)) AS k FROM near GROUP BY ALL),
f AS (SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN -k[1] >= {spellings.FACTOR} * w.n THEN k[2] END AS form, CASE WHEN -k[1] >= {spellings.FACTOR} * w.n THEN -k[1] END AS form_n FROM w LEFT JOIN best USING (word)),
up(word, root, last) AS (SELECT word, word, form FROM f UNION ALL SELECT up.word, f.word, f.form FROM up JOIN f ON f.word = up.last)
SELECT f.word, form, root, n, n_near::BIGINT AS n_near, form_n FROM f JOIN up ON f.word = up.word AND up.last IS NULL""",
    "op12_partenum_jaccard": r"""
WITH RECURSIVE d AS (SELECT row_number() OVER () AS r, doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
g AS (SELECT DISTINCT r, array_to_string(w[i:i + 2], ' ') AS g FROM (SELECT r, w, unnest(range(1, greatest(1, len(w) - 2) + 1)) AS i FROM d WHERE len(w) > 0)),
z AS (SELECT r, count(*) AS n FROM g GROUP BY r),
m AS (SELECT a.r AS a, b.r AS b, count(*) AS met FROM g a JOIN g b ON a.g = b.g AND a.r <> b.r GROUP BY ALL),
e AS (SELECT a, b FROM m JOIN z x ON a = x.r JOIN z y ON b = y.r WHERE 100 * met >= 90 * (x.n + y.n - met)),
c(r, o) AS (SELECT r, r FROM d UNION SELECT c.r, e.b FROM c JOIN e ON c.o = e.a)
SELECT d.doc_id, coalesce(any_value(z.n), 0)::BIGINT AS n_shingles, min(other.doc_id) AS component_id FROM d LEFT JOIN z USING (r) JOIN c USING (r) JOIN d other ON c.o = other.r GROUP BY d.r, d.doc_id""",
    "op13_hard_negatives": """
WITH v AS (SELECT vec_id, (CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END)::BIGINT AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS v FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = len(embedding)),
s AS (SELECT a.vec_id AS anchor, a.label = b.label AS same, b.vec_id AS other, list_dot_product(a.v::DOUBLE[], b.v::DOUBLE[])::BIGINT AS score FROM v a, v b WHERE a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id),
p AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY anchor ORDER BY score DESC, other) AS k FROM s WHERE same) WHERE k <= 5),
n AS (SELECT p.anchor, p.other AS positive, p.score AS p, s.other AS negative, s.score AS n, row_number() OVER (PARTITION BY p.anchor, p.other ORDER BY s.score DESC, s.other) AS r
  FROM p JOIN s ON s.anchor = p.anchor AND NOT s.same AND 30 * p.score <= 100 * s.score AND 100 * s.score <= 90 * p.score)
SELECT anchor AS anchor_id, positive AS positive_id, r::INTEGER AS rank, negative AS negative_id, p AS positive_score, n AS negative_score FROM n WHERE r <= 10""",
    "op8_mix_sources": rf"""
WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size FROM documents),
p AS (SELECT source, sum(size)::BIGINT AS s FROM d GROUP BY source),
k AS (SELECT *, row_number() OVER (ORDER BY source ASC NULLS LAST) - 1 AS k FROM p),
w AS (SELECT source, s, k, [5, 2, 1][(k % 3 + 1)::INT] AS w FROM k),
c AS (SELECT *, (sum(s) OVER () - 3 * coalesce(sum(s) OVER (ORDER BY s / w, k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::DOUBLE
        / (sum(w) OVER (ORDER BY s / w, k ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))::DOUBLE AS level FROM w),
f AS (SELECT *, 3 * s <= level * w AS capped FROM c),
t AS (SELECT source, s, CASE WHEN capped THEN (3 * s)::DOUBLE
        ELSE (SELECT max(level) FROM f WHERE NOT capped) * w END AS target FROM f),
r AS (SELECT doc_id, size, s, target, CASE WHEN s > 0 THEN target / s ELSE 0 END AS rate,
        ('0x' || substr(md5('{mixing.SEED}:' || coalesce(doc_id::VARCHAR, '')), 1, 12))::BIGINT / 281474976710656.0::DOUBLE AS u
      FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size::BIGINT AS size, s AS source_size, target,
  (size * (floor(rate) + CASE WHEN u < rate - floor(rate) THEN 1 ELSE 0 END))::BIGINT AS taken FROM r""",
    "op9_url_filter": r"""
WITH a AS (SELECT page_id, coalesce(url, '') AS u FROM pages),
b AS (SELECT page_id, CASE WHEN strpos(u, '://') > 0 THEN substr(u, strpos(u, '://') + 3) ELSE '' END AS rest FROM a),
c AS (SELECT page_id, split_part(split_part(rest, '#', 1), '?', 1) AS bare FROM b),
d AS (SELECT page_id, translate(split_part(bare, '/', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
        substr(bare, length(split_part(bare, '/', 1)) + 1) AS path FROM c),
r(h, p, v) AS (VALUES ('com', '/', 'allow'), ('example.com', '/en/', 'block'), ('www.example.com', '/en/', 'allow'),
        ('net', '/es/', 'block'), ('net', '/fr/', 'block')),
m AS (SELECT *, CASE WHEN host <> '' THEN regexp_replace(host, '^(www|m)\.', '') || regexp_replace(path, '(/|\.html)$', '') END AS canon FROM d),
l AS (SELECT DISTINCT canon FROM m WHERE page_id % 100 = 0),
x AS (SELECT page_id, host, path, canon, max(CASE WHEN h IS NOT NULL THEN {'n': length(h || p), 'rule': h || p, 'verdict': v} END) AS best
      FROM m LEFT JOIN r ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p) GROUP BY ALL)
SELECT page_id, host, path, best.rule AS rule,
  coalesce(best.verdict, CASE WHEN canon IN (SELECT canon FROM l WHERE canon IS NOT NULL) THEN 'block' ELSE 'allow' END) AS verdict FROM x""",
}
