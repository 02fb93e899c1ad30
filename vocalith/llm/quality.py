"""Quality rules as a bitmask ledger.

Every rule is evaluated once for each document; the ledger stores its measurements and one 64-bit mask of the
rules that failed.  A policy is a versioned mask of the rules that reject, so a policy change, or the ablation of
any rule, reads the ledger's integers and never the texts.

Cases: a null or blank text has no words, fails MIN_WORDS and is rejected by every policy; ties and repeated rows
are judged one by one; an empty table gives an empty ledger; extra columns pass through, and a column of the input
whose name a measurement takes is replaced.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vocalith.llm.common import words

#: Bits of the mask, in order. The first two are the base rules. Conditions are SQL over the measurements.
RULES = {
    "min_words": "n_words < 20",
    "repeated_windows": "100 * n_repeat_words > 30 * n_words",
    "symbols": "100 * n_symbols > 5 * word_chars",
    "duplicate_lines": "100 * n_dup_lines > 40 * n_lines",
    "capitals": "100 * n_capitals > 30 * word_chars",
    "exclamation": "n_exclamation > n_words",
    "short_words": "word_chars < 2 * n_words",
    "long_words": "word_chars > 20 * n_words",
}
BASE = ("min_words", "repeated_windows")
#: Versions of the policy: the rules that reject.
POLICIES = {
    "base": BASE,
    "v1": (*BASE, "symbols", "duplicate_lines"),
    "v2": tuple(RULES),
}
CURRENT = "v2"


def mask(rules) -> int:
    return sum(1 << i for i, name in enumerate(RULES) if name in rules)


def _repeat_words(w):
    """Words inside an 8-word window that occurs at least twice in the text.

    Windows are compared by a 64-bit hash, built by doubling: 2 words, 4 words, 8 words.  Only where a hash repeats are
    the windows sorted by (hash, position): one is repeated if a neighbour has its hash, and the words covered are the
    gaps between repeated positions, at most 8 each.
    """
    # array literals bind an intermediate result once: transform(array(x), v -> ...)[0]
    def let(value, body):
        return F.transform(F.array(value), body)[0]

    def doubled(h, step):
        return let(h, lambda v: F.zip_with(
            F.slice(v, 1, F.size(v) - step), F.slice(v, step + 1, F.size(v)), lambda a, b: F.xxhash64(a, b)
        ))

    def repeated(h):
        pairs = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("p"))))
        return let(pairs, lambda s: F.array_sort(F.array_compact(F.transform(s, lambda x, i: F.when(
            (F.get(s, i - 1)["h"] == x["h"]) | (F.get(s, i + 1)["h"] == x["h"]), x["p"]
        )))))

    def covered(p):
        steps = F.transform(p, lambda x, i: F.least(F.lit(8), F.coalesce(F.get(p, i + 1) - x, F.lit(8))))
        return F.aggregate(steps, F.lit(0), lambda a, x: a + x)

    windows = doubled(doubled(doubled(F.transform(w, lambda x: F.xxhash64(x)), 1), 2), 4)
    found = let(windows, lambda h: F.when(F.size(F.array_distinct(h)) < F.size(h), let(repeated(h), covered)).otherwise(0))
    return F.when(F.size(w) >= 9, found).otherwise(0).cast("long")


def ledger(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with the measurements and fail_mask; JVM expressions only, no shuffle."""
    keep = [c for c in docs.columns if c not in MEASURES and c not in ("fail_mask", "words_", "lines_")]
    t = F.coalesce(F.col(text), F.lit(""))
    of = lambda chars: F.length(F.regexp_replace(t, f"[^{chars}]+", "")).cast("long")
    split = docs.select(
        *keep,
        words(F.col(text)).alias("words_"),
        # a line counts if it has a word
        F.filter(
            F.split(t, "\n", -1), lambda x: F.rlike(x, F.lit("[^ \\t-\\r]"))
        ).alias("lines_"),
    )
    measured = split.select(
        *keep,
        F.size("words_").cast("long").alias("n_words"),
        (F.length(t) - of(" \\t-\\r")).alias("word_chars"),
        of("#*$%&|<>").alias("n_symbols"),
        F.size("lines_").cast("long").alias("n_lines"),
        (F.size("lines_") - F.size(F.array_distinct("lines_"))).cast("long").alias("n_dup_lines"),
        _repeat_words(F.col("words_")).alias("n_repeat_words"),
        of("A-Z").alias("n_capitals"),
        of("!").alias("n_exclamation"),
    )
    bits = [F.when(F.expr(rule), F.lit(1 << i)).otherwise(F.lit(0)) for i, rule in enumerate(RULES.values())]
    total = bits[0]
    for bit in bits[1:]:
        total = total.bitwiseOR(bit)
    return measured.withColumn("fail_mask", total.cast("long"))


MEASURES = (
    "n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words", "n_capitals", "n_exclamation",
)


def apply_policy(rows: DataFrame, version: str = CURRENT) -> DataFrame:
    """kept: no rule of the policy failed. Reads fail_mask only."""
    return rows.withColumn("kept", F.col("fail_mask").bitwiseAND(F.lit(mask(POLICIES[version]))) == 0)


def sole_rules(rows: DataFrame, version: str = CURRENT) -> DataFrame:
    """sole_rule: the rule without which the policy would keep the document; null if none or several reject it."""
    failed = F.col("fail_mask").bitwiseAND(F.lit(mask(POLICIES[version])))
    return rows.withColumn("sole_rule", F.coalesce(*[F.when(failed == (1 << i), name) for i, name in enumerate(RULES)]))


def ablation(rows: DataFrame, version: str = CURRENT) -> DataFrame:
    """For each rule of a policy: documents that fail it, and those that only it rejects. One aggregate, no texts."""
    active = mask(POLICIES[version])
    failed = F.col("fail_mask").bitwiseAND(F.lit(active))
    sums = rows.agg(
        F.count(F.lit(1)).alias("n"),
        *[F.sum(failed.bitwiseAND(F.lit(1 << i)).cast("boolean").cast("long")).alias(f"f{i}") for i in range(len(RULES))],
        *[F.sum((failed == (1 << i)).cast("long")).alias(f"o{i}") for i in range(len(RULES))],
    )
    pairs = [
        F.struct(
            F.lit(name).alias("rule"),
            F.coalesce(F.col(f"f{i}"), F.lit(0)).alias("n_failed"),
            F.coalesce(F.col(f"o{i}"), F.lit(0)).alias("n_only_this"),
        )
        for i, name in enumerate(RULES)
        if name in POLICIES[version]
    ]
    return sums.select("n", F.explode(F.array(*pairs)).alias("r")).select("r.*", F.col("n").alias("n_docs"))


def quality_filter(docs: DataFrame, version: str = CURRENT) -> DataFrame:
    """The documents that a policy keeps, with their own columns."""
    marked = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row_"), F.col("text").alias("text"))
    kept = apply_policy(ledger(marked), version).filter("kept")
    return kept.select("row_.*")
