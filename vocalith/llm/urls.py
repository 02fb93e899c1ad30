"""URL filters: host and path rules, then a blocked Bloom filter of listed canonical URLs with an exact join behind.

The list's canonical URLs are hashed into blocks of four 64-bit words, one bit in each word.  A page whose block
misses a bit isn't listed; the others, a few false positives among them, meet the list in an exact equi-join.  The
filter is sent to all executors only if its size, which follows from the list's, is under a bound, and then nothing but
possible hits is shuffled; beyond it the pages that no rule settles join the blocks by number.

Cases: a null url, or one without "://", has empty host and path, no rule and no canonical form, and is allowed;
repeated pages are judged one by one; a list with repeated or null entries counts each once, null never; empty
tables give empty results; extra columns pass through, but for those whose names the result or a step takes.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vocalith.llm.common import lower_ascii, stored

#: (host, path, verdict)
RULES = (
    ("com", "/", "allow"),
    ("example.com", "/en/", "block"),
    ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"),
    ("net", "/fr/", "block"),
)
#: The list of this query: canonical URLs of the pages whose page_id this divides.
LISTED_EVERY = 100
BITS_PER_URL = 24
WORDS, WORD_BITS = 4, 64
BROADCAST_BYTES = 8 << 20


def host_and_path(url: Column) -> tuple[Column, Column]:
    u = F.coalesce(url, F.lit(""))
    at = F.instr(u, "://")
    rest = F.when(at > 0, F.expr("substring(coalesce(url, ''), instr(coalesce(url, ''), '://') + 3)")).otherwise("")
    bare = F.substring_index(F.substring_index(rest, "#", 1), "?", 1)
    cut = F.substring_index(bare, "/", 1)
    path = F.substr(bare, F.length(cut) + 1)
    return lower_ascii(cut), path


def canonical(host: Column, path: Column) -> Column:
    """Scheme, query and fragment dropped, host in lower case without www. or m., path without final slash or .html."""
    h = F.regexp_replace(host, r"^(www|m)\.", "")
    p = F.regexp_replace(path, r"(/|\.html)$", "")
    return F.when(host != "", F.concat(h, p))


def best_rule(host: Column, path: Column, rules=RULES) -> Column:
    """struct(len, rule, verdict) of the longest rule that fits; rules are a short list given as a parameter."""
    fits = [
        F.when(
            ((host == h) | F.endswith(host, F.lit(f".{h}"))) & F.startswith(path, F.lit(p)),
            F.struct(F.lit(len(h + p)).alias("len"), F.lit(h + p).alias("rule"), F.lit(v).alias("verdict")),
        )
        for h, p, v in rules
    ]
    return F.array_max(F.array(*fits))


def parsed(pages: DataFrame, rules=RULES) -> DataFrame:
    host, path = host_and_path(F.col("url"))
    own = [c for c in pages.columns if c not in ("host", "path", "canonical", "best_")]
    split = pages.select(*own, host.alias("host"), path.alias("path"))
    return split.select(
        *own, "host", "path",
        canonical(F.col("host"), F.col("path")).alias("canonical"),
        best_rule(F.col("host"), F.col("path"), rules).alias("best_"),
    )


def listed_urls(pages: DataFrame, every: int = LISTED_EVERY) -> DataFrame:
    """The list of this query, which neither host nor path gives away: it also blocks other spellings of its URLs."""
    return parsed(pages.filter(F.col("page_id") % every == 0).select("url")).select("canonical").distinct()


def _block(key: Column, blocks: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(blocks))


def _bits(key: Column) -> list[Column]:
    """One bit number for each word of a block, from a second hash."""
    h = F.xxhash64(key, F.lit("bits"))
    return [F.shiftrightunsigned(h, 12 * i).bitwiseAND(F.lit(WORD_BITS - 1)).cast("int") for i in range(WORDS)]


def bloom(listed: DataFrame, blocks: int) -> DataFrame:
    """block_, w0 .. w3: bits set by the list; combined before the shuffle."""
    bits = _bits(F.col("canonical"))
    one = F.lit(1).cast("long")
    return (
        listed.select(_block(F.col("canonical"), blocks).alias("block_"), *[F.call_function("shiftleft", one, b).alias(f"w{i}") for i, b in enumerate(bits)])
        .groupBy("block_")
        .agg(*[F.bit_or(f"w{i}").alias(f"w{i}") for i in range(WORDS)])
    )


def judge(pages: DataFrame, listed: DataFrame, rules=RULES, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """pages with host, path, rule, verdict and listed (null where a rule decided)."""
    clashing = {"host", "path", "rule", "verdict", "listed", "canonical", "best_", "block_", "maybe_", "hit_", *(f"w{i}" for i in range(WORDS))}
    own = [c for c in pages.columns if c not in clashing]
    rows = parsed(pages.select(*own), rules)
    listing = stored(listed.select("canonical").filter("canonical is not null").distinct(), "listed")
    blocks = max(1, -(-listing.count() * BITS_PER_URL // (WORDS * WORD_BITS)))
    filter_ = bloom(listing, blocks)
    open_ = F.col("best_").isNull() & F.col("canonical").isNotNull()
    set_ = reduce(
        lambda a, b: a & b,
        [F.getbit(F.coalesce(F.col(f"w{i}"), F.lit(0).cast("long")), b) == 1 for i, b in enumerate(_bits(F.col("canonical")))],
    )
    block = F.when(open_, _block(F.col("canonical"), blocks))
    if blocks * (WORDS + 1) * 8 <= broadcast_bytes:
        probed, settled = rows.withColumn("block_", block).join(F.broadcast(filter_), "block_", "left"), None
    else:  # only pages that no rule settles meet the blocks
        probed, settled = rows.filter(open_).withColumn("block_", block).join(filter_, "block_", "left"), rows.filter(~open_)
    probed = probed.withColumn("maybe_", F.coalesce(open_ & set_, F.lit(False)))
    plain = [*own, "host", "path", "canonical", "best_"]
    # what the filter rules out stays where it is, and only possible hits meet the list
    missed = probed.filter(~F.col("maybe_")).select(*plain)
    possible = probed.filter("maybe_").select(*plain).join(listing.withColumn("hit_", F.lit(True)), "canonical", "left").select(*plain, "hit_")
    rest = missed if settled is None else missed.unionByName(settled.select(*plain))
    exact = rest.withColumn("hit_", F.lit(None).cast("boolean")).unionByName(possible)
    hit = F.coalesce("hit_", F.lit(False))
    return exact.select(
        *own, "host", "path",
        F.col("best_.rule").alias("rule"),
        F.coalesce(F.col("best_.verdict"), F.when(hit, "block").otherwise("allow")).alias("verdict"),
        F.when(F.col("best_").isNull(), hit).alias("listed"),
    )
