"""Mixing sources to target weights.

Words are summed for each source, targets follow from weights and a cap, and a document of a source with repetition
rate r is emitted floor(r) times, plus once more if a hash of its id, seeded, falls under r's fraction.

Targets: sources in code point order (null last) weigh 5, 2, 1, repeating, and share all words; a source's target
stops at 3 times its words, and what it can't take is shared again by weight until no target is above its cap.
Sorted by cap / weight, that is one level: a source is capped if the level reached without the sources before it
passes its own ratio.

Cases: a null text has size 0 and is emitted by its rate like any other; a null source is a source of its own; a
source without words has target and rate 0; repeated rows are drawn alike, each on its own; an empty table gives an
empty result; extra columns pass through emit().
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vocalith.llm.common import stored, words

WEIGHTS = (5, 2, 1)
CAP = 3
SEED = "mix-1"
#: Up to so many sources, their rates are sent to all executors; texts then never move.
BROADCAST_SOURCES = 100_000


def source_targets(sizes: DataFrame, weights=WEIGHTS, cap: int = CAP) -> DataFrame:
    """source, source_size, target, rate. Only the sources, already summed, pass through the ordered windows."""
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    ranked = per.withColumn("rank_", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1)
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), (F.col("rank_") % len(weights) + 1).cast("int"))
    weighted = ranked.withColumn("weight_", weight.cast("long"))
    order = Window.orderBy((F.col("source_size") / F.col("weight_")).asc(), F.col("rank_").asc())
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    rest = order.rowsBetween(0, Window.unboundedFollowing)
    total = F.sum("source_size").over(Window.partitionBy())
    level = (total - cap * F.coalesce(F.sum("source_size").over(before), F.lit(0))) / F.sum("weight_").over(rest)
    levels = weighted.withColumn("level_", level).withColumn(
        "capped_", cap * F.col("source_size") <= F.col("level_") * F.col("weight_")
    )
    reached = F.max(F.when(~F.col("capped_"), F.col("level_"))).over(Window.partitionBy())
    target = F.when(F.col("capped_"), (cap * F.col("source_size")).cast("double")).otherwise(
        reached * F.col("weight_")
    )
    return levels.withColumn("target", target).select(
        "source",
        "source_size",
        "target",
        F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0).alias("rate_"),
    )


def plan(docs: DataFrame, weights=WEIGHTS, cap: int = CAP, seed: str = SEED) -> DataFrame:
    """docs with size, source_size, target and copies. Reads the texts twice and shuffles only their sizes."""
    own = [c for c in docs.columns if c not in ("size", "source_size", "target", "copies", "rate_")]
    sized = docs.select(*own, F.size(words(F.col("text"))).cast("long").alias("size"))
    targets = stored(source_targets(sized.select("source", "size"), weights, cap).withColumnRenamed("source", "source_"), "targets")
    if targets.count() <= BROADCAST_SOURCES:
        targets = F.broadcast(targets)
    joined = sized.join(targets, F.col("source").eqNullSafe(F.col("source_")), "left").drop("source_")
    return joined.withColumn("copies", copies(F.col("rate_"), seed)).drop("rate_")


def copies(rate, seed: str = SEED):
    """floor(rate) plus a Bernoulli draw of the fraction, from 48 bits of a seeded hash of doc_id."""
    drawn = F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))), 1, 12), 16, 10)
    u = drawn.cast("double") / F.lit(float(1 << 48))
    return (F.floor(rate) + (u < rate - F.floor(rate)).cast("long")).cast("long")


def emit(planned: DataFrame, columns) -> DataFrame:
    """Each document as often as planned."""
    return planned.filter("copies > 0").select(
        *columns, F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))).alias("copy_")
    ).drop("copy_")


def mix(docs: DataFrame, weights=WEIGHTS, cap: int = CAP, seed: str = SEED) -> DataFrame:
    """The mixture: the rows of docs, repeated or left out. Only (doc, source, size) meet the rates."""
    own = docs.columns
    wrapped = docs.select(F.struct(*[F.col(f"`{c}`") for c in own]).alias("row_"), "doc_id", "source", "text")
    return emit(plan(wrapped, weights, cap, seed), ["row_"]).select("row_.*")
