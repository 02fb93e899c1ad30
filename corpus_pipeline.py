"""A training corpus from documents: five stages, each written and read again by the next.

Quality rules reject documents; of near copies (met by fingerprints with pivots or by minhash bands, 5-word shingles alike by 0.8)
the one with the smallest id stays; passages that earlier documents have are cut; sources are mixed to their target weights; and
the result is packed into sequences.  All stages but the
last return the columns of documents.

Cases: a null or blank text is rejected by the first stage; the others treat a null text as empty, and only the first of
all empty texts stays.  A null doc_id is larger than any other: its row stays if none of its copies has an id, and it
loses the passages that others have.  Ties go to the smaller id, repeated rows are copies of each other.  Sources may be
null.  Texts of any length are read whole.  An empty table gives empty tables, and extra columns, whatever their names,
pass through all stages but the last.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from vocalith.llm import mixing, near_copies, packing, quality, repeats
from vocalith.llm.common import stored, table


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.quality_filter(docs)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return near_copies.deduplicate(docs)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return repeats.without_repeats(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mix(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_rules", keep_quality),
    ("near_duplicates", drop_near_duplicates),
    ("repeated_passages", cut_repeats),
    ("source_mixture", mix_sources),
    ("lexical_packing", pack_sequences),
]

#: SQL can express neither fingerprints nor token ids: tests hold the stages against brute force instead.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = stored(docs, name)
    return docs
