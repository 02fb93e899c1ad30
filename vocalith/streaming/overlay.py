"""Deltas as a stream: each micro-batch of versioned rows is merged into the state of its components.

The state is a keyed one in Spark's state store, dealt by component: a batch touches only its own keys and writes a change log of
them, so what is written follows the batch and not the state, and Spark deletes old versions itself.  The changed states of
each batch go to a folder of their own for whoever follows the changes; the whole state is read from the store.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from vocalith.operators.state import last_of, unpacked

#: Keeps state on executors' disks, and checkpoints change logs in place of whole versions.
STORE = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
}


def apply_deltas(rows: DataFrame, changes: str, keys: Sequence[str], order: Sequence[str], checkpoint: str, once: bool = True) -> StreamingQuery:
    """Starts the stream: latest states by `order` are kept under `checkpoint`, and the states that batch n changed go to changes/n.

    A batch that is run again, after a restart too, merges the same rows into the same version and writes its changes again.
    """
    spark = rows.sparkSession
    merged = last_of(rows, list(keys), [F.col(c) for c in order])

    def write(batch: DataFrame, number: int) -> None:
        unpacked(batch, rows.columns, keys).write.mode("overwrite").parquet(f"{changes}/{number}")

    before = {k: spark.conf.get(k, None) for k in STORE}
    for k, v in STORE.items():
        spark.conf.set(k, v)
    try:
        writer = merged.writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", checkpoint)
        return (writer.trigger(availableNow=True) if once else writer).start()
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def states(spark: SparkSession, checkpoint: str, columns: Sequence[str], keys: Sequence[str]) -> DataFrame:
    """The states after the last batch that was committed, read from the store: one row for each component."""
    kept = spark.read.format("statestore").load(checkpoint)
    return unpacked(kept.select("key.*", F.col("value.valueWithExtremumOrdering").alias("last_")), columns, keys)
