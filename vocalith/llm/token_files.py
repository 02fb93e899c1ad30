"""Token ids in Parquet list columns, in ascending doc_id order.

Texts are encoded where they are read; ids, packed, are dealt out by ranges of doc_id and sorted, and each task writes
one file: doc_id, the ids as a list, their number, and the ids written before it in that file.  Ids are
dictionary-encoded, integers that ascend are delta-encoded, row groups and pages have set sizes, and the writer's page
indexes let a reader skip to a range of documents or read the counts alone.  Reading back, a document starts where the
files before its own end.

Cases: a null or empty text has only its end id; null ids come first; repeated rows are written one after another;
an empty table gives files without rows; of extra columns none is written but those named in `extra`.
"""

from __future__ import annotations

import zlib

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vocalith.llm.common import fresh_path, total_bytes, utf8
from vocalith.llm.tokenize import WORD_BPE, Vocabulary, tokenizer

END_ID = 1
RANGE_BYTES = 24 << 20
#: Files there are at most (16 bytes for each are sent to all executors); beyond, they grow.
MOST_FILES = 1 << 16
BLOCK = 1 << 10
#: Stands for a null doc_id, which comes first.
NO_ID = -(1 << 63)
WRITER = {
    "compression": "zstd",
    "parquet.writer.version": "PARQUET_2_0",
    "parquet.enable.dictionary": "false",
    "parquet.enable.dictionary#ids.list.element": "true",
    "parquet.block.size": str(32 << 20),
    "parquet.page.size": str(256 << 10),
    "parquet.page.row.count.limit": "2000",
}
SCHEMA = "doc_id long, ids array<int>, n_tokens long, before long, file int"


def encoded(docs: DataFrame, vocabulary: Vocabulary = WORD_BPE, end_id: int = END_ID, bounds=()) -> DataFrame:
    """doc_id, ids (16-bit), file: documents up to the first bound are the first file's, and so on.

    An id that is several bounds, one of a hot group, belongs to the files on both sides; its rows go to these in turn.
    """

    def encode(batches):
        import numpy as np
        import pyarrow as pa

        encoder, end, limits = tokenizer(vocabulary), np.array([end_id], np.uint16).tobytes(), np.array(bounds, np.int64)
        for whole in batches:
            for at in range(0, len(whole), 2048):
                batch = whole.slice(at, 2048)
                ids = pa.array([x.tobytes() + end for x in encoder.ids_of(utf8(batch, "text"))], pa.binary())
                keys = batch.column("doc_id").fill_null(NO_ID).to_numpy(zero_copy_only=False)
                low, high = np.searchsorted(limits, keys, "left"), np.searchsorted(limits, keys, "right")
                file = low + np.arange(len(keys)) % (high - low + 1)
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), ids, pa.array(file.astype(np.int32))], ["doc_id", "ids", "file"])

    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return own.mapInArrow(encode, "doc_id long, ids binary, file int")


def file_bounds(docs: DataFrame) -> list[int]:
    """The largest doc_id of each file but the last: quantiles of doc_id, as many as the texts' bytes need."""
    _, size = total_bytes(docs, "text")
    files = max(1, min(MOST_FILES, -(-size // RANGE_BYTES)))
    if files == 1:
        return []
    key = F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID))
    return sorted(docs.agg(F.percentile_approx(key, [i / files for i in range(1, files)], 20 * files).alias("q")).first().q or [])


def write(docs: DataFrame, path: str, vocabulary: Vocabulary = WORD_BPE, end_id: int = END_ID) -> None:
    def lists(batches):
        import numpy as np
        import pyarrow as pa

        before: dict[int, int] = {}
        for whole in batches:
            for start in range(0, len(whole), 2048):
                batch = whole.slice(start, 2048)
                n = pc_lengths(batch.column("ids")) // 2
                flat = np.frombuffer(b"".join(batch.column("ids").to_pylist()), np.uint16)
                ends = np.cumsum(n)
                file = int(batch.column("file")[0].as_py()) if len(batch) else 0
                at = before.get(file, 0)
                ids = pa.ListArray.from_arrays(pa.array(np.append(0, ends).astype(np.int32)), pa.array(flat.astype(np.int32)))
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id"), ids, pa.array(n), pa.array(at + ends - n), batch.column("file")],
                    ["doc_id", "ids", "n_tokens", "before", "file"],
                )
                before[file] = at + int(n.sum())

    bounds = file_bounds(docs)
    # one partition, and so one task and one file, for each range
    dealt = encoded(docs, vocabulary, end_id, bounds).repartitionById(len(bounds) + 1, F.col("file"))
    dealt.sortWithinPartitions(F.col("doc_id").asc_nulls_first()).mapInArrow(lists, SCHEMA).write.options(**WRITER).parquet(path)


def pc_lengths(column):
    import numpy as np
    import pyarrow.compute as pc

    return pc.binary_length(column).to_numpy(zero_copy_only=False).astype(np.int64)


def read(spark, path: str, first: int | None = None, last: int | None = None) -> DataFrame:
    """doc_id, ids, n_tokens, start: start is global. Only the counts are read to place the files.

    first and last select a range of doc_id, which reaches the scan: row groups and pages outside it aren't read.
    """
    rows = spark.read.schema(SCHEMA).parquet(path)
    totals = rows.groupBy("file").agg(F.sum("n_tokens").alias("n"))
    # prefix sums by blocks of files: no window has more rows than a block, or there are blocks
    block = F.floor(F.col("file") / BLOCK)
    earlier = Window.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    inside = Window.partitionBy("block").orderBy("file").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.withColumn("block", block)
    blocks = totals.groupBy("block").agg(F.sum("n").alias("m")).select("block", F.coalesce(F.sum("m").over(earlier), F.lit(0)).alias("above"))
    places = totals.join(F.broadcast(blocks), "block").select("file", (F.col("above") + F.coalesce(F.sum("n").over(inside), F.lit(0))).alias("at"))
    wanted = rows
    if first is not None:
        wanted = wanted.filter(F.col("doc_id") >= first)
    if last is not None:
        wanted = wanted.filter(F.col("doc_id") <= last)
    # a row for each of at most MOST_FILES files
    return wanted.join(F.broadcast(places), "file").select("doc_id", "ids", "n_tokens", (F.col("at") + F.col("before")).alias("start"))


def checksums(rows: DataFrame) -> DataFrame:
    """ids_crc32: of the ids as little-endian unsigned 32-bit integers."""

    def sums(batches):
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            lists = batch.column("ids")
            flat = np.ascontiguousarray(lists.flatten().to_numpy(zero_copy_only=False), "<u4").tobytes()
            at = np.concatenate([[0], np.cumsum(lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))]) * 4
            view = memoryview(flat)
            crc = [zlib.crc32(view[a:b]) for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("start"), batch.column("n_tokens"), pa.array(crc, pa.int64())],
                ["doc_id", "start", "n_tokens", "ids_crc32"],
            )

    return rows.mapInArrow(sums, "doc_id long, start long, n_tokens long, ids_crc32 long")


def token_files(docs: DataFrame, path: str | None = None) -> DataFrame:
    """Writes the files and returns the rows read from them."""
    spark = docs.sparkSession
    write(docs, path := path or fresh_path(spark, "tokens"))
    return read(spark, path)
