"""Documents in batches that ask questions of buckets.

Some operators need, for each of many keys of a document, a fact about all documents with that key.  A row for each
key would be shuffled at many times the size of the texts.  Here documents are dealt to batches of bounded bytes; a
batch asks once for each distinct key, as packed arrays, one row for each bucket of keys; the bucket answers in the
order of the question.  A key that a third of all documents have is one entry for each batch.  The batches themselves
are compressed blobs, one exchange that all passes of a query read.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vocalith.llm.common import total_bytes

#: Texts of a batch, and of those that a bucket's keys come from. Both grow with the root of the input, so that the
#: packed arrays between them don't shrink to a few keys, up to a batch whose arrays fit in half a gigabyte. From there on
#: (some 40 GB) a row between a batch and a bucket holds fewer keys; there are never more rows than keys.
BATCH_BYTES, LARGEST_BATCH = 5 << 20, 32 << 20
BUCKET_BYTES = 1 << 20
#: Bytes of text for each task that buckets are dealt to.
TASK_BYTES = 6 << 20
ROOT = 170


def scaled(size: int) -> float:
    """How many times the least size batches and buckets have, for so many bytes of text."""
    return max(1.0, min(LARGEST_BATCH, ROOT * size**0.5) / BATCH_BYTES)


def batched(docs: DataFrame, size: int, batch_bytes: int = BATCH_BYTES) -> DataFrame:
    """(batch, blob): rows of docs by a hash of doc_id and text, as compressed Arrow streams. size: bytes of all texts.

    Equal rows that meet in a task go to one batch after another, so neither an id nor a group of copies fills a batch.
    """
    count = max(1, -(-size // int(batch_bytes * scaled(size))))

    def blobs(parts):
        import pyarrow as pa

        for part in parts:
            rows = pa.table(part)
            h = rows.column("batch_").to_numpy()
            rows = rows.drop_columns(["batch_"])
            order = np.argsort(h, kind="stable")
            new = np.append(True, h[order][1:] != h[order][:-1])[: len(h)]
            nth = np.empty(len(h), np.int64)
            nth[order] = np.arange(len(h)) - np.maximum.accumulate(np.where(new, np.arange(len(h)), 0))
            batch = ((h % count + nth) % count).astype(np.int32)
            order = np.argsort(batch, kind="stable")
            edges = np.flatnonzero(np.diff(batch[order])) + 1
            for at in np.split(order, edges) if len(order) else []:
                yield pa.RecordBatch.from_arrays(
                    [pa.array([batch[at[0]]], pa.int32()), pa.array([pack_table(rows.take(pa.array(at)))], pa.binary())],
                    ["batch", "blob"],
                )

    keyed = docs.withColumn("batch_", F.xxhash64("doc_id", "text"))
    return keyed.mapInArrow(blobs, "batch int, blob binary").repartition(count, "batch")


def pack_table(rows) -> bytes:
    import pyarrow as pa

    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, rows.schema, options=pa.ipc.IpcWriteOptions(compression=pa.Codec("zstd", 3))) as w:
        w.write_table(rows.combine_chunks())
    return sink.getvalue().to_pybytes()


def unpack(group):
    """A batch's rows in order of doc_id (null last), then text, so that every pass sees them alike."""
    import pyarrow as pa

    rows = pa.concat_tables([pa.ipc.open_stream(b).read_all() for b in group.column("blob").to_pylist()])
    return rows.sort_by([("doc_id", "ascending"), ("text", "ascending")])


def texts_of(rows) -> list[bytes]:
    import pyarrow as pa

    return [x or b"" for x in rows.column("text").cast(pa.binary()).to_pylist()]


def ids_of(rows) -> np.ndarray:
    """doc_id; null counts as larger than all."""
    return rows.column("doc_id").fill_null(np.iinfo(np.int64).max).to_numpy().astype(np.int64)


def bucket_bits(size: int, bucket_bytes: int = BUCKET_BYTES) -> int:
    """Buckets are named by so many leading bits of a 64-bit key."""
    return max(1, (max(1, size // int(bucket_bytes * scaled(size))) - 1).bit_length())


def by_bucket(keys: np.ndarray, bits: int):
    """(bucket, slice) of sorted unsigned keys, for the buckets that have any."""
    number = (keys >> np.uint64(64 - bits)).astype(np.int64)
    edges = [0, *(np.flatnonzero(np.diff(number)) + 1).tolist(), len(keys)]
    return [(int(number[a]), slice(a, b)) for a, b in zip(edges[:-1], edges[1:], strict=True) if a < b]


def by_buckets(rows: DataFrame, size: int):
    """rows grouped by bucket, dealt to as many tasks as the texts' bytes need."""
    return rows.repartition(max(1, -(-size // TASK_BYTES)), "bucket").groupBy("bucket")


def pack_keys(keys: np.ndarray, bits: int) -> bytes:
    """Sorted keys of one bucket: whole, or without the leading byte if the bucket's number has it."""
    width = 7 if bits >= 8 else 8
    return keys.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].tobytes()


def unpack_keys(data: bytes, bits: int) -> np.ndarray:
    """The leading byte, if left out, is zero: all keys of a bucket have the same."""
    width = 7 if bits >= 8 else 8
    out = np.zeros((len(data) // width, 8), np.uint8)
    out[:, :width] = np.frombuffer(data, np.uint8).reshape(-1, width)
    return out.reshape(-1).view("<u8")


def size_of(docs: DataFrame) -> int:
    return total_bytes(docs, "text")[1]
