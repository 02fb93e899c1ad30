"""Lexical retrieval packing.

Documents are encoded once, ordered by content, and cut into shards of bounded size.  A shard builds a BM25 inverted index of its documents'
token ids.  The document at the start of a window is the query; its nearest unused neighbours fill the window, the
last one is cut where the window ends and its rest starts, and queries, the next.  So every sequence of a shard is
full but the tail, which is cut into powers of two and needs no padding either.

Order of content: first the nearest of a few centroids (of term vectors, fitted on a bounded sample of documents), then
the smallest hash of the document's five-token shingles, which near copies share.  Shards are equal stretches of that
order, in tokens.  A group of copies above an eighth of a shard is spread over the stretch of its centroid.

Cases: a null or empty text is its end id alone; repeated rows are packed each on its own; ties go to the lower doc_id,
then to the order of rows; null ids are packed like others; an empty table gives no pieces; extra columns are not read.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass
from itertools import chain

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vocalith.llm.common import stored, utf8
from vocalith.llm.tokenize import BYTE_BPE, Vocabulary, tokenizer

LENGTH = 1024
END_ID = 0
#: Tokens of a shard; BM25's own two parameters; terms in more than this share of a shard's documents
#: rank only those that share no rarer one.
SHARD_TOKENS = 10 << 20
K1, B = 1.2, 0.75
COMMON = 0.1
#: Documents whose vectors the centroids are fitted on, their number, and the vectors' width.
SAMPLE, CENTROIDS, WIDTH = 2000, 8, 256
ROUNDS = 12
SHINGLE = 5
BROADCAST_ROWS = 1 << 17
SEED = 42
IDS = 1 << 16
#: Rows whose texts are encoded together, if their bytes allow it.
SLICE = 1024
#: Postings that are weighed at a time.
STRETCH = 1 << 17
PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


class Postings:
    """Some terms of one shard: documents and BM25 weights in order of term."""

    def __init__(self, term, tf, doc, idf, length):
        import numpy as np

        self.size, mean = len(length), length.mean()
        self.terms = np.split(term, np.cumsum(np.bincount(doc, minlength=self.size))[:-1])
        order = np.argsort(term, kind="stable")
        self.doc, self.weight = np.empty(len(term), np.int32), np.empty(len(term))
        for at in range(0, len(order), STRETCH):  # a few stretches of 8-byte numbers, and not of all postings
            own = order[at : at + STRETCH]
            d, n = doc[own], tf[own]
            self.doc[at : at + STRETCH] = d
            self.weight[at : at + STRETCH] = idf[term[own]] * n * (K1 + 1) / (n + K1 * (1 - B + B * length[d] / mean))
        self.first = np.concatenate([[0], np.cumsum(np.bincount(term, minlength=IDS))])

    def scores(self, i: int):
        import numpy as np

        terms = self.terms[i].astype(np.int64)
        lo, hi = self.first[terms], self.first[terms + 1]
        n = hi - lo
        at = np.repeat(lo - np.cumsum(n) + n, n) + np.arange(n.sum())
        return np.bincount(self.doc[at], self.weight[at], self.size)


class Index:
    """The terms of one shard that tell documents apart, and all others for documents that share no such term."""

    def __init__(self, docs: list):
        import numpy as np

        terms, counts = [], []
        for d in docs:
            t, c = np.unique(d, return_counts=True)
            terms.append(t)
            counts.append(c.astype(np.int32))
        n = np.array([len(t) for t in terms])
        term, tf = np.concatenate(terms), np.concatenate(counts)
        del terms, counts
        doc, length = np.repeat(np.arange(len(docs), dtype=np.int32), n), np.array([len(d) for d in docs])
        df = np.bincount(term, minlength=IDS)
        odds = (len(docs) - df + 0.5) / (df + 0.5)
        rare = (odds > 1) & (df <= max(2, COMMON * len(docs)))
        keep = rare[term]
        self.rare = Postings(term[keep], tf[keep], doc[keep], np.log(np.maximum(odds, 1)), length)
        keep = ~keep
        term, tf, doc = term[keep], tf[keep], doc[keep]
        self.common = Postings(term, tf, doc, np.log1p(odds), length)

    def neighbours(self, i: int, used):
        """Unused documents that share a rare term with document i, best first. used: a mask that may grow meanwhile."""
        return self._best(self.rare, i, used)

    def others(self, i: int, used):
        """Unused documents by the terms that neighbours leaves out, best first."""
        return self._best(self.common, i, used)

    def _best(self, postings: Postings, i: int, used):
        score = postings.scores(i)
        score[used] = score[i] = 0
        # a window takes two or three: to look for the best again is cheaper than to sort
        while score[best := int(score.argmax())] > 0:
            yield best
            score[best] = 0


def pack_shard(docs: list, length: int = LENGTH) -> list[tuple[int, int, int, int, int]]:
    """(document, start, length, sequence, offset) of every piece, for documents given as arrays of ids."""
    import numpy as np

    if not docs:
        return []
    index, used, pieces = Index(docs), np.zeros(len(docs), bool), []
    sequence, room, candidates, behind = 0, length, iter(()), 0
    current = None
    while True:
        if current is None:
            current = next((c for c in candidates if not used[c]), None)
            if current is None:
                while behind < len(docs) and used[behind]:
                    behind += 1
                if behind == len(docs):
                    break
                current = behind
        used[current] = True
        at = 0
        while at < len(docs[current]):
            take = min(room, len(docs[current]) - at)
            pieces.append((current, at, take, sequence, length - room))
            fresh = room == length
            at, room = at + take, room - take
            if room == 0:
                sequence, room = sequence + 1, length
            elif fresh:
                candidates = chain(index.neighbours(current, used), index.others(current, used))
        current = None
    return _powers(pieces, sequence, length - room)


def _powers(pieces: list, tail: int, size: int) -> list:
    """Cuts the last, short sequence at powers of two, the largest first."""
    out = [p for p in pieces if p[3] != tail]
    cuts = [(size >> b) << b for b in reversed(range(size.bit_length())) if size >> b & 1]
    for doc, start, length, _, offset in (p for p in pieces if p[3] == tail):
        while length:
            k = next(i for i, c in enumerate(cuts) if offset < c)
            take, begin = min(length, cuts[k] - offset), cuts[k - 1] if k else 0
            out.append((doc, start, take, tail + k, offset - begin))
            start, length, offset = start + take, length - take, offset + take
    return out


@dataclass
class Places:
    """Term weights and centroids; the centroids are in an order in which each is near the one before."""

    idf: object
    centroids: object

    def vector(self, terms, tf):
        import numpy as np

        weight = self.idf[terms] * np.log1p(tf)
        slot = terms.astype(np.uint32) * np.uint32(2654435761)
        return np.bincount(slot >> np.uint32(24), np.where(slot & np.uint32(1 << 20), weight, -weight), WIDTH)

    def nearest(self, ids) -> int:
        import numpy as np

        return int((self.centroids @ self.vector(*np.unique(ids, return_counts=True))).argmax()) if len(self.centroids) else 0


def least_shingle(ids) -> int:
    """Signed; the smallest hash of the shingles of five tokens, or of the whole if it has fewer."""
    import numpy as np

    width = min(SHINGLE, len(ids))
    h = np.zeros(len(ids) - width + 1, np.uint64)
    for i in range(width):
        h = (h + ids[i : len(ids) - width + 1 + i]) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
    return int((h * np.uint64(0xC2B2AE3D27D4EB4F)).min().view(np.int64))


def fit(sample: list) -> Places:
    """Spherical k-means, from starting points that are far from one another. sample: (terms, counts) of documents."""
    import numpy as np

    df = np.bincount(np.concatenate([np.zeros(0, np.uint16), *[t for t, _ in sample]]), minlength=IDS)
    places = Places(np.log((len(sample) + 1) / (df + 0.5)).clip(0), np.zeros((0, WIDTH)))
    x = np.array([places.vector(*d) for d in sample]).reshape(-1, WIDTH)
    x = x[np.linalg.norm(x, axis=1) > 0]
    if not len(x):
        return places
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    chosen, near = [0], x @ x[0]
    while len(chosen) < min(CENTROIDS, len(x)):
        chosen.append(int(near.argmin()))
        near = np.maximum(near, x @ x[chosen[-1]])
    c = x[chosen]
    for _ in range(ROUNDS):
        label = (x @ c.T).argmax(axis=1)
        sums = np.array([x[label == k].sum(axis=0) if (label == k).any() else c[k] for k in range(len(c))])
        c = sums / np.maximum(np.linalg.norm(sums, axis=1, keepdims=True), 1e-9)
    order, left = [0], set(range(1, len(c)))
    while left:
        order.append(max(left, key=lambda k: (c[order[-1]] @ c[k], -k)))
        left.remove(order[-1])
    places.centroids = c[order]
    return places


def _slices(batches, vocabulary: Vocabulary):
    """Slices of batches with the ids of their texts."""
    import numpy as np

    encoder, end = tokenizer(vocabulary), np.array([END_ID], np.uint16)
    for whole in batches:
        for at in range(0, len(whole), SLICE):
            batch = whole.slice(at, SLICE)
            yield batch, [np.append(x, end) for x in encoder.ids_of(utf8(batch, "text"))]


def encoded(docs: DataFrame, vocabulary: Vocabulary, places: Places | None = None) -> DataFrame:
    """doc_id, ids (16-bit, with the end id), n, place (nearest centroid), key (least shingle)."""

    def encode(batches):
        import pyarrow as pa

        for batch, ids in _slices(batches, vocabulary):
            near = [places.nearest(x) if places else 0 for x in ids]
            columns = [
                batch.column("doc_id"), pa.array([x.tobytes() for x in ids], pa.binary()), pa.array(map(len, ids), pa.int64()),
                pa.array(near, pa.int32()), pa.array(map(least_shingle, ids), pa.int64()),
            ]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "ids", "n", "place", "key"])

    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return own.mapInArrow(encode, "doc_id long, ids binary, n long, place int, key long")


def sampled(docs: DataFrame, rows: int, vocabulary: Vocabulary) -> list:
    """(terms, counts) of about SAMPLE documents, SAMPLE at most; a document has no more terms than the vocabulary."""
    import numpy as np

    def counted(batches):
        import pyarrow as pa

        for _, ids in _slices(batches, vocabulary):
            found = [np.unique(x, return_counts=True) for x in ids]
            columns = [pa.array([t.tobytes() for t, _ in found], pa.binary()), pa.array([n.astype("<u4").tobytes() for _, n in found], pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, ["terms", "counts"])

    # a part of twice as many at most, and of these the smallest hashes: the same documents each time, from all files
    h, every = F.xxhash64(F.col("doc_id"), F.lit(SEED)), max(1, rows // SAMPLE)
    part = docs.select("doc_id", "text").filter(F.pmod(h, F.lit(every)) == 0).orderBy(h, "doc_id", "text").limit(SAMPLE)
    found = part.select("text").mapInArrow(counted, "terms binary, counts binary").collect()
    return [(np.frombuffer(t, np.uint16), np.frombuffer(n, "<u4")) for t, n in sorted((bytes(r.terms), bytes(r.counts)) for r in found)]


def placed(rows: DataFrame, shard_tokens: int, broadcast_rows: int = BROADCAST_ROWS) -> tuple[DataFrame, int]:
    """shard, doc_id, ids: equal stretches of the order (place, key); and their number. rows: a stored table of encoded()."""
    sizes = {r.place: int(r.n) for r in rows.groupBy("place").agg(F.sum("n").alias("n")).collect()}
    top, at, begins = max(sizes, default=0), 0, []
    for k in range(top + 1):
        begins.append(at)
        at += sizes.get(k, 0)
    shards = max(1, -(-at // shard_tokens))
    heavy = rows.groupBy("place", "key").agg(F.sum("n").alias("all")).filter(F.col("all") > shard_tokens // 8)
    heavy = stored(heavy.select(F.col("place").alias("place_"), F.col("key").alias("key_")), "heavy")
    if heavy.count() <= broadcast_rows:
        heavy = F.broadcast(heavy)
    # a row's place in the stored files, which a task that is run again reads alike
    met = rows.withColumn("nth_", F.monotonically_increasing_id()).join(heavy, (F.col("place") == F.col("place_")) & (F.col("key") == F.col("key_")), "left")
    # least hashes are small numbers: a second hash spreads them; a heavy key's rows are spread by their places
    share = F.xxhash64(F.when(F.col("key_").isNull(), F.col("key")).otherwise(F.col("nth_"))) / float(1 << 64) + 0.5
    begin, size = (F.array(*[F.lit(float(x)) for x in xs])[F.col("place")] for xs in (begins, [sizes.get(k, 0) for k in range(top + 1)]))
    shard = F.least(F.lit(shards - 1), F.floor((begin + share * size) * shards / max(at, 1))).cast("int")
    return met.select(shard.alias("shard"), "doc_id", "ids"), shards


def pack(docs: DataFrame, vocabulary: Vocabulary = BYTE_BPE, shard_tokens: int = SHARD_TOKENS, length: int = LENGTH) -> DataFrame:
    """A row for each piece. One shuffle, of the ids by shard: a shard is a partition, and so a task."""

    def packed(batches):
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc

        if not (parts := list(batches)):
            return
        rows = pa.Table.from_batches(parts)
        del parts
        numbers = sorted(pc.unique(rows.column("shard")).to_pylist())
        for number in numbers:
            shard = rows if len(numbers) == 1 else rows.filter(pc.equal(rows.column("shard"), number))
            # the ids stay where the rows came in: their order is one of views
            order = pc.sort_indices(shard, sort_keys=[("doc_id", "ascending"), ("ids", "ascending")])
            keys, views = shard.column("doc_id").take(order).to_pylist(), [np.frombuffer(x.as_buffer(), np.uint16) for x in shard.column("ids")]
            ids = [views[i] for i in order.to_pylist()]
            del views
            found = [
                (keys[d], start, n, zlib.crc32(ids[d][start : start + n].astype("<u4")), len(ids[d]), number << 32 | s, at)
                for d, start, n, s, at in pack_shard(ids, length)
            ]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*found, strict=True)], [x.split()[0] for x in PIECES.split(", ")])
        pa.default_memory_pool().release_unused()

    places = fit(sampled(docs, docs.count(), vocabulary))
    rows, shards = placed(stored(encoded(docs, vocabulary, places), "encoded"), shard_tokens)
    return rows.repartitionById(shards, F.col("shard")).mapInArrow(packed, PIECES)
