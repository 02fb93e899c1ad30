"""Suffix-array removal of repeated passages: later copies go, the first stays.

A byte goes if a 50-byte string that covers it also starts in a document with a smaller id.  Equal 50-byte strings
have one anchor (anchors.py), so batches first ask which anchors other documents have too.  The runs of shared
anchors, a distinct string once for each batch with its smallest id, then go to the anchor's bucket; runs of a hot
anchor, as at the edges of a passage that very many documents have, are cut into single windows, each in a bucket of
its own hash.  There the suffixes are sorted, neighbours have their longest common prefixes, and the previous and next
smaller document in suffix order give each suffix its longest match in an earlier document: the
longest-previous-factor array, with factors cut at 50 bytes.  A factor of 50 marks the string, and the answer, a bit
for each, returns to the batch.  Copies inside a batch need no sorting: equal runs are one string.

Matches never cross documents, overlaps count, and strings are judged on the input.

Cases: null or empty texts have no bytes and no spans; texts under 50 bytes lose nothing; rows that repeat a doc_id
are the same document and lose nothing to each other; null ids count as larger than all others; a text of any length
is hashed in pieces; an empty table gives an empty result; extra columns pass through.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vocalith.llm import anchors
from vocalith.llm.anchors import SPAN
from vocalith.llm.batches import batched, bucket_bits, by_bucket, by_buckets, ids_of, pack_keys, size_of, texts_of, unpack, unpack_keys

ASK = "bucket int, batch int, keys binary, more binary, many binary, data binary"
ANSWER = "batch int, bucket int, bits binary"
#: The number of the bucket in an answer that holds a batch's own earlier answers.
KEPT = -1
#: An anchor with so many runs in all is hot: each of its windows goes to a bucket of its own hash.  A batch counts its
#: runs of an anchor from the second number on; fewer count as one.
HOT, LISTED = 4096, 16
#: Suffixes that are sorted at a time.
SORTED = 1 << 18


def smaller_neighbours(value: np.ndarray, lcp: np.ndarray):
    """For each rank the least LCP on the way to the previous and to the next rank of smaller value; 0 if none.

    lcp[i] is of ranks i-1 and i.  Pointers jump: whatever lies between a rank and its candidate is not smaller.
    """
    n = len(value)

    def one_way(value, lcp):
        at, low = np.arange(-1, n - 1), lcp.copy()
        padded = np.append(value, np.iinfo(np.int64).min)  # index -1: smaller than all
        active = np.flatnonzero(padded[at] >= value)
        while len(active):
            hop = at[active]
            low[active] = np.minimum(low[active], low[hop])
            at[active] = at[hop]
            active = active[padded[at[active]] >= value[active]]
        low[at < 0] = 0
        return low

    back = one_way(value[::-1], np.concatenate([[0], lcp[1:][::-1]]).astype(lcp.dtype))
    return one_way(value, lcp), back[::-1]


def longest_previous_factors(data: np.ndarray, begin: np.ndarray, value: np.ndarray) -> np.ndarray:
    """For suffixes at `begin`, the longest match, cut at SPAN bytes, with one of a smaller value.

    Suffixes are sorted by their first SPAN bytes, equal ones by value: whether a factor is longer changes no answer.
    """
    if not len(begin):
        return np.zeros(0, np.int64)
    by_value = np.argsort(value, kind="stable")
    suffixes = np.lib.stride_tricks.sliding_window_view(data, SPAN)[begin[by_value]]
    order = np.argsort(suffixes.view(f"S{SPAN}").ravel(), kind="stable")
    suffixes, ranked = suffixes[order], by_value[order]
    differ = suffixes[1:] != suffixes[:-1]
    lcp = np.zeros(len(begin), np.int64)
    lcp[1:] = np.where(differ.any(axis=1), differ.argmax(axis=1), SPAN)
    before, after = smaller_neighbours(value[ranked], lcp)
    out = np.empty(len(begin), np.int64)
    out[ranked] = np.maximum(before, after)
    return out


def whole_matches(data: np.ndarray, begin: np.ndarray, value: np.ndarray) -> np.ndarray:
    """Which suffixes at `begin` have a factor of SPAN bytes. Equal windows have equal hashes, so stretches of hashes are sorted each by itself."""
    out = np.zeros(len(begin), bool)
    if len(begin) <= SORTED:
        return longest_previous_factors(data, begin, value) >= SPAN
    # two strings of K bytes at the window's ends, which equal windows share
    h = anchors.hashes(data)
    key = h[begin] ^ (h[begin + SPAN - anchors.K] >> np.uint64(1))
    del h
    parts = -(-2 * len(begin) // SORTED)
    part = ((key >> np.uint64(40)) * np.uint64(parts) >> np.uint64(24)).astype(np.int32)
    del key
    order = np.argsort(part, kind="stable")
    for at in np.split(order, np.flatnonzero(np.diff(part[order])) + 1):
        out[at] = longest_previous_factors(data, begin[at], value[at]) >= SPAN
    return out


class Batch:
    """A batch's runs, and the distinct anchors they have."""

    def __init__(self, group):
        self.rows = unpack(group)
        self.texts, self.ids = texts_of(self.rows), ids_of(self.rows)
        self.text, self.start, self.count, self.anchor = anchors.runs(self.texts)
        self.keys, self.key_of = np.unique(self.anchor, return_inverse=True)

    def several(self) -> np.ndarray:
        """Anchors that two documents of the batch have."""
        low = np.full(len(self.keys), np.iinfo(np.int64).max)
        high = np.full(len(self.keys), np.iinfo(np.int64).min)
        np.minimum.at(low, self.key_of, self.ids[self.text])
        np.maximum.at(high, self.key_of, self.ids[self.text])
        return low != high

    def share(self, bits: int, answers: dict[int, bytes]) -> Shared:
        flags, hot = np.zeros(len(self.keys), bool), np.zeros(len(self.keys), bool)
        for bucket, part in by_bucket(self.keys, bits):
            n = part.stop - part.start
            flags[part], hot[part] = _flags(answers[bucket], n)
        run = np.flatnonzero(flags[self.key_of])
        text, start, count = self.text[run], self.start[run], self.count[run].astype(np.int64)
        bucket = (self.anchor[run] >> np.uint64(64 - bits)).astype(np.int64)
        if len(at := np.flatnonzero(hot[self.key_of[run]])):
            import xxhash

            n = count[at]
            begin = np.repeat(start[at], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            owner = np.repeat(text[at], n)
            own = [xxhash.xxh64_intdigest(self.texts[t][s : s + SPAN]) >> (64 - bits) for t, s in zip(owner.tolist(), begin.tolist(), strict=True)]
            text, start, count, bucket = (
                np.concatenate([np.delete(x, at), y])
                for x, y in ((text, owner), (start, begin), (count, np.ones(len(begin), np.int64)), (bucket, np.array(own, np.int64)))
            )
        return Shared(self, text, start, count, bucket)


class Shared:
    """A batch's runs of shared anchors, their buckets, and for each the number of its string; `first` is where a string is first."""

    def __init__(self, batch: Batch, text, start, count, bucket):
        self.text, self.start, self.count, self.bucket = text, start, count, bucket
        seen: dict[bytes, int] = {}
        texts = batch.texts
        places = zip(text.tolist(), start.tolist(), count.tolist(), strict=True)
        self.string = np.fromiter((seen.setdefault(texts[t][s : s + c + SPAN - 1], len(seen)) for t, s, c in places), np.int64, len(text))
        self.strings = list(seen)
        # the smallest document that has it
        order = np.lexsort((batch.ids[text], self.string))
        new = np.append(True, self.string[order][1:] != self.string[order][:-1])[: len(order)]
        self.first = order[new]

    def by_bucket(self) -> list[np.ndarray]:
        """Numbers of the strings of each bucket."""
        bucket = self.bucket[self.first]
        order = np.argsort(bucket, kind="stable")
        return np.split(order, np.flatnonzero(np.diff(bucket[order])) + 1) if len(order) else []


def _flags(answer: bytes, n: int) -> tuple[np.ndarray, np.ndarray]:
    half = (n + 7) // 8
    return tuple(np.unpackbits(np.frombuffer(answer[a : a + half], np.uint8), count=n).astype(bool) for a in (0, half))


def _ask(bits: int):
    def ask(group):
        import pyarrow as pa

        batch, number = Batch(group), group.column("batch")[0].as_py()
        several, n = batch.several(), np.bincount(batch.key_of, minlength=len(batch.keys))
        rows = []
        for b, p in by_bucket(batch.keys, bits):
            at = np.flatnonzero(n[p] >= LISTED)
            many = np.stack([at, n[p][at]]).astype("<u4").tobytes() if len(at) else None
            rows.append((b, number, pack_keys(batch.keys[p], bits), np.packbits(several[p]).tobytes(), many, None))
        return _table(rows, ASK)

    return ask


def _shared(bits: int):
    """Anchors that two batches have, or two documents of one; and which of them are hot."""

    def shared(group):
        keys = [unpack_keys(x, bits) for x in group.column("keys").to_pylist()]
        several = [np.unpackbits(np.frombuffer(x, np.uint8), count=len(k)) for x, k in zip(group.column("more").to_pylist(), keys, strict=True)]
        runs = [np.ones(len(k), np.int64) for k in keys]
        for r, x in zip(runs, group.column("many").to_pylist(), strict=True):
            if x:
                at, n = np.frombuffer(x, "<u4").reshape(2, -1)
                r[at] = n
        _, key_of, count = np.unique(np.concatenate(keys), return_inverse=True, return_counts=True)
        total = np.bincount(key_of, np.concatenate(runs), len(count))
        count = count + np.bincount(key_of, np.concatenate(several), len(count))
        cuts = np.cumsum([len(k) for k in keys])[:-1]
        flags, hot = np.split(count[key_of] > 1, cuts), np.split(total[key_of] >= HOT, cuts)
        names = zip(group.column("batch").to_pylist(), group.column("bucket").to_pylist(), strict=True)
        return _table([(b, k, np.packbits(f).tobytes() + np.packbits(h).tobytes()) for (b, k), f, h in zip(names, flags, hot, strict=True)], ANSWER)

    return shared


def _strings(bits: int):
    """Shared runs by bucket, and the batch's answers so far, which travel along."""

    def strings(group, answered):
        if not len(group):
            return _table([], ASK)
        batch, number = Batch(group), group.column("batch")[0].as_py()
        answers = _answers(answered)
        shared = batch.share(bits, answers)
        count, doc, bucket = shared.count[shared.first], batch.ids[shared.text[shared.first]], shared.bucket[shared.first]
        rows = []
        for at in shared.by_bucket():
            data = b"".join([shared.strings[i] for i in at.tolist()])
            rows.append((int(bucket[at[0]]), number, count[at].astype("<u4").tobytes(), doc[at].astype("<i8").tobytes(), None, data))
        kept = b"".join(answers[b] for b, _ in by_bucket(batch.keys, bits))
        rows.append((number % (1 << bits), number, None, kept, None, None))
        return _table(rows, ASK)

    return strings


def _repeated(group):
    """A bit for each window of a bucket's strings: it also starts in a document with a smaller id."""
    columns = [group.column(c).to_pylist() for c in ("batch", "bucket", "keys", "more", "data")]
    rows = list(zip(*columns, strict=True))
    out = [(batch, KEPT, more) for batch, _, keys, more, _ in rows if keys is None]
    asked = [r for r in rows if r[2] is not None]
    if asked:
        counts = [np.frombuffer(r[2], "<u4").astype(np.int64) for r in asked]
        count, doc = np.concatenate(counts), np.concatenate([np.frombuffer(r[3], "<i8") for r in asked])
        data = np.frombuffer(b"".join(r[4] for r in asked), np.uint8)
        length = count + SPAN - 1
        nth = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
        begin = np.repeat(np.cumsum(length) - length, count) + nth
        found = whole_matches(data, begin, np.repeat(doc, count))
        parts = np.split(found, np.cumsum([c.sum() for c in counts])[:-1])
        out += [(r[0], r[1], np.packbits(p).tobytes()) for r, p in zip(asked, parts, strict=True)]
    return _table(out, ANSWER)


def _answers(answered) -> dict[int, bytes]:
    return dict(zip(answered.column("bucket").to_pylist(), answered.column("bits").to_pylist(), strict=True))


def removed_bytes(batch: Batch, bits: int, answers: dict[int, bytes]) -> np.ndarray:
    """Which bytes of the batch's joined texts go."""
    own, at = {}, 0
    kept = answers.get(KEPT, b"")
    for bucket, part in by_bucket(batch.keys, bits):
        n = 2 * ((part.stop - part.start + 7) // 8)
        own[bucket], at = kept[at : at + n], at + n
    shared = batch.share(bits, own)
    size = np.fromiter(map(len, batch.texts), np.int64, len(batch.texts))
    ends = np.cumsum(size)
    change = np.zeros(int(size.sum()) + 1, np.int32)
    if len(shared.text):
        begin = (ends - size)[shared.text] + shared.start
        later = batch.ids[shared.text] > batch.ids[shared.text[shared.first]][shared.string]
        np.add.at(change, begin[later], 1)
        np.add.at(change, begin[later] + shared.count[later] + SPAN - 1, -1)
        # windows of each string, in the order in which they were asked
        count, bucket = shared.count[shared.first], shared.bucket[shared.first]
        flags = np.zeros(int(count.sum()), bool)
        place = np.cumsum(count) - count
        for at in shared.by_bucket():
            n = count[at]
            got = np.unpackbits(np.frombuffer(answers[int(bucket[at[0]])], np.uint8), count=int(n.sum())).astype(bool)
            flags[np.repeat(place[at] - (np.cumsum(n) - n), n) + np.arange(n.sum())] = got
        here = np.flatnonzero(~later)
        n = shared.count[here]
        nth = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        hit = flags[np.repeat(place[shared.string[here]], n) + nth]
        windows = (np.repeat(begin[here], n) + nth)[hit]
        np.add.at(change, windows, 1)
        np.add.at(change, windows + SPAN, -1)
    return np.cumsum(change[:-1], dtype=np.int32) > 0


def _table(rows: list, schema: str):
    import pyarrow as pa

    kinds = {"int": pa.int32(), "binary": pa.binary()}
    fields = [f.split() for f in schema.split(", ")]
    columns = list(zip(*rows, strict=True)) or [[]] * len(fields)
    return pa.table([pa.array(c, kinds[k]) for c, (_, k) in zip(columns, fields, strict=True)], names=[n for n, _ in fields])


SPANS = T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("length", T.LongType())]))


def remove_repeats(docs: DataFrame) -> DataFrame:
    """docs with kept (the remaining bytes), spans (removed runs), n_bytes and kept_text; docs needs doc_id and text.

    kept_text leaves out the bytes of a character of which only a part remains.
    """
    size = size_of(docs)
    bits = bucket_bits(size)
    own = [f for f in docs.schema.fields if f.name not in ("kept", "spans", "n_bytes", "kept_text")]
    batches = batched(docs.select(*[F.col("doc_id").cast("long") if f.name == "doc_id" else F.col(f"`{f.name}`") for f in own]), size)

    def result(group, answered):
        import pyarrow as pa

        if not len(group):
            return result_schema.empty_table()
        batch = Batch(group)
        gone = removed_bytes(batch, bits, _answers(answered))
        kept, spans, at = [], [], 0
        for text in batch.texts:
            mask = gone[at : at + len(text)]
            at += len(text)
            edges = np.flatnonzero(np.diff(np.concatenate([[0], mask.view(np.int8), [0]])))
            spans.append([{"start": int(a), "length": int(b - a)} for a, b in zip(edges[::2], edges[1::2], strict=True)])
            kept.append(np.frombuffer(text, np.uint8)[~mask].tobytes() if len(edges) else text)
        columns = [*(batch.rows.column(f.name) for f in own), pa.array(kept, pa.binary()), pa.array(spans, result_schema.field("spans").type), pa.array(map(len, batch.texts), pa.int64()), pa.array([k.decode("utf-8", "ignore") for k in kept], pa.string())]
        return pa.table(columns, schema=result_schema)

    schema = T.StructType([T.StructField(f.name, T.LongType() if f.name == "doc_id" else f.dataType) for f in own] + [T.StructField("kept", T.BinaryType()), T.StructField("spans", SPANS), T.StructField("n_bytes", T.LongType()), T.StructField("kept_text", T.StringType())])
    from pyspark.sql.pandas.types import to_arrow_schema

    result_schema = to_arrow_schema(schema)
    asked = batches.groupBy("batch").applyInArrow(_ask(bits), ASK)
    shared = by_buckets(asked, size).applyInArrow(_shared(bits), ANSWER)
    strings = batches.groupBy("batch").cogroup(shared.groupBy("batch")).applyInArrow(_strings(bits), ASK)
    repeated = by_buckets(strings, size).applyInArrow(_repeated, ANSWER)
    return batches.groupBy("batch").cogroup(repeated.groupBy("batch")).applyInArrow(result, schema)


def digest(rows: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256."""
    return rows.select(
        "doc_id", "n_bytes",
        (F.col("n_bytes") - F.octet_length("kept")).cast("long").alias("n_removed"),
        F.size("spans").cast("long").alias("n_spans"),
        F.sha2(F.col("kept"), 256).alias("kept_sha256"),
    )


def without_repeats(docs: DataFrame) -> DataFrame:
    """The rows of docs with what remains of their texts; n_chars, if there is one, follows the text."""
    rows = remove_repeats(docs)
    kept = rows.withColumn("text", F.col("kept_text"))
    if "n_chars" in docs.columns:
        kept = kept.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return kept.select(docs.columns)
