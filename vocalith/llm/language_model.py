"""Language-model scores by deleted interpolation.

    P(w | u) = a * c(u w) / c(u) + b * c(w) / N + d / (V + 1)

The weights (a, b, d) belong to buckets of the context's frequency c(u), by powers of two, and are learned by
expectation-maximisation on counts that are deleted from training: each tuning document, those of one remainder of the
training documents' hash, is predicted from the counts of all other training documents.  One pass counts their tokens by bucket
and by the two ratios in quarter octaves, a table whose size doesn't depend on the input, and the iterations run on that table.
Documents that are held out for the test, those of another remainder, are only scored.

Counts cover all training documents, tuning ones too.  A batch of documents asks once for each distinct word, then for each distinct
pair, unless only held-out documents have it here and no other batch trains on its word or its context.  Scores are sums over whole texts.

Cases: a null, empty or blank text is its end token; without training documents every token is unknown, with
probability 1; repeated rows count and score each on its own; a null doc_id counts as the text "", which trains;
an empty table gives an empty result; extra columns are not read.
"""

from __future__ import annotations

import zlib

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vocalith.llm.batches import batched, bucket_bits, by_bucket, by_buckets, pack_keys, size_of, texts_of, unpack, unpack_keys
from vocalith.llm.common import stored

FOLDS, HELD_OUT, TUNING = 7, 2, 3
#: Names that no word can have: words have no spaces.
END, START = b" end", b" start"
BUCKETS = 32
STEPS = 4
ITERATIONS = 60
ASK = "bucket int, batch int, kind int, keys binary, counts binary, many binary, tuning binary, contexts binary, words binary"
ANSWER = "batch int, kind int, bucket int, blob binary"
QUESTION, EARLIER, HISTOGRAM, TOTALS = range(4)
NOWHERE = -1
#: In place of a ratio whose count is zero.
NO_RATIO = -(1 << 20)


def fold(doc_id) -> int:
    return zlib.crc32(b"" if doc_id is None else str(doc_id).encode()) % FOLDS


def held_out(doc_id) -> bool:
    return fold(doc_id) == HELD_OUT


def pack_counts(x: np.ndarray) -> bytes:
    """The narrowest unsigned type, named by its width."""
    top = int(x.max()) if len(x) else 0
    width = next(w for w in (1, 2, 4, 8) if top < 1 << (8 * w))
    return bytes([width]) + x.astype(f"<u{width}").tobytes()


def unpack_counts(x: bytes) -> np.ndarray:
    return np.frombuffer(x, f"<u{x[0]}", offset=1).astype(np.int64)


def pair_keys(context: np.ndarray, word: np.ndarray) -> np.ndarray:
    h = context * np.uint64(0x9E3779B97F4A7C15)
    h ^= h >> np.uint64(31)
    h += word
    h *= np.uint64(0xC2B2AE3D27D4EB4F)
    return h ^ (h >> np.uint64(29))


class Batch:
    """Tokens of a batch: distinct words and pairs, their counts in its training documents, and in each tuning document."""

    def __init__(self, group):
        import xxhash

        digest = xxhash.xxh64_intdigest
        self.rows = unpack(group)
        self.ids = self.rows.column("doc_id").to_pylist()
        folds = np.array([fold(i) for i in self.ids], np.int64)
        self.held = folds == HELD_OUT
        hashes, sizes = [], []
        end = np.array([digest(END)], np.uint64)
        for text in texts_of(self.rows):
            w = text.lower().split()
            hashes += [np.fromiter(map(digest, w), np.uint64, len(w)), end]
            sizes.append(len(w) + 1)
        self.size = np.array(sizes, np.int64)
        self.doc = np.repeat(np.arange(len(sizes)), self.size)
        token = np.concatenate(hashes)
        context = np.empty_like(token)
        context[1:] = token[:-1]
        first = np.cumsum(self.size) - self.size
        context[first] = digest(START)
        train, tuning = ~self.held[self.doc], (folds == TUNING)[self.doc]
        self.words, self.word = np.unique(token, return_inverse=True)
        self.word_count = np.bincount(self.word[train], minlength=len(self.words))
        # the start is a context as often as the end is a word
        self.end = int(np.searchsorted(self.words, end[0]))
        self.context = np.empty_like(self.word)
        self.context[1:] = self.word[:-1]
        self.context[first] = self.end
        self.pairs, at, self.pair = np.unique(pair_keys(context, token), return_index=True, return_inverse=True)
        self.pair_word, self.pair_context = self.word[at], self.context[at]
        self.pair_count = np.bincount(self.pair[train], minlength=len(self.pairs))
        # by pair, then document: what each tuning document has of a pair, of its context and of its word
        docs, doc = len(sizes), self.doc[tuning]
        of_pair, self.tuned_count = np.unique(self.pair[tuning] * docs + doc, return_counts=True)
        of_word, times = np.unique(self.word[tuning] * docs + doc, return_counts=True)
        self.tuned_pair, doc = of_pair // max(1, docs), of_pair % max(1, docs)
        own = lambda word: times[np.searchsorted(of_word, word * docs + doc)] if len(doc) else times[:0]
        self.tuned_context, self.tuned_word = own(self.pair_context[self.tuned_pair]), own(self.pair_word[self.tuned_pair])

    def open(self, totals: np.ndarray) -> np.ndarray:
        """Pairs to ask about: this batch trains on them, or others may, as they train on both word and context."""
        elsewhere = totals > self.word_count
        return (self.pair_count > 0) | elsewhere[self.pair_word] & elsewhere[self.pair_context]

    def totals(self, bits: int, answers: dict[int, bytes]) -> np.ndarray:
        parts = [unpack_counts(answers[b]) for b, _ in by_bucket(self.words, bits)]
        return np.concatenate(parts) if parts else np.zeros(0, np.int64)


def _table(rows: list, schema: str):
    import pyarrow as pa

    kinds = {"int": pa.int32(), "binary": pa.binary()}
    fields = [f.split() for f in schema.split(", ")]
    columns = list(zip(*rows, strict=True)) or [[]] * len(fields)
    return pa.table([pa.array(c, kinds[k]) for c, (_, k) in zip(columns, fields, strict=True)], names=[n for n, _ in fields])


def _ask_words(bits: int):
    def ask(group):
        batch, number = Batch(group), group.column("batch")[0].as_py()
        rows = [(b, number, QUESTION, pack_keys(batch.words[p], bits), pack_counts(batch.word_count[p]), None, None, None, None) for b, p in by_bucket(batch.words, bits)]
        return _table(rows, ASK)

    return ask


def _sum_up(group, bits: int):
    """Totals of a bucket's keys over all batches, for each batch in its own order."""
    questions = [r for r in zip(*[group.column(c).to_pylist() for c in ("batch", "bucket", "keys", "counts")], strict=True)]
    keys = [unpack_keys(r[2], bits) for r in questions]
    unique, key_of = np.unique(np.concatenate(keys), return_inverse=True)
    total = np.bincount(key_of, np.concatenate([unpack_counts(r[3]) for r in questions]), len(unique)).astype(np.int64)
    parts = np.split(total[key_of], np.cumsum([len(k) for k in keys])[:-1])
    return questions, parts, total


def _word_totals(bits: int):
    def totals(group):
        questions, parts, total = _sum_up(group, bits)
        rows = [(r[0], QUESTION, r[1], pack_counts(p)) for r, p in zip(questions, parts, strict=True)]
        rows.append((NOWHERE, TOTALS, questions[0][1], np.array([total.sum(), (total > 0).sum()], "<i8").tobytes()))
        return _table(rows, ANSWER)

    return totals


#: Where the numbers of a bin stand in its code, and what is added to ratios so that they are positive.
_TWO, _ONE, _PLUS = 12, 24, 2048


def bins(pair: np.ndarray, context: np.ndarray, word: np.ndarray) -> np.ndarray:
    """A code of (bucket of the context, quarter octaves of c(uw)/c(u) and of c(w)); zero in place of a ratio: none."""
    with np.errstate(divide="ignore", invalid="ignore"):
        two = np.where(pair > 0, np.round(STEPS * np.log2(pair / context)) + _PLUS, 0)
        one = np.where(word > 0, np.round(STEPS * np.log2(word)) + _PLUS, 0)
    return context_bucket(context) << _ONE | two.astype(np.int64) << _TWO | one.astype(np.int64)


def context_bucket(count: np.ndarray) -> np.ndarray:
    """0 for contexts that training lacks, else one more than the power of two."""
    return np.where(count > 0, np.minimum(1 + np.log2(np.maximum(count, 1)).astype(np.int64), BUCKETS - 1), 0)


def _summed(code: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    unique, at = np.unique(code, return_inverse=True)
    return unique, np.bincount(at, n, len(unique)).astype(np.int64)


def _histogram(code: np.ndarray, n: np.ndarray) -> bytes:
    """Rows (bucket, two, one, tokens); a ratio that isn't there is far below all others."""
    code, n = _summed(code, n)
    ratio = lambda x: np.where(x > 0, x - _PLUS, NO_RATIO)
    return np.stack([code >> _ONE, ratio(code >> _TWO & 4095), ratio(code & 4095), n], axis=1).astype("<i8").tobytes()


def _ask_pairs(bits: int):
    """Open pairs by bucket, with what tuning documents have of them; and answers that travel along."""

    def ask(group, answered):
        kinds = answered.column("kind").to_pylist() if len(answered) else []
        blobs = answered.column("blob").to_pylist() if len(answered) else []
        buckets = answered.column("bucket").to_pylist() if len(answered) else []
        if not len(group):
            return _table([(b, NOWHERE, TOTALS, x, None, None, None, None, None) for b, x in zip(buckets, blobs, strict=True)], ASK)
        batch, number = Batch(group), group.column("batch")[0].as_py()
        answers = {b: x for k, b, x in zip(kinds, buckets, blobs, strict=True) if k == QUESTION}
        totals = batch.totals(bits, answers)
        open_ = batch.open(totals)
        rows = [(number % (1 << bits), number, EARLIER, pack_counts(totals), None, None, None, None, None)]
        context = totals[batch.pair_context[batch.tuned_pair]] - batch.tuned_context
        word = totals[batch.pair_word[batch.tuned_pair]] - batch.tuned_word
        at = np.flatnonzero(open_)
        for b, p in by_bucket(batch.pairs[at], bits):
            i = at[p]
            tuned = slice(*np.searchsorted(batch.tuned_pair, [i[0], i[-1] + 1]))
            many = np.bincount(np.searchsorted(i, batch.tuned_pair[tuned]), minlength=len(i))
            rows.append((
                b, number, QUESTION, pack_keys(batch.pairs[i], bits), pack_counts(batch.pair_count[i]), pack_counts(many),
                pack_counts(batch.tuned_count[tuned]), pack_counts(context[tuned]), pack_counts(word[tuned]),
            ))
        return _table(rows, ASK)

    return ask


def _pair_totals(bits: int):
    import pyarrow.compute as pc

    def totals(group):
        along = group.filter(pc.not_equal(group.column("kind"), QUESTION))
        rows = list(zip(*[along.column(c).to_pylist() for c in ("batch", "kind", "bucket", "keys")], strict=True))
        asked = group.filter(pc.equal(group.column("kind"), QUESTION))
        if len(asked):
            questions, parts, _ = _sum_up(asked, bits)
            rows += [(r[0], QUESTION, r[1], pack_counts(p)) for r, p in zip(questions, parts, strict=True)]
            found = []  # a batch at a time
            columns = [asked.column(c) for c in ("many", "tuning", "contexts", "words")]
            for p, *row in zip(parts, *columns, strict=True):
                many, n, context, word = (unpack_counts(x.as_py()) for x in row)
                if len(n):
                    found.append(_summed(bins(np.repeat(p, many) - n, context, word), n))
            if found:
                rows.append((NOWHERE, HISTOGRAM, questions[0][1], _histogram(*map(np.concatenate, zip(*found, strict=True)))))
        return _table(rows, ANSWER)

    return totals


def learn_weights(histogram: np.ndarray, n: int, v: int) -> np.ndarray:
    """(BUCKETS, 3): weights of pair, word and uniform estimates. One expected token of each is added in every step."""
    bucket, two, one, count = histogram.T if len(histogram) else np.zeros((4, 0), np.int64)
    uniform = 1 / (v + 1)
    p = np.stack([np.where(two > -(1 << 19), 2.0 ** (two / STEPS), 0), np.where(one > -(1 << 19), 2.0 ** (one / STEPS), 0) / max(n, 1), np.full(len(two), uniform)], axis=1)

    def fit(p, count):
        w = np.full(3, 1 / 3)
        for _ in range(ITERATIONS):
            share = w * p
            share *= (count / share.sum(axis=1))[:, None]
            w = (share.sum(axis=0) + 1) / (share.sum() + 3)
        return w

    pooled = fit(p, count)
    weights = np.stack([fit(p[bucket == b], count[bucket == b]) if (bucket == b).any() else pooled for b in range(BUCKETS)])
    weights[0] = [0, *(weights[0, 1:] / weights[0, 1:].sum())]
    return weights


def _scores(bits: int, n: int, v: int, weights: np.ndarray):
    names = [f.split()[0] for f in RESULT.split(", ")]

    def scores(group, answered):
        import pyarrow as pa

        if not len(group):
            return pa.table([pa.array([], t) for t in _kinds()], names=names)
        batch = Batch(group)
        found = list(zip(*[answered.column(c).to_pylist() for c in ("kind", "bucket", "blob")], strict=True))
        totals = unpack_counts(next(x for k, _, x in found if k == EARLIER))
        answers = {b: x for k, b, x in found if k == QUESTION}
        at = np.flatnonzero(batch.open(totals))
        pair = batch.pair_count.copy()
        for b, p in by_bucket(batch.pairs[at], bits):
            pair[at[p]] = unpack_counts(answers[b])
        word, context = totals[batch.pair_word], totals[batch.pair_context]
        w = weights[context_bucket(context)]
        prob = w[:, 0] * pair / np.maximum(context, 1) + w[:, 1] * word / max(n, 1) + w[:, 2] / (v + 1)
        docs = len(batch.size)
        add = lambda x: np.bincount(batch.doc, x, docs)
        base = np.log10((totals + 1) / (n + (v + 1)))
        columns = [
            batch.ids, batch.held, batch.size, add((totals > 0)[batch.word]).astype(np.int64), np.full(docs, n),
            add(base[batch.word]), add(np.log10(prob)[batch.pair]),
        ]
        return pa.table([pa.array(c, t) for c, t in zip(columns, _kinds(), strict=True)], names=names)

    return scores


RESULT = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def _kinds():
    import pyarrow as pa

    return [pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.float64()]


def _unpacked(batches):
    import pyarrow as pa

    for batch in batches:
        flat = np.concatenate([np.zeros((0, 4), np.int64), *[np.frombuffer(x, "<i8").reshape(-1, 4) for x in batch.column("blob").to_pylist()]])
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in flat.T], ["b", "two", "one", "n"])


def _two_sums(batches):
    import pyarrow as pa

    for batch in batches:
        flat = np.concatenate([np.zeros((0, 2), np.int64), *[np.frombuffer(x, "<i8").reshape(-1, 2) for x in batch.column("blob").to_pylist()]])
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in flat.T], ["n", "v"])


def counted(docs: DataFrame, size: int, bits: int) -> DataFrame:
    """Answers for all batches, with the histogram of tuning tokens and the totals: written once, read twice."""
    batches = batched(docs, size)
    words = by_buckets(batches.groupBy("batch").applyInArrow(_ask_words(bits), ASK), size).applyInArrow(_word_totals(bits), ANSWER)
    pairs = batches.groupBy("batch").cogroup(words.groupBy("batch")).applyInArrow(_ask_pairs(bits), ASK)
    return stored(by_buckets(pairs, size).applyInArrow(_pair_totals(bits), ANSWER), "counts")


def score(docs: DataFrame) -> DataFrame:
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    size = size_of(own)
    bits = bucket_bits(size)
    answers = counted(own, size, bits)
    row = answers.filter(F.col("kind") == TOTALS).mapInArrow(_two_sums, "n long, v long").agg(F.sum("n"), F.sum("v")).first()
    n, v = int(row[0] or 0), int(row[1] or 0)
    histogram = answers.filter(F.col("kind") == HISTOGRAM).mapInArrow(_unpacked, "b long, two long, one long, n long")
    table = histogram.groupBy("b", "two", "one").agg(F.sum("n").alias("n")).collect()  # at most one row for each bin
    weights = learn_weights(np.array(sorted(tuple(r) for r in table), np.int64).reshape(-1, 4), n, v)
    own_answers = answers.filter(F.col("batch") != NOWHERE)
    return batched(own, size).groupBy("batch").cogroup(own_answers.groupBy("batch")).applyInArrow(_scores(bits, n, v, weights), RESULT)
