"""Hard negatives of anchors, by slots of scores.

Each anchor has up to five positives: the best other vectors of its label.  A positive admits the negatives between 0.3 and 0.9
times its own score, so an anchor has up to five overlapping windows.  Their upper limits cut the scores into disjoint slots.
A task keeps the best ten of each slot while vectors stream past the anchors; tasks' results are combined by slot; and the first
ten of a window are the first ten of the slots from its upper limit down, cut at its lower limit: slots follow each other in
descending order, so one sorted list of an anchor's slots answers all windows from their own slot on.

Anchors are dealt to blocks of ANCHORS, vectors to stretches of at most STRETCH, and a task multiplies one block with one stretch, in
which vectors stream past.  Neither all anchors nor all vectors are ever in one place, and labels play no part in the dealing.

Cases: rows with a null label or vector, or with a null or non-finite component, take no part.  A component beyond 2^26 after
scaling counts as 2^26, so that scores fit in a long; vectors of several lengths count as filled up with zeros.  A null vec_id
comes after all others in ties and is never an anchor; rows with the anchor's vec_id aren't its positives; repeated rows count each on its
own, and each repeated anchor is answered.  A positive with a negative score has no window.  An empty table gives an empty result; extra
columns are not read.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vocalith.llm.common import discard, stored

ANCHOR_EVERY, RELABELLED_EVERY, LABELS, SCALE = 100, 7, 10, 256
POSITIVES, NEGATIVES = 5, 10
#: Per cent of the positive's score.
LOW, HIGH = 30, 90
LARGEST = 1 << 26
#: Anchors of a block, vectors of a stretch, and products of both, which make a stretch shorter; vectors of a blob.
ANCHORS, STRETCH, LEAST_STRETCH, PRODUCTS = 1 << 15, 1 << 19, 1 << 13, 1 << 33
BLOB = 2048
TILE = 1024
NO_ID = (1 << 63) - 1
NEVER = -(1 << 62)
PACKED = "a int, t int, kind int, ids binary, labels binary, width int, vectors binary, edges binary, keys binary"
FOUND = "key long, slot int, score long, id long"


def vectors(table: DataFrame) -> DataFrame:
    """id, label, v (scaled integers) of the rows that take part."""
    finite = F.forall("embedding", lambda x: F.abs(x) < F.lit(float("inf")))
    label = F.when(F.col("vec_id") % RELABELLED_EVERY == 0, (F.col("label") + 1) % LABELS).otherwise(F.col("label")).cast("long")
    v = F.transform("embedding", lambda x: F.greatest(F.least(F.floor(x.cast("double") * SCALE).cast("long"), F.lit(LARGEST)), F.lit(-LARGEST)))
    kept = table.filter(F.col("label").isNotNull() & F.col("embedding").isNotNull() & finite)
    return kept.select(F.col("vec_id").cast("long").alias("id"), label.alias("label"), v.alias("v"))


def _pack(kind: int, blocks: int, stretches: int):
    """Rows in blobs: anchors for their block and every stretch, vectors for their stretch and every block."""

    def pack(batches):
        import pyarrow as pa

        for batch in batches:
            for at in range(0, len(batch), BLOB):
                part = batch.slice(at, BLOB)
                ids = part.column("id").fill_null(NO_ID).to_numpy()
                lengths = part.column("v").value_lengths().to_numpy()
                width = int(lengths.max(initial=0))
                v = np.zeros((len(lengths), width), "<i4")
                v[np.arange(width)[None, :] < lengths[:, None]] = part.column("v").flatten().to_numpy()
                if np.abs(v).max(initial=0) < 1 << 15:
                    v = v.astype("<i2")
                place = int(np.bitwise_xor.reduce(ids) if len(ids) else 0) ^ len(ids)
                rows = {"ids": ids, "labels": part.column("label").to_numpy(), "vectors": v}
                if kind == 0:
                    rows |= {"edges": np.array(part.column("edges").to_pylist(), "<i8"), "keys": part.column("key").to_numpy()}
                blob = {k: x.tobytes() for k, x in rows.items()} | {"kind": kind, "width": width}
                if kind == 0:
                    made = [blob | {"a": place % blocks, "t": t} for t in range(stretches)]
                else:
                    made = [blob | {"a": a, "t": place % stretches} for a in range(blocks)]
                yield pa.RecordBatch.from_pylist(made, _packed_schema())

    return pack


def _packed_schema():
    import pyarrow as pa

    kinds = {"int": pa.int32(), "binary": pa.binary()}
    return pa.schema([(n, kinds[k]) for n, k in (f.split() for f in PACKED.split(", "))])


class Block:
    """The anchors of a task, and the best `best` rows of each slot so far."""

    def __init__(self, same: bool, best: int):
        self.same, self.best, self.parts = same, best, []

    def add(self, row: dict) -> None:
        self.parts.append(row)

    def ready(self) -> None:
        def column(name):
            return np.concatenate([np.frombuffer(p[name], "<i8") for p in self.parts])

        self.ids, self.labels, self.keys = column("ids"), column("labels"), column("keys")
        self.edges = np.concatenate([np.frombuffer(p["edges"], "<i8").reshape(len(p["ids"]) // 8, -1) for p in self.parts])
        width = max(p["width"] for p in self.parts)
        self.v = _matrix(self.parts, width)
        self.scores = np.full((len(self.ids), self.edges.shape[1] - 1, self.best), NEVER, np.int64)
        self.found = np.full(self.scores.shape, NO_ID, np.int64)
        self.parts = []

    def meet(self, row: dict) -> None:
        """Vectors that stream past."""
        ids, labels, v = np.frombuffer(row["ids"], "<i8"), np.frombuffer(row["labels"], "<i8"), _matrix([row], row["width"])
        order = np.argsort(ids, kind="stable")  # ties go to the smaller id, so to the earlier column
        ids, labels, v = ids[order], labels[order], v[order]
        width = min(v.shape[1], self.v.shape[1])
        other, mine = v[:, :width], self.v[:, :width]
        bound = int(np.abs(other).max(initial=0)) * int(np.abs(mine).max(initial=0)) * max(1, width)
        exact = bound < 1 << 53  # sums of products are whole numbers that a double holds
        other = other.astype(np.float64 if exact else np.int64).T
        for at in range(0, len(self.ids), TILE):
            i = slice(at, at + TILE)
            score = (mine[i].astype(other.dtype) @ other).astype(np.int64)
            open_ = self.labels[i, None] == labels[None, :]
            open_ = open_ & (self.ids[i, None] != ids[None, :]) if self.same else ~open_
            for slot in range(self.edges.shape[1] - 1):
                inside = open_ & (score > self.edges[i, slot + 1, None]) & (score <= self.edges[i, slot, None]) & (score >= self.scores[i, slot, -1:])
                rows = np.flatnonzero(inside.any(axis=1))
                if len(rows):
                    self._keep(at + rows, slot, np.where(inside[rows], score[rows], NEVER), ids)

    def _keep(self, rows: np.ndarray, slot: int, score: np.ndarray, ids: np.ndarray) -> None:
        best = min(self.best, score.shape[1])
        if np.abs(score, where=score > NEVER, out=np.zeros_like(score)).max() < 1 << 50 and score.shape[1] > best:
            # one number for score and column, so that ties are cut where the smaller ids end
            ranked = np.maximum(score, -(1 << 51)) * BLOB - np.arange(score.shape[1])
            first = np.argpartition(-ranked, best - 1, axis=1)[:, :best]
        else:
            first = np.argsort(-score, axis=1, kind="stable")[:, :best]
        scores = np.concatenate([self.scores[rows, slot], np.take_along_axis(score, first, 1)], axis=1)
        found = np.concatenate([self.found[rows, slot], np.where(scores[:, self.best :] > NEVER, ids[first], NO_ID)], axis=1)
        order = np.lexsort((found, -scores), axis=1)[:, : self.best]
        self.scores[rows, slot] = np.take_along_axis(scores, order, 1)
        self.found[rows, slot] = np.take_along_axis(found, order, 1)

    def results(self):
        import pyarrow as pa

        anchor, slot, nth = np.nonzero(self.scores > NEVER)
        columns = [self.keys[anchor], slot.astype(np.int32), self.scores[anchor, slot, nth], self.found[anchor, slot, nth]]
        return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["key", "slot", "score", "id"])


def _matrix(parts: list[dict], width: int) -> np.ndarray:
    rows = [len(p["ids"]) // 8 for p in parts]
    out = np.zeros((sum(rows), width), np.int32)
    at = 0
    for p, n in zip(parts, rows, strict=True):
        kind = "<i2" if len(p["vectors"]) == 2 * n * p["width"] else "<i4"
        out[at : at + n, : p["width"]] = np.frombuffer(p["vectors"], kind).reshape(n, p["width"])
        at += n
    return out


def _scan(same: bool, best: int):
    """The rows of a task come by block and stretch, anchors first."""

    def scan(batches):
        block, here, ready = Block(same, best), None, False
        for batch in batches:
            for row in batch.to_pylist():
                if (row["a"], row["t"]) != here:
                    if ready:
                        yield block.results()
                    block, here, ready = Block(same, best), (row["a"], row["t"]), False
                if row["kind"] == 0:
                    block.add(row)
                elif block.parts or ready:
                    if not ready:
                        block.ready()
                        ready = True
                    block.meet(row)
        if ready:
            yield block.results()

    return scan


def _met(anchors: DataFrame, rows: DataFrame, blocks: int, stretches: int, same: bool, best: int) -> DataFrame:
    """key, slot, score, id: the best of each slot over all rows. anchors: key, id, label, v, edges."""
    both = anchors.mapInArrow(_pack(0, blocks, stretches), PACKED).unionByName(rows.mapInArrow(_pack(1, blocks, stretches), PACKED))
    dealt = both.repartition(blocks * stretches, "a", "t").sortWithinPartitions("a", "t", "kind")
    found = dealt.mapInArrow(_scan(same, best), FOUND)
    rank = F.row_number().over(Window.partitionBy("key", "slot").orderBy(F.col("score").desc(), "id"))
    return found.withColumn("rank", rank).filter(F.col("rank") <= best)


def _share(score: Column, percent: int, up: bool) -> Column:
    """score * percent / 100, rounded down or up, in whole numbers."""
    down = lambda x: F.call_function("div", x - F.pmod(x, F.lit(100)), F.lit(100).cast("long"))
    return -down(-score * percent) if up else down(score * percent)


def hard_negatives(table: DataFrame) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score."""
    rows = vectors(table)
    key = F.monotonically_increasing_id()
    anchors = stored(rows.filter(F.col("id") % ANCHOR_EVERY == 0).withColumn("key", key), "anchors")
    n, asked = rows.count(), anchors.count()
    blocks = max(1, -(-asked // ANCHORS))
    length = max(LEAST_STRETCH, min(STRETCH, PRODUCTS // max(1, min(asked, ANCHORS))))
    stretches = max(1, -(-n // length))
    everything = F.array(F.lit(-NEVER), F.lit(NEVER)).alias("edges")
    positives = stored(_met(anchors.select("key", "id", "label", "v", everything), rows, blocks, stretches, True, POSITIVES), "positives")
    windows = positives.groupBy("key").agg(F.sort_array(F.collect_list(F.struct("rank", "score", "id"))).alias("positives"))
    top = F.transform("positives", lambda p: _share(p["score"], HIGH, False))
    bottom = F.array_min(F.transform("positives", lambda p: _share(p["score"], LOW, True))) - 1
    last = F.least(bottom, F.element_at(top, -1))
    edges = F.concat(top, F.array_repeat(last, POSITIVES + 1 - F.size(top)))
    known = stored(anchors.join(windows, "key").withColumn("edges", edges), "windows")
    found = stored(_met(known.select("key", "id", "label", "v", "edges"), rows, blocks, stretches, False, NEGATIVES), "negatives")
    discard(positives)
    listed = found.groupBy("key").agg(F.sort_array(F.collect_list(F.struct("slot", (-F.col("score")).alias("less"), F.col("id").alias("negative")))).alias("all"))
    pairs = known.join(listed, "key").select(F.col("id").alias("anchor_id"), "all", F.posexplode("positives").alias("window", "p"))
    low = _share(F.col("p.score"), LOW, True)
    fits = F.slice(F.filter("all", lambda x: (x["slot"] >= F.col("window")) & (-x["less"] >= low)), 1, NEGATIVES)
    named = lambda c: F.when(c != NO_ID, c)
    return pairs.select("anchor_id", named(F.col("p.id")).alias("positive_id"), F.col("p.score").alias("positive_score"), F.posexplode(fits).alias("place", "x")).select(
        "anchor_id", "positive_id", (F.col("place") + 1).cast("int").alias("rank"), named(F.col("x.negative")).alias("negative_id"), "positive_score", (-F.col("x.less")).alias("negative_score")
    )
