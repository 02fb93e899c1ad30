"""Links between sets of word shingles that meet in the buckets of some signature.

Equal sets are one node, named by a hash.  Signatures (bands of minhash values, PartEnum subsets) deal nodes to buckets; here
the pairs of a bucket are asked about and counted exactly, without all pairs of a crowded one leaving a task:

1. each node asks about the smallest node of a bucket, of those that it meets the one that it meets most often;
2. buckets that still hold several components ask about their closest pairs across components, two for each node;
3. then about all pairs across components that the parity sketches admit.  A bucket where these are more than its nodes
   compares whole sets inside the task and lets out only the links that join components.

A parity sketch has a bit for each value of a hash: whether an odd number of elements has it.  The bits in which two sketches
differ are at most the elements in which the sets do, so a pair that the sketches reject is no link, and none is lost.
Buckets are compared in parts of PART nodes, each with all nodes that ask: those outside the bucket's largest component.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vocalith.llm.common import discard, stored, utf8
from vocalith.llm.simhash import SEED, components

#: Nodes that a task compares at once, and bytes of sketches at a time.
PART = 4096
SLICE_BYTES = 8 << 20
#: Rows of buckets that one call takes; small buckets share one.
ROWS = 1 << 13
#: Closest pairs of a node in the second turn.
CLOSEST = 2
#: Members that one copy of a star's centre is compared with.
SPREAD = 64
#: Bits of a parity sketch, at least and at most: twice the size between.
SKETCH_BITS = (6, 13)
#: Up to so many texts of nodes that meet others are sent to all executors by their hashes, 8 bytes each.
BROADCAST_TEXTS = 1 << 20
_M1, _M2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads them."""
    x = (x ^ (x >> np.uint64(31))) * _M1
    x = (x ^ (x >> np.uint64(29))) * _M2
    return x ^ (x >> np.uint64(32))


def shingles(text: bytes, words: int) -> np.ndarray:
    """The distinct hashes of the runs of so many lower-case words, sorted; of all words, if there are fewer."""
    import xxhash

    w = text.lower().split()
    if not w:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(xxhash.xxh64_intdigest, w), np.uint64, len(w))
    words = min(words, len(w))
    run = np.full(len(w) - words + 1, words, np.uint64)
    for i in range(words):
        run = mixed(run + h[i : i + len(run)])
    return np.unique(run)


def node_of(h: np.ndarray) -> int:
    """A signed 64-bit name of the set."""
    import xxhash

    x = xxhash.xxh64_intdigest(h.astype("<u8").tobytes(), SEED)
    return x - (1 << 64) if x >> 63 else x


def parity(h: np.ndarray) -> bytes:
    low, high = SKETCH_BITS
    bits = 1 << min(high, max(low, (2 * len(h)).bit_length()))
    odd = np.bincount((h & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").tobytes()


def sketch_table(sketches: list[bytes]) -> np.ndarray:
    """Sketches as rows of 64-bit words, folded to the width of the shortest: a half is xored to the other."""
    width = min(map(len, sketches))
    out = np.empty((len(sketches), width), np.uint8)
    for i, s in enumerate(sketches):
        row = np.frombuffer(s, np.uint8)
        while len(row) > width:
            row = row[: len(row) // 2] ^ row[len(row) // 2 :]
        out[i] = row
    return out.view(np.uint64)


def with_text_key(docs: DataFrame) -> DataFrame:
    """doc_id, text, tkey."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("tkey"))


def met(dealt: DataFrame) -> DataFrame:
    """key, node, first, crowd of the buckets with two nodes or more; dealt: key, node, repeated rows allowed."""
    same = Window.partitionBy("key")
    seen = dealt.select("key", "node", F.min("node").over(same).alias("first"), F.max("node").over(same).alias("last_"))
    once = seen.filter("first <> last_").groupBy("key", "node").agg(F.first("first").alias("first"))
    return stored(once.withColumn("crowd", F.count(F.lit(1)).over(same)), "met")


def sets_of(docs: DataFrame, marked: DataFrame, wanted: DataFrame, words: int) -> DataFrame:
    """node, n, ids, sketch of the wanted nodes. marked: node, tkey of all documents; only texts of wanted nodes are read again."""
    texts = stored(marked.join(wanted, "node", "left_semi").groupBy("node").agg(F.min("tkey").alias("tkey")).select("tkey").distinct(), "texts")
    chosen = F.broadcast(texts) if texts.count() <= BROADCAST_TEXTS else texts

    def hashed(batches):
        import pyarrow as pa

        seen: set[int] = set()
        for batch in batches:
            for at in range(0, len(batch), 256):
                new = {k: h for h in (shingles(t, words) for t in utf8(batch.slice(at, 256), "text")) if (k := node_of(h)) not in seen}
                seen |= new.keys()
                columns = [
                    pa.array(new, pa.int64()), pa.array([len(h) for h in new.values()], pa.int64()),
                    pa.array([h.view(np.int64) for h in new.values()], pa.list_(pa.int64())), pa.array(map(parity, new.values()), pa.binary()),
                ]
                yield pa.RecordBatch.from_arrays(columns, ["node", "n", "ids", "sketch"])

    again = with_text_key(docs).join(chosen, "tkey", "left_semi").select("text")
    return stored(again.mapInArrow(hashed, "node long, n long, ids array<long>, sketch binary").dropDuplicates(["node"]), "sets")


def similar(pairs: DataFrame, sets: DataFrame, num: int, den: int) -> DataFrame:
    """The pairs (a, b) whose sets are alike by num / den or more; a may be in many."""
    copies = pairs.groupBy("a").agg(F.ceil(F.count(F.lit(1)) / SPREAD).cast("int").alias("copies"))
    salted = pairs.join(copies, "a").withColumn("salt", F.pmod(F.xxhash64("b"), F.col("copies")).cast("int"))
    centres = sets.join(copies, sets.node == copies.a).select("a", "ids", F.explode(F.sequence(F.lit(0), F.col("copies") - 1)).alias("salt"))
    both = salted.select("a", "b", "salt").join(centres, ["a", "salt"]).join(sets.select(F.col("node").alias("b"), F.col("ids").alias("others")), "b")
    common = F.size(F.array_intersect("ids", "others"))
    return both.filter((num + den) * common >= num * (F.size("ids") + F.size("others"))).select("a", "b")


def _each_part(solve):
    """solve for each part of a bucket that the rows of a call hold."""

    def solved(rows):
        import pyarrow as pa

        rows = rows.sort_by([("key", "ascending"), ("part", "ascending")])
        key, part = rows.column("key").to_numpy(), rows.column("part").to_numpy()
        edges = [0, *(np.flatnonzero((np.diff(key) != 0) | (np.diff(part) != 0)) + 1).tolist(), len(key)]
        return pa.concat_tables([solve(rows.slice(a, b - a)) for a, b in zip(edges[:-1], edges[1:], strict=True)])

    return solved


def _by_part(placed: DataFrame, solve, schema: str) -> DataFrame:
    calls = max(1, placed.count() // ROWS)
    return placed.groupBy(F.pmod(F.xxhash64("key", "part"), F.lit(calls))).applyInArrow(_each_part(solve), schema)


def _admitted(group, num: int, den: int):
    """Row numbers (asking, other) and distances of the pairs of a part that sizes and sketches admit, across components."""
    n, root, home = (group.column(c).to_numpy(zero_copy_only=False) for c in ("n", "root", "home"))
    sketch = sketch_table(group.column("sketch").to_pylist())
    here = np.flatnonzero(home)
    out = [[np.zeros(0, np.int64)] for _ in range(3)]
    if not len(here):
        return [x[0] for x in out]
    who = np.flatnonzero(group.column("asks").to_numpy(zero_copy_only=False))
    step = max(1, SLICE_BYTES // (len(here) * sketch.shape[1] * 8))
    for at in range(0, len(who), step):
        i = who[at : at + step]
        away = np.bitwise_count(sketch[i, None, :] ^ sketch[None, here, :]).sum(axis=2, dtype=np.int64)
        both = n[i, None] + n[None, here]
        near = ((num + den) * away <= (den - num) * both) & (root[i, None] != root[None, here])
        near &= den * np.minimum(n[i, None], n[None, here]) >= num * np.maximum(n[i, None], n[None, here])
        x, y = np.nonzero(near)
        for o, v in zip(out, (i[x], here[y], away[x, y]), strict=True):
            o.append(v)
    return [np.concatenate(x) for x in out]


def _closest(num: int, den: int):
    """(a, b, away): each asking node's closest ones."""

    def closest(group):
        import pyarrow as pa

        x, y, away = _admitted(group, num, den)
        node = group.column("node").to_numpy()
        order = np.lexsort((node[y], away, x))
        x, y, away = x[order], y[order], away[order]
        kept = np.arange(len(x)) - np.searchsorted(x, x, "left") < CLOSEST
        return pa.table([pa.array(node[x[kept]]), pa.array(node[y[kept]]), pa.array(away[kept])], names=["a", "b", "away"])

    return closest


def _rest(num: int, den: int):
    """All pairs (a, b) of a part, or, where they are more than its nodes, the nodes of these pairs (a, its part; b null)."""

    def rest(group):
        import pyarrow as pa

        x, y, _ = _admitted(group, num, den)
        node, key, part = group.column("node").to_numpy(), group.column("key")[0].as_py(), group.column("part")[0].as_py()
        if len(x) <= len(node):
            a, b = np.minimum(node[x], node[y]), np.maximum(node[x], node[y])
            return pa.table([pa.array(a), pa.array(b), *[pa.nulls(len(a), t) for t in (pa.int64(), pa.int32())]], names=["a", "b", "key", "part"])
        some = np.unique(np.concatenate([x, y]))
        a = pa.array(node[some])
        return pa.table([a, pa.nulls(len(a), pa.int64()), pa.array([key] * len(a), pa.int64()), pa.array([part] * len(a), pa.int32())], names=["a", "b", "key", "part"])

    return rest


def _verified(num: int, den: int):
    """(a, b): links of a part whose rows have their sets. A pair is counted while its ends are in two components."""

    def verified(group):
        import pyarrow as pa

        x, y, _ = _admitted(group, num, den)
        node, root = group.column("node").to_numpy(), group.column("root").to_numpy()
        lists = group.column("ids").combine_chunks()
        flat, ends = lists.flatten().to_numpy(), lists.offsets.to_numpy() - lists.offsets[0].as_py()
        above: dict[int, int] = {}

        def top(r: int) -> int:
            while (up := above.get(r, r)) != r:
                above[r] = r = above.get(up, up)
            return r

        left, right = [], []
        for i, j in zip(x.tolist(), y.tolist(), strict=True):
            if (p := top(int(root[i]))) == (q := top(int(root[j]))):
                continue
            one, other = flat[ends[i] : ends[i + 1]], flat[ends[j] : ends[j + 1]]
            common = len(np.intersect1d(one, other, assume_unique=True))
            if (num + den) * common >= num * (len(one) + len(other)):
                above[p] = q
                left.append(int(node[i]))
                right.append(int(node[j]))
        return pa.table([pa.array(left, pa.int64()), pa.array(right, pa.int64())], names=["a", "b"])

    return verified


def _placed(buckets: DataFrame, found: DataFrame, sets: DataFrame) -> DataFrame:
    """Buckets of several components in parts: key, part, node, n, sketch, root, asks, home."""
    roots = components(found)
    rooted = stored(buckets.join(roots, "node", "left").select("key", "node", "crowd", F.coalesce("root", "node").alias("root")), "rooted")
    shares = rooted.groupBy("key", "root").agg(F.count(F.lit(1)).alias("share"))
    main = shares.groupBy("key").agg(F.max_by("root", F.struct("share", "root")).alias("main"), F.count(F.lit(1)).alias("roots")).filter("roots > 1").drop("roots")
    parts = F.ceil(F.col("crowd") / PART).cast("int")
    own = F.pmod(F.xxhash64("node", "key"), parts).cast("int")
    asking = rooted.join(main, "key").withColumn("asks", F.col("root") != F.col("main")).withColumn("own_", own)
    dealt = asking.withColumn("part", F.explode(F.when(F.col("asks"), F.sequence(F.lit(0), parts - 1)).otherwise(F.array("own_"))))
    return dealt.withColumn("home", F.col("part") == F.col("own_")).join(sets.select("node", "n", "sketch"), "node").select("key", "part", "node", "n", "sketch", "root", "asks", "home")


def links(buckets: DataFrame, sets: DataFrame, num: int, den: int) -> DataFrame:
    """(a, b): links that join all nodes with a path of sets alike by num / den or more. buckets: see met; sets: see sets_of."""
    stars = buckets.filter("node <> first").groupBy("node", "first").agg(F.count(F.lit(1)).alias("times"))
    pairs = stars.groupBy("node").agg(F.max_by("first", F.struct("times", "first")).alias("a")).select("a", F.col("node").alias("b"))
    found = stored(similar(pairs, sets, num, den), "similar")
    placed = stored(_placed(buckets, found, sets), "placed")
    asked = _by_part(placed, _closest(num, den), "a long, b long, away long")
    near = asked.groupBy("a", "b").agg(F.min("away").alias("away"))
    rank = F.row_number().over(Window.partitionBy("a").orderBy("away", "b"))
    near = near.withColumn("rank", rank).filter(F.col("rank") <= CLOSEST).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    found = stored(found.unionByName(similar(near, sets, num, den)), "similar")
    discard(placed)
    placed = stored(_placed(buckets, found, sets), "placed")
    rest = stored(_by_part(placed, _rest(num, den), "a long, b long, key long, part int"), "rest")
    few = similar(rest.filter("b is not null").select("a", "b").distinct(), sets, num, den)
    dense = rest.filter("b is null").select("key", "part", F.col("a").alias("node")).distinct()
    whole = placed.join(dense, ["key", "part", "node"]).join(sets.select("node", "ids"), "node")
    many = whole.groupBy("key", "part").applyInArrow(_verified(num, den), "a long, b long")
    out = stored(found.unionByName(few).unionByName(many).distinct(), "similar")
    discard(placed, rest, found)
    return out


def classes(marked: DataFrame, joined: DataFrame) -> DataFrame:
    """doc_id, fp, root, component_id for each row of marked (doc_id, node): fp is its node, root the component's smallest node."""
    nodes = marked.groupBy("node").agg(F.min("doc_id").alias("first_id"))
    roots = components(joined).withColumnRenamed("node", "moved_")
    rooted = nodes.join(roots, F.col("node") == F.col("moved_"), "left").select("node", "first_id", F.coalesce("root", "node").alias("root"))
    rooted = stored(rooted, "nodes")
    least = rooted.groupBy("root").agg(F.min("first_id").alias("component_id"))
    named = rooted.join(least, "root").select(F.col("node").alias("fp"), "root", "component_id")
    return marked.select("doc_id", F.col("node").alias("fp"), *[c for c in marked.columns if c not in ("doc_id", "node", "fp")]).join(named, "fp")
