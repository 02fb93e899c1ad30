"""SimHash near-duplicates with pivot distance tables.

A text's fingerprint takes the majority of each bit over the 64-bit hashes of its 3-word shingles.  Equal
fingerprints are one node, with the smallest doc_id as its representative, so copies never meet in pairs.

Distances to a pivot differ by at most 2 for a pair within 2 bits, but that keeps a third of all pairs for each
pivot, so pivots alone can't deal the work out.  Nodes are therefore first dealt to buckets: of five blocks of a
fingerprint, two differing bits leave three alike, which gives ten keys.  Inside a bucket the table of distances to
16 reference fingerprints discards a pair if any coordinate differs by more than 2, and the survivors are verified.
A bucket streams through its task; one that passes a bound is not compared but solved exactly in another way: all its
fingerprints are sent, with each bit flipped in turn, to the 65 values within one bit, and those that meet are within
two.  Groups there have at most 65 members.

Links inside a bucket shrink to a forest, and components follow from alternating large and small stars, whose tables
are written to the shared folder each round.

Cases: a null, empty or blank text has fingerprint zero and is linked like any other; fewer than three words are one
shingle; repeated rows are in one component; a null doc_id never names a component unless all members are null;
an empty table gives an empty result; extra columns are not read.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vocalith.llm.common import discard, stored, utf8

SEED = 42
SHINGLE = 3
DISTANCE = 2
PIVOTS = 16
BLOCKS = (13, 13, 13, 13, 12)
ALIKE = 3
BUCKET = 2048
SLICE = 1 << 16


def fingerprint(text: bytes) -> int:
    """Unsigned 64 bits. bytes.lower and bytes.split know ASCII only, as asked for."""
    import numpy as np
    import xxhash

    w = text.lower().split()
    if not w:
        return 0
    digest = xxhash.xxh64_intdigest
    shingles = [b" ".join(w)] if len(w) < SHINGLE else map(b" ".join, zip(w, w[1:], w[2:], strict=False))
    h = np.fromiter((digest(s, SEED) for s in shingles), np.uint64)
    ones = np.zeros(64, np.int64)
    for at in range(0, len(h), SLICE):
        part = h[at : at + SLICE]
        ones += np.unpackbits(part.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(h), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, fp (the bits as a signed long)."""

    def hashed(batches):
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            fp = np.array([fingerprint(t) for t in utf8(batch, "text")], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(fp.view(np.int64))], ["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(hashed, "doc_id long, fp long")


def _masks() -> list[int]:
    starts = [sum(BLOCKS[:i]) for i in range(len(BLOCKS))]
    blocks = [((1 << n) - 1) << s for n, s in zip(BLOCKS, starts, strict=True)]
    masks = [sum(c) for c in combinations(blocks, ALIKE)]
    return [m - (1 << 64) if m >> 63 else m for m in masks]


def _pivots():
    import numpy as np
    import xxhash

    return np.array([xxhash.xxh64_intdigest(f"pivot {i}", SEED) for i in range(PIVOTS)], np.uint64)


def _forest(a, b):
    """Links of each connected group to its smallest member, by repeated minima."""
    import numpy as np

    nodes, inverse = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = inverse[: len(a)], inverse[len(a) :]
    label = np.arange(len(nodes))
    while True:
        low = np.minimum(label[x], label[y])
        new = label.copy()
        np.minimum.at(new, x, low)
        np.minimum.at(new, y, low)
        new = new[new]
        if (new == label).all():
            break
        label = new
    moved = label != np.arange(len(nodes))
    return nodes[label[moved]], nodes[moved]


def _pairs(band, key, fp, pivots):
    """Pairs of one bucket within DISTANCE bits: neighbours 1, 2, ... rows apart while the bucket lasts."""
    import numpy as np

    left, right = [], []
    here = np.arange(len(fp) - 1)
    here = here[(band[here] == band[here + 1]) & (key[here] == key[here + 1])]
    if not len(here):
        return fp[:0], fp[:0]
    u = fp.view(np.uint64)
    members = np.unique(np.concatenate([here, here + 1]))
    table = np.zeros((len(fp), PIVOTS), np.int8)
    table[members] = np.bitwise_count(u[members, None] ^ pivots[None, :])
    step = 1
    while len(here):
        near = (np.abs(table[here] - table[here + step]) <= DISTANCE).all(axis=1)
        kept = here[near]
        kept = kept[np.bitwise_count(u[kept] ^ u[kept + step]) <= DISTANCE]
        left.append(fp[kept])
        right.append(fp[kept + step])
        step += 1
        here = here[here + step < len(fp)]
        here = here[(band[here] == band[here + step]) & (key[here] == key[here + step])]
    return _forest(np.concatenate(left), np.concatenate(right))


def _bucket_links(batches):
    """(a, b, crowded): links of buckets that fit the bound; members of the others, b null."""
    import numpy as np
    import pyarrow as pa

    pivots = _pivots()
    held = [np.zeros(0, np.int32), np.zeros(0, np.int64), np.zeros(0, np.int64)]
    crowded = None

    def out(a, b, full):
        return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(np.full(len(a), full))], ["a", "b", "crowded"])

    def solve(band, key, fp):
        edges = np.flatnonzero((np.diff(band) != 0) | (np.diff(key) != 0)) + 1
        starts, ends = np.concatenate([[0], edges]), np.concatenate([edges, [len(fp)]])
        large = ends - starts > BUCKET
        drop = np.zeros(len(fp), bool)
        for s, e in zip(starts[large], ends[large], strict=True):
            drop[s:e] = True
        full = np.unique(fp[drop])
        if len(full):
            yield out(full, full, True)
        a, b = _pairs(band[~drop], key[~drop], fp[~drop], pivots)
        if len(a):
            yield out(a, b, False)

    for batch in batches:
        new = [batch.column(n).to_numpy(zero_copy_only=False) for n in ("band", "key", "fp")]
        if crowded is not None:  # the rest of a bucket that already passed the bound
            same = (new[0] == crowded[0]) & (new[1] == crowded[1])
            if same.any():
                full = np.unique(new[2][same])
                yield out(full, full, True)
                new = [x[~same] for x in new]
            if not len(new[0]):
                continue
            crowded = None
        band, key, fp = (np.concatenate(x) for x in zip(held, new, strict=True))
        cut = int(np.flatnonzero((band != band[-1]) | (key != key[-1]))[-1]) + 1 if ((band != band[-1]) | (key != key[-1])).any() else 0
        if cut:
            yield from solve(band[:cut], key[:cut], fp[:cut])
        held = [band[cut:], key[cut:], fp[cut:]]
        if len(held[2]) > BUCKET:
            crowded = (band[-1], key[-1])
            yield from solve(*held)
            held = [x[:0] for x in held]
    if len(held[2]):
        yield from solve(*held)


def links(nodes: DataFrame) -> DataFrame:
    """(a, b): a forest over the distinct fingerprints within DISTANCE bits, bucket by bucket."""
    keys = F.array(*[F.struct(F.lit(i).alias("band"), F.col("fp").bitwiseAND(F.lit(m)).alias("key")) for i, m in enumerate(_masks())])
    dealt = nodes.select("fp", F.explode(keys).alias("k")).select("k.band", "k.key", "fp")
    found = stored(
        dealt.repartition("band", "key").sortWithinPartitions("band", "key", "fp").mapInArrow(_bucket_links, "a long, b long, crowded boolean"),
        "links",
    )
    flips = [F.lit(0).cast("long"), *[F.lit(1 << i if i < 63 else -(1 << 63)).cast("long") for i in range(64)]]
    crowd = found.filter("crowded").select(F.col("a").alias("fp")).distinct()
    near = crowd.select("fp", F.explode(F.array(*[F.col("fp").bitwiseXOR(x) for x in flips])).alias("z"))
    met = near.groupBy("z").agg(F.min("fp").alias("a"), F.collect_list("fp").alias("all")).filter(F.size("all") > 1)
    stars = met.select("a", F.explode("all").alias("b")).filter("a <> b")
    return found.filter("not crowded").select("a", "b").unionByName(stars).distinct()


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, root): connected components by alternating large and small stars; root is the smallest node."""

    def star(e: DataFrame, large: bool) -> DataFrame:
        both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b"))) if large else e.select(
            F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")
        )
        low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        seen = both.join(low, "a")
        moved = seen.filter(F.col("b") > F.col("a")) if large else seen
        out = moved.select(F.col("b").alias("a"), F.col("m").alias("b"))
        if not large:
            out = out.unionByName(low.select("a", F.col("m").alias("b")))
        return out.filter("a <> b").distinct()

    def state(e: DataFrame):
        return e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()

    current, before = edges.select("a", "b"), None
    for _ in range(rounds):
        last, current = current, stored(star(star(current, True), False), "stars")
        if before is not None:
            discard(last)
        if (now := state(current)) == before:
            break
        before = now
    else:
        raise RuntimeError("components have not settled")
    return current.select(F.col("a").alias("node"), F.col("b").alias("root"))


def _members(docs: DataFrame) -> DataFrame:
    """doc_id, fp, root, component_id for each row; root, the component's smallest fingerprint, is unique to it."""
    marked = stored(fingerprints(docs), "fingerprints")
    nodes = stored(marked.groupBy("fp").agg(F.min("doc_id").alias("first_id")), "nodes")
    roots = components(links(nodes.select("fp")))
    rooted = nodes.join(roots, nodes.fp == roots.node, "left").select("fp", "first_id", F.coalesce("root", "fp").alias("root"))
    least = rooted.groupBy("root").agg(F.min("first_id").alias("component_id"))
    return marked.join(rooted.join(least, "root").select("fp", "root", "component_id"), "fp")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, fp, component_id for each row."""
    return _members(docs).select("fp", "doc_id", "component_id")


def signed(text: bytes) -> int:
    fp = fingerprint(text)
    return fp - (1 << 64) if fp >> 63 else fp


def _with_fingerprint(docs: DataFrame, of) -> DataFrame:
    """docs and fp_."""

    def hashed(batches):
        import pyarrow as pa

        for batch in batches:
            fp = pa.array(map(of, utf8(batch, "text")), pa.int64())
            yield pa.RecordBatch.from_arrays([*batch.columns, fp], [*batch.schema.names, "fp_"])

    return docs.mapInArrow(hashed, T.StructType([*docs.schema.fields, T.StructField("fp_", T.LongType())]))


def deduplicate(docs: DataFrame, members_of=_members, fingerprint_of=signed) -> DataFrame:
    """Exactly one row of docs for each component: that of its smallest id (null last), then of the smallest fingerprint.

    An id that one row has finds it.  Rows without an id, or with a repeated one, are told apart by their fingerprints;
    of several with the same id and fingerprint one stays.  members_of gives the rows' doc_id, fp and root;
    fingerprint_of gives a text's fp.
    """
    members = stored(members_of(docs).select("doc_id", "fp", "root"), "members")
    first = members.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "fp")).alias("k"))
    keep = first.select(F.col("k.doc_id").alias("keep_"), F.col("k.fp").alias("keep_fp_"))
    several = members.filter("doc_id is not null").groupBy("doc_id").count().filter("count > 1").select(F.col("doc_id").alias("several_"))
    # rows travel as one column: theirs may have any names
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row_")
    own = docs.select(row, F.col("doc_id").cast("long").alias("id_"), F.col("text").alias("text"))
    plain = own.join(keep.join(several, F.col("keep_") == F.col("several_"), "left_anti"), F.col("id_") == F.col("keep_")).select("row_")
    unsure = own.filter("id_ is null").unionByName(own.join(several, F.col("id_") == F.col("several_"), "left_semi"))
    once = _with_fingerprint(unsure, fingerprint_of).dropDuplicates(["id_", "fp_"])
    met = once.join(keep, F.col("id_").eqNullSafe(F.col("keep_")) & (F.col("fp_") == F.col("keep_fp_")), "left_semi")
    return plain.unionByName(met.select("row_")).select("row_.*")
