"""Near copies by fingerprints with pivot tables, decided by the Jaccard similarity of word shingles.

Two texts are linked if the sets of their 5-word shingles (64-bit hashes of the lower-case words) have a similarity of
0.8 or more, counted exactly.  Equal sets are one node.  Candidates meet in two kinds of buckets.  The first are operator 6's
components: fingerprints within 2 bits, by blocks, distances to pivots and verification (simhash).  Most texts alike by 0.8
differ by more bits, some 10, so the second are those of minhash bands: 24 bands of 5 values each miss a pair at 0.8 with a
chance of 7 in 100,000, and closer pairs with less.  How the nodes of a bucket are compared, without all pairs of a
crowded one, is in set_links.

Cases: fewer than five words are one shingle; null, empty and blank texts are one node; a null doc_id never names a
component unless all members are null; an empty table gives an empty result; extra columns are not read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vocalith.llm import set_links, simhash
from vocalith.llm.common import discard, stored, utf8
from vocalith.llm.simhash import SEED

SHINGLE = 5
#: The least similarity, as a fraction.
NUM, DEN = 4, 5
BANDS, VALUES = 24, 5
SLICE = 1 << 12


def _coefficients():
    import numpy as np
    import xxhash

    draw = [xxhash.xxh64_intdigest(f"minhash {i}", SEED) for i in range(2 * BANDS * VALUES)]
    return np.array(draw[::2], np.uint64) | np.uint64(1), np.array(draw[1::2], np.uint64)


def bands(h, factors, terms) -> list[int]:
    """A signed 64-bit key for each band; none for the empty set."""
    import numpy as np
    import xxhash

    if not len(h):
        return []
    low = np.full(len(factors), np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(h), SLICE):
        low = np.minimum(low, (h[at : at + SLICE, None] * factors + terms).min(axis=0))
    keys = np.array([xxhash.xxh64_intdigest(v.tobytes(), i) for i, v in enumerate(low.astype("<u8").reshape(BANDS, VALUES))], np.uint64)
    return keys.view(np.int64).tolist()


def sketches(docs: DataFrame) -> DataFrame:
    """doc_id, tkey, node (stands for the set), print (the fingerprint's bits as a signed long), keys."""

    def sketched(batches):
        import pyarrow as pa

        factors, terms = _coefficients()
        for batch in batches:
            texts = utf8(batch, "text")
            sets = [set_links.shingles(t, SHINGLE) for t in texts]
            columns = [
                batch.column("doc_id"), batch.column("tkey"), pa.array(map(set_links.node_of, sets), pa.int64()), pa.array(map(simhash.signed, texts), pa.int64()),
                pa.array([bands(h, factors, terms) for h in sets], pa.list_(pa.int64())),
            ]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "tkey", "node", "print", "keys"])

    return set_links.with_text_key(docs).select("doc_id", "tkey", "text").mapInArrow(sketched, "doc_id long, tkey long, node long, print long, keys array<long>")


def dealt(marked: DataFrame) -> DataFrame:
    """key, node: operator 6's components, and minhash bands. marked: node, print, keys."""
    prints = stored(marked.select("node", "print").distinct(), "prints")
    roots = simhash.components(simhash.links(prints.select(F.col("print").alias("fp")).distinct())).withColumnRenamed("node", "print")
    linked = prints.join(roots, "print", "left").select(F.coalesce("root", "print").alias("key"), "node")
    return marked.select(F.explode("keys").alias("key"), "node").unionByName(linked)


def near_copies(docs: DataFrame) -> DataFrame:
    """doc_id, fp, root, component_id for each row: fp is its node, root the component's smallest node."""
    marked = stored(sketches(docs), "sketches")
    buckets = set_links.met(dealt(marked))
    sets = set_links.sets_of(docs, marked, buckets.select("node").distinct(), SHINGLE)
    joined = set_links.links(buckets, sets, NUM, DEN)
    discard(buckets, sets)
    return set_links.classes(marked.select("doc_id", "node"), joined)


def deduplicate(docs: DataFrame) -> DataFrame:
    """Exactly one row of docs for each component of near copies, as simhash.deduplicate does for fingerprints."""
    return simhash.deduplicate(docs, near_copies, lambda text: set_links.node_of(set_links.shingles(text, SHINGLE)))
