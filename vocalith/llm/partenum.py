"""Exact Jaccard join of word-shingle sets by PartEnum signatures (Arasu, Ganti and Kaushik 2006).

Sizes fall into bands, such that sets alike by 9/10 or more are in one band or in neighbouring ones.  A set takes part in the
instance of its band and in the next one's, so such a pair shares an instance.  There, both sets differ in at most k
elements, k following from the band.  The domain of elements is cut into k // 2 + 1 parts, in one of which they differ in at most one element;
each part is cut into three, and a signature is made of two of these: one of the three subsets has no difference.  So a pair at
9/10 always shares a signature; what else shares one is counted exactly (set_links).

Cases: fewer than three words are one shingle of them all; null, empty and blank texts have an empty set and are linked with
nothing; a null doc_id never names a component unless all members are null; repeated rows are members of one component; an
empty table gives an empty result; extra columns are not read.
"""

from __future__ import annotations

from bisect import bisect_left
from functools import lru_cache
from itertools import combinations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vocalith.llm import set_links
from vocalith.llm.common import discard, stored, utf8

SHINGLE = 3
#: The least similarity, as a fraction.
NUM, DEN = 9, 10
#: Parts of the second level, and differences that one part of the first level may have.
PARTS, MISSED = 3, 1


def band_tops(num: int = NUM, den: int = DEN, largest: int = 1 << 40) -> list[int]:
    """The largest size of each band: no set of a band is alike to one beyond the next band."""
    tops, low = [], 1
    while low <= largest:
        tops.append(low * den // num)
        low = tops[-1] + 1
    return tops


_TOPS = band_tops()
#: Which parts a subset has: a column for each.
_SUBSETS = np.array([[i in subset for subset in combinations(range(PARTS), PARTS - MISSED)] for i in range(PARTS)], np.uint64)


@lru_cache(maxsize=None)
def _instance(number: int) -> tuple[int, np.ndarray]:
    """Cells of an instance, PARTS for each part of the first level, and a number for each signature; no cells where equal sets alone are alike."""
    k = 2 * _TOPS[number] * (DEN - NUM) // (DEN + NUM)
    first = k // (MISSED + 1) + 1 if k else 0
    place = np.arange(first * _SUBSETS.shape[1], dtype=np.uint64) + np.uint64(number << 40)
    return first * PARTS, set_links.mixed(place).reshape(first, _SUBSETS.shape[1])


def signatures(h: np.ndarray) -> np.ndarray:
    """Unsigned 64-bit signatures of a set of hashes; none where equal sets alone are alike."""
    out = [np.zeros(0, np.uint64)]
    if not len(h):
        return out[0]
    band = bisect_left(_TOPS, len(h))
    spread = set_links.mixed(h)
    low, high = (spread & np.uint64(0xFFFFFFFF)).astype(np.float64), (spread >> np.uint64(32)).astype(np.float64)
    for cells, place in map(_instance, (band, band + 1)):
        if cells:
            cell = (h % np.uint64(cells)).astype(np.int64)
            # sums of halves are whole numbers that a double holds
            halves = [np.bincount(cell, half, cells).astype(np.uint64) for half in (low, high)]
            sums = (halves[0] + (halves[1] << np.uint64(32))).reshape(-1, PARTS)
            out.append(set_links.mixed(sums @ _SUBSETS + place).ravel())
    return np.concatenate(out)


def sketches(docs: DataFrame) -> DataFrame:
    """doc_id, tkey, node (null for the empty set), n, keys (once for each node of a task)."""

    def sketched(batches):
        import pyarrow as pa

        seen: set[int] = set()
        for batch in batches:
            for at in range(0, len(batch), 512):
                part = batch.slice(at, 512)
                sets = [set_links.shingles(t, SHINGLE) for t in utf8(part, "text")]
                names = [set_links.node_of(h) if len(h) else None for h in sets]
                keys = []
                for h, name in zip(sets, names, strict=True):
                    keys.append(None if name is None or name in seen else signatures(h).view(np.int64))
                    seen.add(name)
                columns = [
                    part.column("doc_id"), part.column("tkey"), pa.array(names, pa.int64()), pa.array(map(len, sets), pa.int64()), pa.array(keys, pa.list_(pa.int64())),
                ]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "tkey", "node", "n", "keys"])

    return set_links.with_text_key(docs).select("doc_id", "tkey", "text").mapInArrow(sketched, "doc_id long, tkey long, node long, n long, keys array<long>")


def jaccard_components(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id for each row."""
    marked = stored(sketches(docs), "sketches")
    buckets = set_links.met(marked.filter("keys is not null").select("node", F.explode("keys").alias("key")))
    sets = set_links.sets_of(docs, marked, buckets.select("node").distinct(), SHINGLE)
    joined = set_links.links(buckets, sets, NUM, DEN)
    discard(buckets, sets)
    some = set_links.classes(marked.filter("node is not null").select("doc_id", "node", "n"), joined)
    bare = marked.filter("node is null").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"))
    return some.select("doc_id", F.col("n").alias("n_shingles"), "component_id").unionByName(bare)
