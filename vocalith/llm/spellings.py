"""Spelling variants of the corpus's words, by pivotal grams (after Deng, Li and Feng 2014).

Words are counted over all documents.  Bigrams are ordered by how many places of the vocabulary they have.  A word's prefix
is its three rarest bigrams (and those equal to the third); of them two disjoint ones of least total frequency, found by
dynamic programming, are its pivots.  One edit can't break both: of two words one edit apart, the one whose prefix ends
earlier in that order has a pivot that the other's prefix holds, at a place within one.  And the edit lies right of the later
pivot (all up to its end is whole), in it (all before and after it is whole, and so the earlier one), between the two or in
the earlier (all from the later one on is whole, and all before the earlier), or left of both (all from the earlier one on is).  So a word
is indexed by these four parts, with two letters of the other end where that must be whole too; words look up what starts
or ends with a gram of their prefixes; and what they meet is verified.  Nothing is missed.

A word's form is the near word of largest count, if that is FACTOR times the word's or more; counts grow along forms, so there
are no cycles, and the last form is found by doubling.

Cases: null and empty texts have no words; a null doc_id counts as the text ""; repeated rows count each on its own; equal
counts go to the word that is smaller in code-point order; an empty table gives an empty result; extra columns are not read.
"""

from __future__ import annotations

import zlib
from bisect import bisect_right

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vocalith.llm.common import discard, lower_ascii, stored

#: Letters of a word, after A-Z are lower-cased: 26 + 64, so that there are 8,100 bigrams at most.
LETTERS = "[a-zÀ-ÿ]+"
#: One of so many runs of a document loses a letter.
DAMAGED = 199
LEAST_LENGTH, LEAST_COUNT, FACTOR = 6, 5, 5
#: Places of a word's prefix: two for the gram's length, one more.
PREFIX = 3
#: Letters of the other end in a key.
ENDS = 2
#: Words that look up a key in one task.
SPLIT = 1024


def damaged(doc_id, run):
    """The run, or the run without the letter that its hash names, where DAMAGED divides the hash of both."""
    h = F.crc32(F.concat(F.coalesce(doc_id.cast("string"), F.lit("")), F.lit(":"), run))
    at = (h % F.length(run)).cast("int")
    return F.when(h % DAMAGED == 0, F.concat(F.substr(run, F.lit(1), at), F.substr(run, at + 2))).otherwise(run)


def word_counts(docs: DataFrame, least_length: int = LEAST_LENGTH, least_count: int = LEAST_COUNT) -> DataFrame:
    """word, n. Counts are combined before the shuffle, so a word that is everywhere is one row for each task."""
    runs = docs.select("doc_id", F.explode(F.regexp_extract_all(lower_ascii(F.col("text")), F.lit(f"({LETTERS})"), 1)).alias("run"))
    words = runs.select(damaged(F.col("doc_id"), F.col("run")).alias("word")).filter(F.length("word") >= least_length)
    return words.groupBy("word").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= least_count)


def pivotal(places: list[int], costs: list[int], count: int = 2) -> tuple[int, ...]:
    """The `count` disjoint bigrams of least total cost. places: where bigrams begin, ascending."""
    none = (float("inf"), ())
    best = [(0, ())] * (len(places) + 1)
    for _ in range(count):
        now = [none]
        for i, (place, cost) in enumerate(zip(places, costs, strict=True)):
            total, chosen = best[bisect_right(places, place - 2)]
            now.append(min(now[-1], (total + cost, (*chosen, place))))
        best = now
    return best[-1][1]


def keys(word: str, frequency: dict[str, int]) -> tuple[list[int], list[int]]:
    """(indexed, looked up): numbers of parts of a word from its start or to its end."""
    grams = sorted((frequency[word[i : i + 2]], word[i : i + 2], i) for i in range(len(word) - 1))
    last = grams[min(PREFIX, len(grams)) - 1][:2]
    cost = {i: f for f, g, i in grams if (f, g) <= last}
    prefix = sorted(cost)
    pivots = pivotal(prefix, [cost[i] for i in prefix])
    size = len(word)
    left, right = [0], [0]
    for crcs, letters in ((left, word), (right, word[::-1])):
        for c in letters:
            crcs.append(zlib.crc32(c.encode(), crcs[-1]))

    def start(n: int, t: int) -> int:
        """The first n letters and the last t."""
        return n << 35 | t << 33 | zlib.crc32(word[size - t :].encode(), left[n]) << 1

    def end(n: int, t: int) -> int:
        return n << 35 | t << 33 | zlib.crc32(word[:t].encode(), right[n]) << 1 | 1

    a, b = pivots
    indexed = [start(b + 2, 0), start(b, min(ENDS, size - b - 2)), end(size - b, min(ENDS, a)), end(size - a, 0)]
    starts = [start(n, t) for n in range(prefix[0] + 2, size + 1) for t in range(min(ENDS, size - n) + 1)]
    return indexed, [*starts, *(end(size - i, t) for i in prefix for t in range(min(ENDS, i) + 1))]


def _keyed(words: DataFrame) -> DataFrame:
    """word, n, indexed, asked."""
    grams = words.select(F.explode(F.transform(F.sequence(F.lit(1), F.length("word") - 1), lambda i: F.substr("word", i, F.lit(2)))).alias("gram"))
    frequency = {r.gram: r.n for r in grams.groupBy("gram").agg(F.count(F.lit(1)).alias("n")).collect()}  # bounded by the letters

    def keyed(batches):
        import pyarrow as pa

        for batch in batches:
            both = [keys(w, frequency) for w in batch.column("word").to_pylist()]
            columns = [*batch.columns, *[pa.array([b[i] for b in both], pa.list_(pa.int64())) for i in (0, 1)]]
            yield pa.RecordBatch.from_arrays(columns, ["word", "n", "indexed", "asked"])

    return words.select("word", "n").mapInArrow(keyed, "word string, n long, indexed array<long>, asked array<long>")


def near_words(words: DataFrame) -> DataFrame:
    """(word, n, other, other_n): both directions of each pair of words that one inserted, deleted or replaced letter tells apart.

    words: word, n; of four letters or more, so that a word has three bigrams.
    """
    keyed = stored(_keyed(words), "keyed")
    asked = keyed.select("word", "n", F.explode(F.array_distinct("asked")).alias("key"))
    crowds = asked.groupBy("key").agg(F.ceil(F.count(F.lit(1)) / SPLIT).cast("int").alias("parts"), F.count(F.lit(1)).alias("crowd")).filter("crowd > 1")
    asked = asked.select(F.col("word").alias("other"), F.col("n").alias("other_n"), "key").join(crowds, "key")
    asked = asked.withColumn("part", F.pmod(F.xxhash64("other"), F.col("parts")).cast("int"))
    indexed = keyed.select("word", "n", F.explode(F.array_distinct("indexed")).alias("key")).join(crowds, "key")
    indexed = indexed.select("word", "n", "key", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))
    near = (F.abs(F.length("word") - F.length("other")) <= 1) & (F.levenshtein("word", "other", 1) == 1)
    met = indexed.join(asked.select("other", "other_n", "key", "part"), ["key", "part"]).filter(near).select("word", "n", "other", "other_n")
    back = met.select(F.col("other").alias("word"), F.col("other_n").alias("n"), F.col("word").alias("other"), F.col("n").alias("other_n"))
    found = stored(met.unionByName(back).distinct(), "near")
    discard(keyed)
    return found


def roots(forms: DataFrame) -> DataFrame:
    """(word, root): from each word along the forms (word, form) to the last; each round doubles the steps."""
    found = stored(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        on = found.select(F.col("word").alias("root"), F.col("root").alias("next"))
        joined = stored(found.join(on, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "roots")
        discard(found)
        found = joined.select("word", "root")
        if joined.filter("moved").isEmpty():
            return found


def variants(docs: DataFrame) -> DataFrame:
    """word, form, root, n, n_near, form_n of all words of docs."""
    words = stored(word_counts(docs), "words")
    near = near_words(words)
    best = F.min(F.struct((-F.col("other_n")).alias("less"), "other"))
    most = near.groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), best.alias("best"))
    form = F.col("best.less") <= -FACTOR * F.col("n")
    known = stored(
        words.join(most, "word", "left").select(
            "word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(form, F.col("best.other")).alias("form"), F.when(form, -F.col("best.less")).alias("form_n")
        ),
        "forms",
    )
    last = roots(known.filter("form is not null").select("word", "form"))
    discard(near)
    return known.join(last, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
