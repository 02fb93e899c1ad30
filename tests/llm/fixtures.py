"""Small documents with the cases that every operator defines: nulls, empty, blank, very long, ties, repeated rows."""

import random

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long, words_ string, size long"
WORDS = "the of and that river stone keeps turning under old bridges while seven grey herons wait for evening rain over quiet fields".split()


def sentence(rng: random.Random, n: int) -> str:
    return " ".join(rng.choice(WORDS) + str(rng.randrange(60)) for _ in range(n))


def rows() -> list[tuple]:
    rng = random.Random(7)
    texts: list = [None, "", "  \n\t ", "one two", "a", "x" * 700, "Ünïcode ßtraße — 日本語 テスト end", "a\n\na\na\n b"]
    base = [sentence(rng, 80) for _ in range(6)]
    texts += base
    texts += [base[0], base[0], base[1] + " and one more word", base[2].replace("river", "brook", 1)]
    shared = sentence(rng, 40)
    texts += [f"{sentence(rng, 30)} {shared} {sentence(rng, 30)}" for _ in range(4)]
    texts += [sentence(rng, 9_000), "again and again " * 200, "!!! *** ### $$$ " * 40]
    out = [(i, t, "en", None if i % 5 == 0 else f"s{i % 4}", len(t or ""), "clash", 5) for i, t in enumerate(texts)]
    return [*out, out[9], (None, base[3], None, None, None, None, None)]


def docs(spark, some=None):
    return spark.createDataFrame(rows() if some is None else some, COLUMNS)


def empty(spark):
    return docs(spark, [])
