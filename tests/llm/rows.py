"""Rows that every operator must bear."""

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
WORDS = "alpha beta gamma delta of the and to in that is with été ñandú über 42 x1".split()


def words(seed, n):
    r = random.Random(seed)
    return " ".join(r.choice(WORDS) + (r.choice(WORDS) if r.random() < 0.6 else "") for _ in range(n))


def hard_rows():
    """Null and empty texts, white space, repeated rows and ids, a null id, copies, near copies, a long text, no words."""
    base = words(1, 60)
    near = base.replace("alpha", "alphb", 1)
    passage = words(7, 30)
    texts = [
        (1, base), (2, base), (3, base.replace(" ", "  ")), (4, near), (5, None), (6, ""), (7, "   \n\t"), (8, "!!! ???"),
        (9, words(2, 40) + " " + passage + " " + words(3, 30)), (10, passage + ". " + words(4, 50)), (11, words(5, 4000)), (12, "hi"),
        (12, "hi"), (13, "one\ntwo"), (13, "other text of the same id"), (None, "no id here"), (None, base), (14, "naïve ☃ 漢字テスト " * 9),
        (15, "a" * 700), (16, "A" * 700), (17, "  x"), (18, "it's 'll don't 12345 $$$"),
    ]
    return [(i, t, None if k % 3 == 0 else "en", None if k % 4 == 0 else "s", None) for k, (i, t) in enumerate(texts)]


def frame(spark, rows=None):
    return spark.createDataFrame(hard_rows() if rows is None else rows, SCHEMA)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def clashing(df):
    """The same rows with columns named like the operators' own."""
    from pyspark.sql import functions as F

    names = ["digest", "content", "salt", "block", "score", "words", "term", "pos", "cell", "shard", "sha", "k", "label", "id", "text_key", "bands", "member"]
    return df.withColumns({n: F.lit(7) for n in names})
