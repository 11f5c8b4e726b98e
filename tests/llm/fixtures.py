"""Small inputs that hold the awkward cases: nulls, empty texts, ties, repeated rows, clashing names."""

import random
import re

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def words(text):
    return WORD.findall(text or "")


def prose(seed, n, vocabulary=400):
    r = random.Random(seed)
    return " ".join(f"w{int(r.paretovariate(0.6)) % vocabulary}x{r.randrange(9)}" for _ in range(n))


def edited(text, seed, share):
    r = random.Random(seed)
    return " ".join(w if r.random() >= share else f"new{r.randrange(10**6)}" for w in text.split(" "))


def corpus():
    """(doc_id, text): near and exact copies, shared passages, repeated lines, and texts without words."""
    rows = [(1, None), (2, ""), (3, " \n\t "), (4, "one"), (5, "one"), (6, "ONE two"), (7, "one two"), (None, prose(1, 60)), (None, None)]
    base = [prose(s, 50 + 11 * s) for s in range(8)]
    for i, text in enumerate(base):
        rows.append((100 + 10 * i, text))
        rows += [(101 + 10 * i + j, edited(text, 7 * i + j, share)) for j, share in enumerate((0.0, 0.01, 0.03, 0.06, 0.3))]
    passage = prose(99, 60)
    rows += [(300 + i, f"{prose(200 + i, 30)}\n{passage}\n{prose(300 + i, 25)}") for i in range(4)]
    rows += [(310, f"{passage} {prose(410, 10)} {passage}"), (311, " ".join(["same"] * 90)), (312, prose(5, 3000))]
    rows += [(320 + i, edited(base[0], 900 + i, 0.05)) for i in range(40)]
    rows.append(rows[15])  # a row twice
    return rows


def frame(spark, rows=None):
    """The corpus with columns whose names clash with those that operators use."""
    from pyspark.sql import functions as F

    df = spark.createDataFrame(corpus() if rows is None else rows, "doc_id long, text string")
    return df.select("doc_id", "text", *(F.lit(1).alias(n) for n in ("kept", "length", "n_words", "component_id", "rest", "node", "piece")))
