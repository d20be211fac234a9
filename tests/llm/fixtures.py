"""Small documents: near and exact copies, ties, repeated rows, nulls, empty and long texts, names that clash."""

import random

from pyspark.sql import functions as F


def prose(rng, n):
    return " ".join(rng.choice(["the", "of", "and"]) if rng.random() < 0.2 else "".join(rng.choice("abcdefghilmnorstuvé") for _ in range(rng.randrange(2, 9))) for _ in range(n))


def changed(rng, text, n):
    w = text.split(" ")
    for _ in range(n):
        w[rng.randrange(len(w))] = prose(rng, 1)
    return " ".join(w)


def documents(seed=3):
    """(doc_id, text, source)"""
    rng = random.Random(seed)
    out = []
    for _ in range(25):
        text = "\n".join(prose(rng, rng.randrange(5, 90)) for _ in range(rng.randrange(1, 5)))
        out.append(text)
        for k in range(rng.randrange(0, 4)):
            out.append(changed(rng, text, k * 3))
    for n in (1, 2, 3, 4, 5, 6, 7, 8, 9, 12):
        t = prose(rng, n)
        out += [t, t.upper(), t + " " + prose(rng, 1)]
    out += ["", " \n\t ", None, None, "a", "a b c a b c a b c a b c", prose(rng, 4000), "x" * 30_000, "\n".join(["same line here again"] * 5)]
    rows = [(i, t, f"s{i % 3}" if i % 7 else None) for i, t in enumerate(out)]
    return [*rows, rows[0], rows[0], (None, out[1], "s1"), (5, out[2], "s2")]


def frame(spark, rows=None, clash=True):
    df = spark.createDataFrame(documents() if rows is None else rows, "doc_id long, text string, source string").repartition(3)
    if clash:
        for name in ("id", "n", "node", "h", "root", "size", "row", "a b", "key", "items", "copies", "lang"):
            df = df.withColumn(name, F.lit("clash"))
    return df
