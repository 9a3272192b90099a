"""Small tables with the awkward cases: nulls, empty and long texts, ties, repeated rows, more columns."""

from __future__ import annotations

DOC = "doc_id long, text string, lang string, source string, n_chars long, score double, rows long"


def documents(spark, texts, sources=("a", "b", None)):
    rows = [(i, t, "en", sources[i % len(sources)], None if t is None else len(t), 0.5, 7) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, DOC)


def awkward(spark):
    long = " ".join(f"word{i}" for i in range(30_000))
    some = ["", None, "one", "one", "two words", " \t\n ", "naïve café — 東京 😀", long, "token = abcdefgh12345", "a\u0000b", None]
    docs = documents(spark, some)
    return docs.union(docs.where("doc_id = 4")).union(spark.createDataFrame([(None, "no id", None, None, 5, 0.1, 1)], DOC))


def empty(spark):
    return spark.createDataFrame([], DOC)
