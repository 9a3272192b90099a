"""Fill-in-middle outputs against Python's re, and undone."""

from __future__ import annotations

import hashlib
import re

from edges import DOC, awkward, empty
from pyspark.sql import functions as F

from eventloom.llm import fim


def by_hand(id, text, seed=1, transformed=90, suffix_first=20):
    """n, form, output, prefix, middle."""
    text = text or ""
    units = re.findall(r"[A-Za-z]+|[^A-Za-z]", text, re.S)
    digest = hashlib.sha256(f"{seed}:{'' if id is None else id}".encode()).hexdigest()
    h = [int(digest[8 * i : 8 * i + 8], 16) for i in range(4)]
    low, high = sorted(x % (len(units) + 1) for x in h[:2])
    pre, mid, post = ("".join(x) for x in (units[:low], units[low:high], units[high:]))
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= transformed:
        return len(units), "plain", text, None, None
    if h[3] % 100 < suffix_first:
        return len(units), "spm", f"<S>{post}<P>{pre}<M>{mid}", pre, mid
    return len(units), "psm", f"<P>{pre}<S>{post}<M>{mid}", pre, mid


def sha(x):
    return hashlib.sha256(x.encode()).hexdigest()


def check(docs):
    want = []
    for r in docs.select("doc_id", "text").collect():
        n, form, out, pre, mid = by_hand(r["doc_id"], r["text"])
        want.append(repr((r["doc_id"], n, form, None if pre is None else len(pre), None if mid is None else len(mid), sha(out), sha(r["text"] or ""))))
    names = ("doc_id", "n", "form", "prefix_chars", "middle_chars", "output_sha256", "restored_sha256")
    assert sorted(repr(tuple(r[c] for c in names)) for r in fim.digests(docs).collect()) == sorted(want)


MARKED = ["<P>", "a <S> b", "x<M", "<", "<<S", "S>", "P>x<", "line\nnext\r\n end", "é<P", "\u0000a\u0000", "ǅ İ ſ K", "🙂🙂 a"]


def test_awkward(spark):
    check(awkward(spark))


def test_marks_and_signs(spark):
    rows = [(100 * k + i, t, "en", "a", 1, 0.5, 1) for k in range(40) for i, t in enumerate(MARKED)]
    check(spark.createDataFrame(rows, DOC))


def test_table(spark):
    check(spark.read.parquet("/root/testdata/sf0.001/documents.parquet"))


def test_long_texts(spark):
    """Texts that are cut in pieces: words, no letters at all, one word, signs of several bytes, a mark."""
    some = ["word, longer " * 100_000, "é東🙂 " * 200_000, "x" * 1_200_000, "12 ab\n" * 250_000 + "<P>", ("y" * 400_000 + " ") * 4]
    check(spark.createDataFrame([(10 * k + i, t, "en", "a", 1, 0.5, 1) for k in range(3) for i, t in enumerate([*some, "short", None])], DOC))


def test_empty(spark):
    assert fim.digests(empty(spark)).count() == 0 and fim.fill_in_middle(empty(spark)).count() == 0


def test_outputs_and_back(spark):
    """Other columns of any kind and clashing names pass; the texts are outputs, and come back."""
    docs = awkward(spark).select("*", F.lit("mine").alias("form"), F.lit("x").alias("whole"), F.lit("y").alias("hash"), F.array(F.lit(1.5)).alias("c0"), F.lit("z").alias("prefix"))
    made = fim.fill_in_middle(docs, seed=7, transformed=100, suffix_first=50)
    assert made.columns == [c for c in docs.columns if c != "form"] + ["n", "form"]
    got = sorted((str(r["doc_id"]), r["text"], r["n"], r["form"], r["whole"], r["c0"], r["score"]) for r in made.collect())
    want = []
    for r in docs.collect():
        n, form, out, _, _ = by_hand(r["doc_id"], r["text"], 7, 100, 50)
        want.append((str(r["doc_id"]), out, n, form, "x", [1.5], r["score"]))
    assert got == sorted(want) and {"psm", "spm", "plain"} == {x[3] for x in got}
    back = fim.restored(made)
    assert sorted((str(r["doc_id"]), r["text"]) for r in back.collect()) == sorted((str(r["doc_id"]), r["text"] or "") for r in docs.collect())
