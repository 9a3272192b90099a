"""Manifests against a plain version in lists, on awkward tables and with other fanouts."""

from __future__ import annotations

import hashlib
import zlib

import pytest
from pyspark.sql import functions as F

from eventloom.llm import merkle as M
from edges import DOC, awkward, empty


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(row):
    return h(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in row))


def climb(nodes, fanout):
    """The root and, for each node, its siblings on either side per level."""
    levels, paths, at = [list(nodes)], [[] for _ in nodes], list(range(len(nodes)))
    while len(levels[-1]) > 1:
        row = levels[-1]
        for i, p in enumerate(at):
            start = p // fanout * fanout
            paths[i].append(("".join(row[start:p]), "".join(row[p + 1 : start + fanout])))
        at = [p // fanout for p in at]
        levels.append([h(*row[s : s + fanout]) for s in range(0, len(row), fanout)])
    return levels[-1][0], paths


def by_hand(rows, fanout=3):
    groups = {}
    for r in rows:
        groups.setdefault(r[1], []).append((r[0] is not None, r[0] or 0, leaf(r), r))
    names = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    trees = {s: (sorted(groups[s], key=lambda x: x[:3]), *climb([x[2] for x in sorted(groups[s], key=lambda x: x[:3])], fanout)) for s in names}
    root, tops = climb([trees[s][1] for s in names], fanout)
    out = []
    for s, top in zip(names, tops, strict=True):
        for (_, _, digest, r), path in zip(trees[s][0], trees[s][2], strict=True):
            told = digest
            if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 2 == 0:
                told = leaf((*r[:4], None if r[4] is None else r[4].replace("\n", "")))
            for a, b in path + top:
                told = h(a, told, b)
            out.append((str(r[0]), digest, trees[s][1], root, h(*(a + b for a, b in path + top)), told, told == root))
    return sorted(out)


def told(found):
    return sorted((str(r["doc_id"]), *(r[c] for c in ("leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"))) for r in found.collect())


def rows_of(docs):
    return [tuple(r[c] for c in M.COLUMNS) for r in docs.collect()]


def test_awkward(spark):
    docs = awkward(spark).withColumn("place", F.lit(1)).withColumn("group", F.lit("x"))
    found = M.document_proofs(docs)
    assert told(found) == by_hand(rows_of(docs))


@pytest.mark.parametrize("n", [1, 4, 10])
def test_sizes(spark, n):
    docs = spark.createDataFrame([(i, f"line {i}\nnext" if i % 3 else "one line", "en", "ab"[i % 2] if n > 3 else "a", 7, 0.5, 1) for i in range(n)], DOC)
    found = told(M.document_proofs(docs))
    assert found == by_hand(rows_of(docs))
    changed = {i for i in range(n) if zlib.crc32(str(i).encode()) % 2 == 0 and i % 3}
    assert {r[0] for r in found if not r[-1]} == {str(i) for i in changed}


def test_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    assert told(M.document_proofs(docs)) == by_hand(rows_of(docs))


def test_empty(spark):
    assert M.document_proofs(empty(spark)).count() == 0


def test_other_fanout_and_nodes(spark):
    rows = spark.createDataFrame([(i, h(str(i))) for i in range(30)], "id long, digest string")
    made = M.manifest(rows, ["id"], fanout=2)
    root, _ = climb([h(str(i)) for i in range(30)], 2)
    subroot_only = made.root
    assert subroot_only == root  # one group: its root is the root
    assert all(r["x"] == root for r in made.proofs().select(M.folded(F.col("digest"), F.col("proof")).alias("x")).collect())
    levels = {r["level"]: r["count"] for r in made.nodes().where("kind = 'row'").groupBy("level").count().collect()}
    assert levels == {0: 30, 1: 15, 2: 8, 3: 4, 4: 2, 5: 1}
    with pytest.raises(ValueError):
        M.manifest(rows, ["id"], fanout=1)


def test_equal_rows(spark):
    docs = spark.createDataFrame([(None, None, "en", None, None, None, 1)] * 20 + [(5, "a\nb", "en", None, 3, None, 1)] * 20, DOC)
    assert told(M.document_proofs(docs)) == by_hand(rows_of(docs))
