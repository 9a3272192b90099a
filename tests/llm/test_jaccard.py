from __future__ import annotations

import random
import re

import edges
import pyarrow.parquet as pq

from eventloom.llm import jaccard
from eventloom.llm.components import components

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def shingle_set(text):
    words = WORD.findall(re.sub("[A-Z]+", lambda m: m[0].lower(), text or ""))
    if not words:
        return frozenset()
    k = min(5, len(words))
    return frozenset(tuple(words[i : i + k]) for i in range(len(words) - k + 1))


def brute(texts):
    """doc_id -> (size, component), by every pair that shares a shingle."""
    sets = {i: shingle_set(t) for i, t in texts.items()}
    root = {i: i for i in texts}

    def find(i):
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    holders = {}
    for i, s in sets.items():
        for x in s:
            holders.setdefault(x, []).append(i)
    pairs = {(a, b) for held in holders.values() for n, a in enumerate(held) for b in held[n + 1 :]}
    for a, b in pairs:
        both = len(sets[a] & sets[b])
        if 100 * both >= 80 * (len(sets[a]) + len(sets[b]) - both):
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i)) for i in texts}


def result(docs):
    return {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard.near_duplicate_components(docs).collect()}


def near_copies(rng, words, changes):
    out = list(words)
    for _ in range(changes):
        at = rng.randrange(len(out))
        kind = rng.random()
        if kind < 0.4:
            out[at] = f"new{rng.randrange(10**6)}"
        elif kind < 0.7:
            out.insert(at, f"ins{rng.randrange(10**6)}")
        elif len(out) > 3:
            del out[at]
    return out


def test_planted_groups(spark):
    """Chains of near copies of all sizes, with a passage that all share."""
    rng = random.Random(9)
    vocabulary = [f"w{i}" for i in range(3_000)]
    common = [f"c{i}" for i in range(40)]
    texts = []
    for size in (1, 2, 3, 4, 5, 6, 7, 8, 10, 12, 15, 20, 30, 50, 80, 150, 400, 1_000):
        for _ in range(6):
            words = rng.choices(vocabulary, k=size)
            if rng.random() < 0.5:
                words = common + words
            for _ in range(rng.randint(1, 5)):
                texts.append(" ".join(words))
                words = near_copies(rng, words, max(0, round(len(words) * rng.choice([0, 0.005, 0.01, 0.02, 0.03]))) or rng.choice([0, 1]))
    rng.shuffle(texts)
    assert result(edges.documents(spark, texts)) == brute(dict(enumerate(texts)))


def test_whole_table(spark):
    table = pq.read_table("/root/testdata/sf0.01/documents.parquet", columns=["doc_id", "text"]).to_pydict()
    texts = dict(zip(table["doc_id"], table["text"], strict=True))
    assert result(spark.read.parquet("/root/testdata/sf0.01/documents.parquet")) == brute(texts)


def test_awkward_rows(spark):
    docs = edges.awkward(spark)
    rows = jaccard.near_duplicate_components(docs).collect()
    assert len(rows) == docs.count()
    by = {r["doc_id"]: r for r in rows}
    assert by[0]["n_shingles"] == by[1]["n_shingles"] == 0 and by[1]["component_id"] == 1
    assert by[3]["component_id"] == by[2]["component_id"] == 2
    assert by[None]["component_id"] is None and by[None]["n_shingles"] == 1
    assert jaccard.near_duplicate_components(edges.empty(spark)).count() == 0


def test_components_of_chains(spark):
    rng = random.Random(2)
    order = list(range(300))
    rng.shuffle(order)
    links = [(order[i], order[i + 1]) for i in range(299) if i % 100 != 99]
    found = {r["node"]: r["root"] for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    for k in range(3):
        part = order[100 * k : 100 * k + 100]
        assert {found[x] for x in part} == {min(part)}


def test_word_hashes():
    """Equal words of A-Z lower-cased texts have equal hashes wherever they stand, other words other ones."""
    draw = random.Random(7)
    texts = ["", " ", "\n\t ", "a", " A ", "a\x1cb c", "x" * 128, "X" * 129 + " " + "x" * 129, "y" * 200_000 + " b C", ("w" * 70 + " ") * 3000, "\x00 \x00\x00", "É é"]
    texts += ["".join(draw.choice("aBc \n\x0b\x0cé漢") for _ in range(draw.randrange(150_000))) for _ in range(3)]
    seen: dict[bytes, int] = {}
    for text in texts:
        found = text.encode().lower().split()
        hashes = jaccard.word_hashes(text.encode()).tolist()
        assert len(hashes) == len(found)
        for word, value in zip(found, hashes, strict=True):
            assert seen.setdefault(word, value) == value
    assert len(set(seen.values())) == len(seen)


def brute_of_rows(rows):
    """(doc_id, size) per row -> component, where a document is linked by any of its texts."""
    sets = [(i, shingle_set(t)) for i, t in rows]
    root = {i: i for i, _ in rows}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for n, (a, x) in enumerate(sets):
        for b, y in sets[n + 1 :]:
            if x and y and 100 * len(x & y) >= 80 * len(x | y):
                p, q = find(a), find(b)
                root[max(p, q)] = min(p, q)
    return sorted((i, len(s), find(i)) for i, s in sets)


def rows_result(spark, rows):
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    return sorted((r["doc_id"], r["n_shingles"], r["component_id"]) for r in jaccard.near_duplicate_components(docs).collect())


def test_ids_with_several_texts(spark):
    """Every text of an id links it: none is taken for the id's only one."""
    rng = random.Random(12)
    t1, t2 = (" ".join(rng.choices([f"w{i}" for i in range(500)], k=60)) for _ in range(2))
    first = [(3, t1), (5, t1), (5, t2), (9, t2 + " more")]
    second = [(3, t1), (5, t1), (5, t2), (9, t2)]
    for rows in (first, second):
        assert rows_result(spark, rows) == brute_of_rows(rows)
        assert {c for _, _, c in rows_result(spark, rows)} == {3}
    vocabulary = [f"v{i}" for i in range(800)]
    rows = []
    for _ in range(40):
        words = rng.choices(vocabulary, k=rng.choice([3, 8, 30, 100]))
        for _ in range(rng.randint(1, 6)):
            rows.append((rng.randrange(120), " ".join(words)))
            words = near_copies(rng, words, rng.choice([0, 0, 1, 2]))
    rows += [(7, ""), (7, None), (8, "")]
    assert rows_result(spark, rows) == brute_of_rows(rows)
