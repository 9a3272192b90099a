"""N-gram Jaccard self-join by universe partitioning, exact.

A document's shingle hashes fall into size bands that are wider than the threshold, so partners are in the same or the
next band. A band's scheme splits the universe of hashes into segments. Two sets of Jaccard similarity t differ in at
most H = (1-t)/(1+t) * (sum of sizes) elements, so by the pigeonhole principle some segments' subsets agree exactly, or
within one element where one-deletion neighbourhoods are indexed ("deep" segments, worth 2). An allocation by cost
decides between deep and plain segments per scheme. A scheme has so many more segments than it needs that a set may
leave out its empty subsets, which would be common to all documents, and then its most frequent ones. Candidates are
verified on the sets of 64-bit shingle hashes.

No key gathers in a task: signatures are counted by partial aggregation and joined to their counts, pivots likewise, and
pairs of a large bucket are compared in blocks. Only ids, hashes and parities meet; texts stay where they lie.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from math import exp

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from eventloom.llm.common import checked_broadcast, mapped, released, remembering, stored
from eventloom.llm.components import components

WORDS = 5
#: Similarity as parts of 100.
SIMILARITY = 80
#: The largest size of a band in hundredths of its least: wide bands spare most sets the next band's scheme.
BAND = 150
#: What a segment of at most one element costs besides its row: its subset is as common as a shingle.
SMALL_SEGMENT_COST = 8
#: How rarely, at most, a set may have more empty subsets than its scheme lets it leave out.
RARE = 1e-6
#: Sizes from which a scheme's segments are counted by a normal law instead of exactly.
LARGE = 100
#: Rows of a bucket that are compared with one another in one piece.
BLOCK = 512
#: Words of a set's parities.
SKETCH = 16
#: Rows of one Arrow batch that a task sends.
BATCH_ROWS = 50_000
#: Bytes of a text whose words are hashed at once, and the longest word that is hashed so.
PIECE, LONG_WORD = 1 << 16, 128
U64 = np.uint64


# --- shingles --------------------------------------------------------------------------------------------------
def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values."""
    x = (x ^ (x >> U64(32))) * U64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> U64(29))) * U64(0xBF58476D1CE4E5B9)
    return x ^ (x >> U64(32))


def byte_values() -> np.ndarray:
    """A 64-bit value for each byte; A-Z have those of their small letters."""
    lowered = np.frombuffer(bytes(range(256)).lower(), np.uint8)
    return mixed(lowered.astype(U64) + U64(0xD1B54A32D192ED03))


VALUES = byte_values()
#: White space as bytes.split() knows it.
GAPS = np.isin(np.arange(256), np.frombuffer(b" \t\n\r\x0b\x0c", np.uint8))
BASE = 0x9E3779B97F4A7C15
POWERS = np.cumprod(np.r_[U64(1), np.full(PIECE + LONG_WORD, BASE, U64)])
INVERSES = np.cumprod(np.r_[U64(1), np.full(PIECE + LONG_WORD, pow(BASE, -1, 1 << 64), U64)])


def word_hashes(text: bytes) -> np.ndarray:
    """64-bit hashes of a text's words, those of A-Z lower-cased words.

    A word's hash is a polynomial over its bytes' values, a difference of running sums that is shifted back to the
    word's start, so all words of a piece are hashed at once. Longer words than LONG_WORD, for which equal polynomials
    could be made up, are hashed by themselves.
    """
    data = np.frombuffer(b" " + text + b" ", np.uint8)
    gap = GAPS[data]
    edges = np.flatnonzero(gap[1:] != gap[:-1]) + 1
    starts, ends = edges[::2], edges[1::2]
    out = np.empty(len(starts), U64)
    at = 0
    while at < len(starts):
        base = starts[at] - 1
        upto = int(np.searchsorted(starts, base + PIECE))
        first, last = starts[at:upto] - base, np.minimum(ends[at:upto] - base, PIECE + LONG_WORD)
        values = VALUES[data[base : base + int(last[-1])]]
        sums = np.cumsum(values * POWERS[: len(values)])
        out[at:upto] = mixed((sums[last - 1] - sums[first - 1]) * INVERSES[first])
        at = upto
    for k in np.flatnonzero(ends - starts > LONG_WORD):
        out[k] = xxhash.xxh64_intdigest(data[starts[k] : ends[k]].tobytes().lower())
    return out


def shingles(text: str | None, words: int = WORDS) -> np.ndarray:
    """The sorted distinct 64-bit hashes of a text's word shingles; those of A-Z lower-cased words."""
    w = word_hashes((text or "").encode("utf-8", "surrogatepass"))
    if not len(w):
        return w
    k = min(words, len(w))
    h = np.full(len(w) - k + 1, k, U64)
    for i in range(k):
        h = h * U64(BASE) + w[i : len(w) - k + 1 + i]
    h = np.sort(mixed(h))
    return h[np.r_[True, h[1:] != h[:-1]]]


# --- schemes ---------------------------------------------------------------------------------------------------
@lru_cache(maxsize=None)
def band_ends(similarity: int, upto: int = 1 << 40) -> np.ndarray:
    """The largest size of each band."""
    ends, low = [], 1
    while low < upto:
        ends.append(max(low, low * max(BAND * similarity, 10_000) // (100 * similarity)))
        low = ends[-1] + 1
    return np.asarray(ends)


def band_of(n: int, similarity: int) -> int:
    return int(np.searchsorted(band_ends(similarity), n))


def filled_law(n: int, segments: int, least: int) -> np.ndarray:
    """The law of how many of the segments hold `least` (1 or 2) or more of n elements."""
    # state[i, j]: j segments hold enough; i hold one element, if two are enough.
    state = np.zeros((min(n, segments) + 2, min(n, segments) + 2))
    state[0, 0] = 1.0
    one, full = np.arange(len(state))[:, None] / segments, np.arange(len(state))[None, :] / segments
    for _ in range(n):
        new = state * full
        if least == 1:
            new[:, 1:] += (state * (1 - full))[:, :-1]
        else:
            new[:-1, 1:] += (state * one)[1:, :-1]
            new[1:, :] += (state * np.maximum(0, 1 - one - full))[:-1, :]
        state = new
    return state.sum(0)


def enough_segments(n: int, needed: int, least: int, most: int) -> int | None:
    """The fewest segments of which `needed` hold `least` or more of n elements, but for RARE sets; None beyond `most`."""
    segments = needed
    while segments <= most:
        mean = n / segments
        if n <= (LARGE if least == 1 else 60):
            law = filled_law(n, segments, least)
            if law[:needed].sum() <= RARE:
                return segments
        else:
            rest = exp(-mean) * (1 if least == 1 else 1 + mean)
            spread = rest - (1 + mean) * rest * rest if least == 1 else rest
            # The normal law's tail beyond 5 deviations is under RARE.
            if segments - segments * rest - 5 * (segments * spread) ** 0.5 >= needed:
                return segments
        segments = max(segments + 1, int(segments * 1.02))
    return None


@lru_cache(maxsize=None)
def scheme(band: int, similarity: int) -> tuple[int, bool, int]:
    """Segments, whether they are deep, slack: for pairs whose smaller set is in `band`.

    A pair agrees in all but H plain segments at least, and within one element in all but H / 2 deep ones. Of plain
    segments there are so many that H + 1 aren't empty, of deep ones so many that H / 2 + 1 have two elements or more;
    the slack is how many a set may leave out. No segments if only equal sets can be similar.
    """
    most = int(band_ends(similarity)[band])
    larger = most * 100 // similarity
    h = (most + larger) * (100 - similarity) // (100 + similarity)
    if not h:
        return 0, False, 0
    least = int(band_ends(similarity)[band - 1]) + 1 if band else 1
    typical = (least + larger) / 2

    def single(segments: int) -> float:
        """Segments of one element."""
        mean = typical / segments
        return segments * mean * exp(-mean)

    plain = enough_segments(least, h + 1, 1, 1 << 40)
    deep = enough_segments(least, h // 2 + 1, 2, 2 * least)
    rows = plain * (1 - exp(-typical / plain)) + SMALL_SEGMENT_COST * single(plain)
    if deep and typical + deep + SMALL_SEGMENT_COST * single(deep) < rows:
        return deep, True, deep - h // 2 - 1
    return plain, False, plain - h - 1


@lru_cache(maxsize=64)
def segment_names(band: int, segments: int) -> np.ndarray:
    return mixed(np.arange(segments, dtype=U64) + U64((band + 1) << 40))


def signatures(h: np.ndarray, similarity: int = SIMILARITY) -> list[tuple[np.ndarray, int, bool]]:
    """(signatures, slack left, whether the set is in the scheme's own band) for the one or two schemes of a set."""
    out = []
    own = band_of(len(h), similarity)
    values = mixed(h + U64(0x632BE59BD9B4E019))
    for band in (own, own - 1):
        # A partner in the band below has the similarity's share of this set's size at least.
        if band < 0 or (band < own and len(h) * similarity > 100 * int(band_ends(similarity)[band])):
            continue
        segments, deep, slack = scheme(band, similarity)
        if not segments:
            continue
        # Sorted hashes fall into rising segments.
        place = ((h >> U64(32)) * U64(segments)) >> U64(32)
        first = np.flatnonzero(np.r_[True, place[1:] != place[:-1]])
        sums = np.add.reduceat(values, first)
        held = place[first].astype(np.int64)
        names = segment_names(band, segments)
        if deep:
            # All subsets and what each leaves without one element, but not the empty one: a pair agrees elsewhere,
            # unless both have more segments of less than two elements than the slack allows.
            sizes = np.diff(np.r_[first, len(h)])
            two, left = sizes > 1, 0
            sigs = [mixed(sums + names[held])]
            which = np.repeat(np.arange(len(first)), sizes)
            sigs.append(mixed(((sums + names[held])[which] - values)[two[which]]))
            if segments - int(two.sum()) > slack:
                sigs.append(mixed(names[np.setdiff1d(np.arange(segments), held[two], assume_unique=True)]))
        else:
            # Empty subsets go first, by number; those beyond the slack stay.
            sigs, left = [mixed(sums + names[held])], slack - (segments - len(held))
            if left < 0:
                empty = np.setdiff1d(np.arange(segments), held, assume_unique=True)
                sigs.append(mixed(names[empty[slack:]]))
                left = 0
        out.append((np.concatenate(sigs), left, band == own))
    return out


# --- stages ----------------------------------------------------------------------------------------------------
def parities(h: np.ndarray) -> np.ndarray:
    """SKETCH words whose bits tell, for as many groups of hashes, whether the set holds an odd number. Each element by
    which two sets differ turns one bit, so the bits that differ are at most that many elements."""
    odd = np.bincount((mixed(h + U64(7)) >> U64(32)).astype(np.int64) % (64 * SKETCH), minlength=64 * SKETCH) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def digests(docs: DataFrame, words: int = WORDS) -> DataFrame:
    """doc_id, n, two sums over the set's hashes that tell equal sets, and the set's parities."""

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        remembering("jaccard")
        for part in batches:
            texts = part.column("text").to_pylist()
            rows, bits = np.zeros((3, len(texts)), np.int64), np.zeros((len(texts), SKETCH), np.int64)
            for k, text in enumerate(texts):
                h = shingles(text, words)
                rows[:, k] = len(h), mixed(h).sum(dtype=U64).view(np.int64), mixed(h + U64(1)).sum(dtype=U64).view(np.int64)
                bits[k] = parities(h)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(texts) + 1, dtype=np.int32) * SKETCH), pa.array(bits.ravel()))
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), *(pa.array(x) for x in rows), lists], ["doc_id", "n", "d1", "d2", "bits"])

    return mapped(docs.select(F.col("doc_id").cast("long"), "text"), made, "doc_id long, n long, d1 long, d2 long, bits array<long>")


def signature_rows(docs: DataFrame, similarity: int, words: int) -> DataFrame:
    """sig, doc, tag for all signatures of all documents (doc_id, text, mixed). tag: size * 2**24 + slack left * 2 + 1 if in its
    own band; a mixed document, whose texts differ, has no slack, as that of one text isn't that of another."""

    def batch(sigs: list, docs_: list, tags: list) -> pa.RecordBatch:
        counts = [len(x) for x in sigs]
        columns = [np.concatenate(sigs).view(np.int64), np.repeat(np.asarray(docs_, np.int64), counts), np.repeat(np.asarray(tags, np.int64), counts)]
        return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["sig", "doc", "tag"])

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        remembering("jaccard")
        for part in batches:
            sigs, ids, tags, held = [], [], [], 0
            for doc, text, mixed_ in zip(*(part.column(c).to_pylist() for c in ("doc_id", "text", "mixed")), strict=True):
                h = shingles(text, words)
                if not len(h):
                    continue
                for found, left, own in signatures(h, similarity):
                    sigs.append(found)
                    ids.append(doc)
                    tags.append(len(h) << 24 | (0 if mixed_ else left) << 1 | own)
                    held += len(found)
                if held >= BATCH_ROWS:
                    yield batch(sigs, ids, tags)
                    sigs, ids, tags, held = [], [], [], 0
            if sigs:
                yield batch(sigs, ids, tags)

    return mapped(docs.select("doc_id", "text", "mixed"), made, "sig long, doc long, tag long")


def sets_of(docs: DataFrame, words: int) -> DataFrame:
    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        remembering("jaccard")
        for part in batches:
            sets = [shingles(t, words).tobytes() for t in part.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(sets, pa.binary())], ["doc", "hashes"])

    return mapped(docs.select("doc_id", "text"), made, "doc long, hashes binary")


def verified(pairs: DataFrame, sets: DataFrame, similarity: int) -> DataFrame:
    """Those of the distinct pairs (a, b) whose sets are similar enough."""

    def tested(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in batches:
            keep = []
            for x, y in zip(part.column("left").to_pylist(), part.column("right").to_pylist(), strict=True):
                x, y = np.frombuffer(x, U64), np.frombuffer(y, U64)
                both = np.sort(np.concatenate([x, y]))
                shared = int((both[1:] == both[:-1]).sum())
                keep.append(100 * shared >= similarity * (len(x) + len(y) - shared))
            yield part.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    left = pairs.join(sets.select(F.col("doc").alias("a"), F.col("hashes").alias("left")), "a")
    full = left.join(sets.select(F.col("doc").alias("b"), F.col("hashes").alias("right")), "b")
    return mapped(full.select("a", "b", "left", "right"), tested, "a long, b long")


def verified_from(docs: DataFrame, pairs: DataFrame, similarity: int, words: int) -> DataFrame:
    """`verified`, with the sets made from the texts of the documents in the pairs."""
    ids = stored(pairs.select(F.col("a").alias("doc_id")).union(pairs.select("b")).distinct(), "jaccard-ids")
    return verified(pairs, sets_of(docs.join(checked_broadcast(ids), "doc_id", "left_semi"), words), similarity)


def similar_size(n: str, m: str, similarity: int) -> Column:
    return F.least(n, m) * 100 >= F.greatest(n, m) * similarity


def candidate_buckets(docs: DataFrame, similarity: int, words: int) -> DataFrame:
    """sig, doc, n, own, cnt, score: rows of signatures that some pair shares, without those that the slack leaves out.

    score counts the rows that a document's signatures are shared with: high for the middle of a group of near copies.
    Signatures are made twice, to be counted and to meet their counts: a frequent one is combined before the first
    shuffle and is a skewed side that can be split in the second.
    """
    rows = signature_rows(docs, similarity, words)
    own = F.col("tag").bitwiseAND(1)
    counts = stored(rows.groupBy("sig").agg(F.count("*").alias("cnt"), F.max(own).alias("_own")).where("cnt > 1 and _own = 1").select("sig", "cnt"), "jaccard-counts")
    released(docs.sparkSession)
    shared = stored(
        rows.join(counts, "sig").select("sig", "doc", "cnt", F.shiftright("tag", 24).alias("n"), F.shiftright("tag", 1).bitwiseAND((1 << 23) - 1).alias("slack"), (own == 1).alias("own")),
        "jaccard-shared",
    )
    released(docs.sparkSession)
    # Most frequent first, the same order for all documents; only subsets that three or more share are worth leaving out.
    costly = Window.partitionBy("doc", "own").orderBy(F.desc("cnt"), "sig")
    often = shared.where("cnt > 2").withColumn("_rank", F.row_number().over(costly)).where("_rank > slack").drop("_rank")
    kept = often.unionByName(shared.where("cnt = 2"))
    scores = shared.groupBy("doc").agg(F.sum("cnt").alias("score"))
    return kept.drop("slack").join(scores, "doc")


def star_pairs(rows: DataFrame, similarity: int) -> DataFrame:
    """Distinct pairs (a, b) of each bucket's pivot, its own-band member of highest score, with its other members.
    `rows` should be stored: it is read twice."""
    # Written before the join, so that a large bucket is a skewed side that can be split.
    best = stored(rows.where("own").groupBy("sig").agg(F.max(F.struct("score", (-F.col("doc")).alias("minus"), "n")).alias("pivot")), "jaccard-pivots")
    met = rows.join(best, "sig").where(F.col("doc") != -F.col("pivot.minus")).where(similar_size("n", "pivot.n", similarity))
    a, b = -F.col("pivot.minus"), F.col("doc")
    return met.select(F.least(a, b).alias("a"), F.greatest(a, b).alias("b")).distinct()


def open_rows(buckets: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of buckets that hold several components so far, with each row's root."""
    several = buckets.where("cnt > 2").join(labels, buckets["doc"] == labels["node"], "left").withColumn("root", F.coalesce("root", "doc")).drop("node")
    several = stored(several, "jaccard-several")
    apart = stored(several.groupBy("sig").agg(F.min("root").alias("_lo"), F.max("root").alias("_hi")).where("_lo < _hi").select("sig"), "jaccard-apart")
    return several.join(apart, "sig", "left_semi")


def cross_pairs(rows: DataFrame, similarity: int, block: int = BLOCK) -> DataFrame:
    """Distinct pairs (a, b) that share a bucket, are in different components so far and whose parities, within the
    join, don't rule them out already.

    A bucket's rows are dealt to blocks of about `block`, and a task's key is a pair of blocks, so that a large bucket
    spreads over many tasks.
    """
    blocks = F.ceil(F.col("cnt") / block).cast("int")
    dealt = rows.withColumns({"_blocks": blocks, "_block": F.pmod(F.xxhash64("doc"), blocks).cast("int")})
    one = dealt.select("*", F.explode(F.sequence(F.col("_block"), F.col("_blocks") - 1)).alias("_other"))
    two = dealt.select("*", F.explode(F.sequence(F.lit(0), F.col("_block"))).alias("_other"))
    names = ("sig", "doc", "n", "own", "root", "bits", "_block", "_other")
    one, two = (side.select(*[F.col(c).alias(f"{c}{k}") for c in names]) for k, side in ((1, one), (2, two)))
    # Within a block each pair meets twice, between blocks once.
    key = (F.col("sig1") == F.col("sig2")) & (F.col("_block1") == F.col("_other2")) & (F.col("_other1") == F.col("_block2"))
    on = key & ((F.col("_block1") < F.col("_block2")) | (F.col("doc1") < F.col("doc2"))) & (F.col("root1") != F.col("root2"))
    useful = (F.col("own1") | F.col("own2")) & similar_size("n1", "n2", similarity)
    differ = sum((F.bit_count(F.col("bits1")[i].bitwiseXOR(F.col("bits2")[i])) for i in range(SKETCH)), F.lit(0))
    # A mixed document has no parities.
    close = differ * (100 + similarity) <= (F.col("n1") + F.col("n2")) * (100 - similarity)
    a, b = F.least("doc1", "doc2"), F.greatest("doc1", "doc2")
    return one.join(two, on & useful & F.coalesce(close, F.lit(True))).select(a.alias("a"), b.alias("b")).distinct()


def links_of_mixed(every: DataFrame, named: DataFrame, mixed_ids: DataFrame) -> DataFrame:
    """Links (a, b) of mixed documents with others of an equal set, through the least of them and the class's least: signatures are
    made for sets that differ, classes for documents of one set."""
    held = every.join(mixed_ids, "doc_id", "left_semi")
    sets = held.select("set").distinct()
    plain = named.select("doc_id", F.struct("n", "d1", "d2").alias("set")).join(sets, "set", "left_semi").groupBy("set").agg(F.min("doc_id").alias("doc_id"))
    nodes = stored(held.select("set", "doc_id").unionByName(plain).distinct(), "jaccard-mixed-nodes")
    least = nodes.groupBy("set").agg(F.min("doc_id").alias("a"))
    return nodes.join(least, "set").where("a <> doc_id").select("a", F.col("doc_id").alias("b")).distinct()


def near_duplicate_components(docs: DataFrame, similarity: int = SIMILARITY, words: int = WORDS) -> DataFrame:
    """doc_id, n_shingles, component_id for every row of `docs` (doc_id, text).

    Equal sets become one class, its least doc_id for all. Each bucket of a signature first verifies its members
    against a pivot; then all pairs in different components so far are verified, which completes the join as far as
    components can tell; links within a component aren't listed. A text without words has size 0 and is alone; a null
    doc_id keeps its size with a null component; rows of one doc_id are one document, linked by any of its texts; an empty table
    gives an empty result; texts of any length are read whole; further columns are left out, whatever their names.
    """
    sizes = stored(digests(docs, words), "jaccard-digests")
    every = sizes.where("doc_id is not null and n > 0").select("doc_id", F.struct("n", "d1", "d2").alias("set"))
    # Ids of several different sets take part with all of them; they are in no class, as a class stands for whole documents.
    several = stored(every.groupBy("doc_id").agg(F.min("set").alias("least"), F.max("set").alias("most")).where("least <> most").select("doc_id"), "jaccard-mixed")
    mixed_ids = checked_broadcast(several)
    named = every.join(mixed_ids, "doc_id", "left_anti").select("doc_id", "set.*")
    classes = named.groupBy("n", "d1", "d2").agg(F.min("doc_id").alias("rep"), F.count("*").alias("rows"))
    # Written before the join, so that a large class is a skewed join side, which can be split, and not also a group.
    repeated = stored(classes.where("rows > 1").select("n", "d1", "d2", "rep"), "jaccard-repeated")
    copies = stored(named.join(checked_broadcast(repeated), ["n", "d1", "d2"]).where("doc_id <> rep").select("doc_id", "rep"), "jaccard-copies")
    bare = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where("doc_id is not null")
    marked = bare.join(mixed_ids.select("doc_id", F.lit(True).alias("_mixed")), "doc_id", "left").select("doc_id", "text", F.col("_mixed").isNotNull().alias("mixed"))
    single = marked.join(checked_broadcast(copies.select("doc_id").distinct()), "doc_id", "left_anti")

    buckets = stored(candidate_buckets(single, similarity, words), "jaccard-buckets")
    stars = stored(star_pairs(buckets, similarity), "jaccard-stars")
    links = stored(verified_from(single, stars, similarity, words), "jaccard-links")
    if not several.isEmpty():
        links = stored(links.unionByName(links_of_mixed(every, named, mixed_ids)), "jaccard-links")
    labels = components(links)
    parities_of = sizes.join(mixed_ids, "doc_id", "left_anti").select(F.col("doc_id").alias("doc"), "n", "bits").dropDuplicates(["doc", "n"])
    rest = stored(cross_pairs(stored(open_rows(buckets, labels).join(parities_of, ["doc", "n"], "left"), "jaccard-open"), similarity), "jaccard-rest")
    found = stored(verified_from(single, rest, similarity, words), "jaccard-links")
    if not found.isEmpty():
        labels = components(links.unionByName(found))

    of_class = copies.join(labels, copies["rep"] == labels["node"], "left").select("doc_id", F.coalesce("root", "rep").alias("_root"))
    roots = labels.select(F.col("node").alias("doc_id"), F.col("root").alias("_root")).unionByName(of_class).groupBy("doc_id").agg(F.min("_root").alias("_root"))
    return sizes.join(roots, "doc_id", "left").select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("_root", "doc_id").alias("component_id"))
