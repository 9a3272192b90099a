"""Best-fit-decreasing packing of token pieces into fixed-size sequences.

Pieces of one length are alike, so the packing of all of them follows from the number of pieces of each length: at
most `capacity` counts. A segment tree over remaining capacities finds the tightest open sequence in logarithmic time
for each run of equal pieces; the runs then tell every piece, by its rank among those of its length, its sequence and
offset. Ranks are distributed prefix sums, so no task and no driver sees all pieces.
"""

from __future__ import annotations

import zlib
from collections import deque
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from eventloom.llm.common import checked_broadcast, grouped_prefix, mapped, stored
from eventloom.llm.tokens import encoder, tokenizer_path

CAPACITY = 2048
TOKENIZER = "word_bpe_49k.json"
END_ID = 0


class CapacityTree:
    """How many sequences are open at each remaining capacity; inner nodes hold sums."""

    def __init__(self, capacity: int) -> None:
        self.leaves = 1 << capacity.bit_length()
        self.sums = [0] * (2 * self.leaves)

    def add(self, remaining: int, count: int) -> None:
        at = remaining + self.leaves
        while at:
            self.sums[at] += count
            at >>= 1

    def tightest(self, length: int) -> int | None:
        """The least remaining capacity of at least `length` that some sequence has."""
        at = length + self.leaves
        while not self.sums[at]:
            # Climb until the subtree to the right holds something.
            while at & 1 or not self.sums[at + 1]:
                at >>= 1
                if at <= 1:
                    return None
            at += 1
        while at < self.leaves:
            at = 2 * at if self.sums[2 * at] else 2 * at + 1
        return at - self.leaves


def best_fit(counts: dict[int, int], capacity: int = CAPACITY) -> tuple[list[tuple[int, int, int, int, int]], int]:
    """Runs (length, first rank, first sequence, pieces per sequence, offset) and the number of sequences.

    Just what best fit decreasing does piece by piece: the tightest sequence stays the tightest until it is too full,
    so a sequence with room for n equal pieces takes n in a row, and equally full sequences take turns.
    """
    tree, where = CapacityTree(capacity), [deque() for _ in range(capacity + 1)]
    runs, made = [], 0

    def leave(remaining: int, first: int, count: int) -> None:
        if remaining and count:
            where[remaining].append((first, count))
            tree.add(remaining, count)

    for length in sorted(counts, reverse=True):
        rank, left = 0, counts[length]
        while left:
            room = tree.tightest(length)
            if room is None:
                room = capacity
                each = min(left, room // length)
                first, count = made, left // each
                made += count
                rest = 0
            else:
                first, count = where[room].popleft()
                tree.add(room, -count)
                each = min(left, room // length)
                rest = count - min(count, left // each)
                count -= rest
            runs.append((length, rank, first, each, capacity - room))
            rank += count * each
            left -= count * each
            leave(room - each * length, first, count)
            if rest:
                where[room].appendleft((first + count, rest))
                tree.add(room, rest)
    return runs, made


def token_pieces(docs: DataFrame, tokenizer: str | None = None, capacity: int = CAPACITY) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 of all pieces: a document's ids and the end id, cut at `capacity`."""
    path = tokenizer or tokenizer_path(TOKENIZER)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(path, keeps_space=False).encode
        end = END_ID.to_bytes(4, "little")
        for part in batches:
            of, rows = [], []
            for k, ids in enumerate(encode([t or "" for t in part.column("text").to_pylist()])):
                ids += end
                for at in range(0, len(ids), 4 * capacity):
                    piece = ids[at : at + 4 * capacity]
                    of.append(k)
                    rows.append((at // (4 * capacity), at // 4, len(piece) // 4, zlib.crc32(piece)))
            kinds = (pa.int32(), pa.int64(), pa.int64(), pa.int64())
            columns = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)]
            yield pa.RecordBatch.from_arrays([part.column("doc_id").take(pa.array(of)), *columns], ["doc_id", "piece", "start", "length", "ids_crc32"])

    return mapped(docs.select(F.col("doc_id").cast("long"), "text"), cut, "doc_id long, piece int, start long, length long, ids_crc32 long")


def packed(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """`pieces` (doc_id, piece, length, ...) with sequence_id and offset.

    Null ids, repeated rows and ties are pieces like others; an empty table gives an empty result. `pieces` should be
    stored. The driver gets one count per length, at most `capacity`.
    """
    spark = pieces.sparkSession
    counts = {r["length"]: r["count"] for r in pieces.groupBy("length").count().collect()}
    runs, _ = best_fit(counts, capacity)
    by_length: dict[int, list] = {}
    for length, *run in runs:
        by_length.setdefault(length, []).append(tuple(run))
    schema = "_length long, runs array<struct<rank:long,first:long,each:long,offset:long>>"
    plan = spark.createDataFrame(list(by_length.items()), schema)
    keyed = pieces.withColumn("_key", F.md5(F.concat_ws(":", F.col("doc_id").cast("string"), F.col("piece").cast("string"), F.col("ids_crc32").cast("string")).cast("binary"))).withColumn("_one", F.lit(1))
    ranked = grouped_prefix(keyed, "length", "_key", ["doc_id", "piece", "ids_crc32"], "_one", "_rank").drop("_key", "_one")
    joined = ranked.join(checked_broadcast(plan, capacity), F.col("length") == F.col("_length")).drop("_length")
    run = joined.withColumn("_run", F.element_at(F.filter("runs", lambda x: x["rank"] <= F.col("_rank")), -1)).drop("runs")
    behind = F.col("_rank") - F.col("_run.rank")
    return run.select(
        *pieces.columns,
        (F.col("_run.first") + F.floor(behind / F.col("_run.each"))).cast("long").alias("sequence_id"),
        (F.col("_run.offset") + (behind % F.col("_run.each")) * F.col("length")).cast("long").alias("offset"),
    )


def pack_documents(docs: DataFrame, tokenizer: str | None = None, capacity: int = CAPACITY) -> DataFrame:
    """Packs all documents; null and empty texts hold just the end id. Null ids and repeated rows are documents like
    others, an empty table gives an empty result, texts of any length are cut into whole pieces, further columns are left
    out, whatever their names."""
    return packed(stored(token_pieces(docs, tokenizer, capacity), "pieces"), capacity)
