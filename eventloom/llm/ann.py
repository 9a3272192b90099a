"""Approximate nearest neighbours by cosine, with low-dimensional stable projections indexed by kd-trees.

Unit vectors are projected by a Gaussian (2-stable) matrix to a few dimensions, where a squared distance over the true
one follows a chi-square law. The index is two-level: a kd-tree of a bounded sample of projections cuts all vectors
into blocks, each block holds its own kd-tree. A query walks projected neighbours by rising distance and verifies them
on the original vectors until the chi-square test says that a better one further out is too unlikely.
"""

from __future__ import annotations

import heapq
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import lru_cache
from math import exp

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from eventloom.llm.common import checked_broadcast, stored

#: Projected dimensions (even, for the closed form of the chi-square law), and the seed of the matrix.
DIMENSIONS = 8
SEED = 20240229
#: The test stops when a true better neighbour would have been met with this probability.
CONFIDENCE = 0.98
#: Vectors that the top-level tree is fitted on, at most; all vectors are indexed.
SAMPLE = 20_000
#: Distinct vectors a block should hold, and a leaf of a block's tree.
BLOCK = 4_096
LEAF = 64
#: Queries that one copy of a block answers.
QUERIES = 2_000


@lru_cache(maxsize=None)
def chi_square_quantile(p: float, degrees: int = DIMENSIONS) -> float:
    """For even degrees, by bisection of 1 - exp(-x/2) * sum of (x/2)^j / j!."""

    def cdf(x: float) -> float:
        term, total = 1.0, 1.0
        for j in range(1, degrees // 2):
            term *= x / 2 / j
            total += term
        return 1 - exp(-x / 2) * total

    low, high = 0.0, 1000.0
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if cdf(mid) < p else (low, mid)
    return high


def scaled(vectors: np.ndarray) -> np.ndarray:
    """Each vector times a power of two that brings its largest component near 1: exact, and no square over- or underflows."""
    return np.ldexp(vectors, -np.frexp(np.abs(vectors).max(-1, keepdims=True))[1])


def units(vectors: np.ndarray) -> np.ndarray:
    x = scaled(vectors)
    return x / np.linalg.norm(x, axis=-1, keepdims=True)


def cosine(a: np.ndarray, b: np.ndarray) -> float:
    a, b = scaled(a), scaled(b)
    return float(a @ b / (np.sqrt(a @ a) * np.sqrt(b @ b)))


def dealt(ids: np.ndarray, parts: int) -> np.ndarray:
    """A part of each id by a hash, so that ids with a common factor spread."""
    return ((ids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(33)).astype(np.int64) % parts


@lru_cache(maxsize=8)
def projection(width: int) -> np.ndarray:
    return np.random.default_rng(SEED).standard_normal((width, DIMENSIONS))


@dataclass
class Split:
    """Points with a coordinate up to `at` go below."""

    axis: int
    at: float
    below: Split | int
    above: Split | int


def top_tree(sample: np.ndarray, blocks: int) -> tuple[Split | int, list[tuple[np.ndarray, np.ndarray]]]:
    """Median cuts on the widest axis down to `blocks` leaves, and each leaf's box."""
    boxes: list[tuple[np.ndarray, np.ndarray]] = []

    def cut(points: np.ndarray, low: np.ndarray, high: np.ndarray, leaves: int) -> Split | int:
        axis = int(np.argmax(points.max(0) - points.min(0))) if len(points) else 0
        if leaves > 1 and len(points) > 1 and (values := points[:, axis]).max() > values.min():
            at = float(np.median(values))
            at = at if at < values.max() else float(values[values < at].max())
            left = values <= at
            l_high, r_low = high.copy(), low.copy()
            l_high[axis], r_low[axis] = at, at
            return Split(axis, at, cut(points[left], low, l_high, leaves // 2), cut(points[~left], r_low, high, leaves - leaves // 2))
        boxes.append((low, high))
        return len(boxes) - 1

    infinite = np.full(DIMENSIONS, np.inf)
    return cut(sample, -infinite, infinite, max(1, blocks)), boxes


def blocks_of(points: np.ndarray, tree: Split | int) -> np.ndarray:
    out = np.zeros(len(points), np.int64)

    def go(node: Split | int, rows: np.ndarray) -> None:
        if isinstance(node, int):
            out[rows] = node
        else:
            left = points[rows, node.axis] <= node.at
            go(node.below, rows[left])
            go(node.above, rows[~left])

    go(tree, np.arange(len(points)))
    return out


class BlockTree:
    """A kd-tree over one block's projections; leaves hold slices of the reordered points."""

    def __init__(self, points: np.ndarray) -> None:
        self.order = np.arange(len(points))
        self.leaves: list[tuple[int, int]] = []
        low, high = [], []

        def cut(start: int, end: int) -> None:
            rows = points[self.order[start:end]]
            wide = rows.max(0) - rows.min(0)
            axis = int(np.argmax(wide))
            if end - start <= LEAF or wide[axis] == 0:
                self.leaves.append((start, end))
                low.append(rows.min(0))
                high.append(rows.max(0))
                return
            mid = (end - start) // 2
            self.order[start:end] = self.order[start:end][np.argpartition(rows[:, axis], mid)]
            cut(start, start + mid)
            cut(start + mid, end)

        cut(0, len(points))
        self.low, self.high = np.array(low), np.array(high)

    def rising(self, query: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Leaves by their boxes' squared distance from the query, nearest first."""
        gap = np.maximum(0, np.maximum(self.low - query, query - self.high))
        away = (gap * gap).sum(1)
        order = np.argsort(away, kind="stable")
        return order, away[order]


def search_block(queries: pd.DataFrame, block: pd.DataFrame, k: int, confidence: float) -> list[tuple[int, int, float]]:
    """(query_id, row number in the block, cosine): up to k + 1 of each query's nearest distinct vectors of the block.

    queries.bound is a squared distance within which k neighbours are known already, or infinite.
    """
    unit = np.stack(block["unit"].to_numpy())
    tree = BlockTree(points := unit @ projection(unit.shape[1]))
    unit = unit[tree.order]
    del points
    limit, found = chi_square_quantile(confidence), []
    for q, vector, bound in zip(queries["query_id"], queries["unit"], queries["bound"], strict=True):
        best: list[tuple[float, int]] = []  # the worst on top
        worst = bound
        order, away = tree.rising(vector @ projection(len(vector)))
        for leaf, distance in zip(order, away, strict=True):
            # A neighbour at squared distance `worst` lies within limit * worst of the query in the projection, but for the rest of the confidence.
            if distance > limit * worst:
                break
            start, end = tree.leaves[leaf]
            cosines = unit[start:end] @ vector
            top = np.argsort(-cosines, kind="stable")[: k + 1]
            for i in top:
                entry = (float(cosines[i]), -(start + int(i)))
                if len(best) <= k:
                    heapq.heappush(best, entry)
                elif entry > best[0]:
                    heapq.heapreplace(best, entry)
                else:
                    break
            if len(best) > k:
                worst = min(bound, max(0.0, 2 - 2 * best[0][0]) + 1e-12)
        found += [(q, int(tree.order[-row]), c) for c, row in best]
    return found


def clean(vectors: DataFrame, id: str, vector: str) -> DataFrame:
    """_id, vector as doubles: without null ids, null or zero vectors and such with null or non-finite components."""
    x = F.col(vector).cast("array<double>")
    bad = F.exists("vector", lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == F.lit(float("inf"))))
    some = F.exists("vector", lambda v: v != 0)
    return vectors.select(F.col(id).cast("long").alias("_id"), x.alias("vector")).where(F.col("_id").isNotNull() & F.col("vector").isNotNull()).where(~bad & some)


def nearest(
    vectors: DataFrame, is_query: Callable[[Column], Column], k: int = 5, id: str = "vec_id", vector: str = "embedding", confidence: float = CONFIDENCE, block: int = BLOCK
) -> DataFrame:
    """query_id, rank, the neighbour's id, score (cosine in double precision): the k nearest rows found per query row.

    `is_query` gives a condition on ids. Ties go to smaller ids; a query's own id isn't its neighbour. Equal vectors
    are searched as one and their k + 1 least ids stand for them, which is exact by the tie rule, so masses of copies
    cost nothing. Vectors that are null, zero or not finite take no part; all others must have one length. Of a
    repeated id the least vector counts. An empty table gives an empty result; other columns are left out.
    """
    spark = vectors.sparkSession
    base = stored(clean(vectors, id, vector).groupBy("_id").agg(F.min("vector").alias("vector")), "ann-vectors")
    # The k + 1 least ids of each distinct vector, limited before the shuffle.
    by = Window.partitionBy("vector").orderBy("_id")
    few = base.withColumn("_rank", F.row_number().over(by)).where(F.col("_rank") <= k + 1)
    classes = few.groupBy("vector").agg(F.sort_array(F.collect_list("_id")).alias("ids"))

    count, sample = base.count(), [r["vector"] for r in base.orderBy(F.xxhash64("_id"), "_id").limit(SAMPLE).select("vector").collect()]
    if not sample:
        return spark.createDataFrame([], f"query_id long, rank int, {id} long, score double")
    matrix, fitted = projection(len(sample[0])), np.array(sample)
    fitted = np.unique(units(fitted) @ matrix, axis=0)
    tree, boxes = top_tree(fitted, -(-count // block))
    low, high = np.array([b[0] for b in boxes]), np.array([b[1] for b in boxes])
    limit = chi_square_quantile(confidence)
    #: More vectors than the sample's leaves can hold as blocks: each leaf is dealt to several blocks.
    parts = max(1, -(-count // (2 * block * len(boxes))))

    def placed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in batches:
            if len(part):
                unit = units(np.stack(part["vector"].to_numpy()))
                deal = dealt(part["ids"].str[0].to_numpy() if "ids" in part else part["query_id"].to_numpy(), parts)
                yield part.assign(unit=list(unit), block=blocks_of(unit @ matrix, tree) * parts + deal)

    index = stored(classes.mapInPandas(placed, "vector array<double>, ids array<long>, unit array<double>, block long"), "ann-index")
    # Queries of equal vectors are searched once, under their least id; `alike` leads from it to all of them.
    rows = base.where(is_query(F.col("_id"))).select(F.col("_id").alias("query_id"), "vector")
    first = rows.groupBy("vector").agg(F.min("query_id").alias("query_id"))
    asked = stored(first.select("query_id", "vector").mapInPandas(placed, "query_id long, vector array<double>, unit array<double>, block long"), "ann-queries")
    of = first.select("vector", F.col("query_id").alias("_first"))
    alike = rows.join(of, "vector").select("_first", "query_id")

    def searched(queries: pd.DataFrame, held: pd.DataFrame) -> pd.DataFrame:
        found = search_block(queries, held, k, confidence) if len(queries) and len(held) else []
        own = dict(zip(queries["query_id"], queries["vector"], strict=True))
        ids, originals, result = held["ids"].to_numpy(), held["vector"].to_numpy(), []
        for q, row, _ in found:
            score = cosine(own[q], originals[row])
            result += [(q, int(i), score) for i in ids[row]]
        return pd.DataFrame(result, columns=["query_id", "_id", "score"])

    def search(routed: DataFrame) -> DataFrame:
        # A block that many queries reach is copied, one copy per QUERIES of them, so that no task gets all of them.
        met = stored(routed.groupBy("block").agg(F.ceil(F.count("*") / QUERIES).cast("int").alias("salts")), "ann-met")
        asked_of = routed.join(checked_broadcast(met), "block").withColumn("salt", F.pmod(F.xxhash64("query_id"), "salts").cast("int")).drop("salts")
        held_by = index.join(checked_broadcast(met), "block").withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("salts") - 1))).drop("salts")
        return asked_of.groupBy("block", "salt").cogroup(held_by.groupBy("block", "salt")).applyInPandas(searched, "query_id long, _id long, score double")

    # First each query's home block, which bounds how far its neighbours are; then the blocks that the bound doesn't rule out.
    home = stored(search(asked.withColumn("bound", F.lit(float("inf")))), "ann-home")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "_id")
    other = home.where("query_id <> _id").withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    bounds = other.groupBy("query_id").agg(F.when(F.count("*") == k, F.greatest(F.lit(0.0), 2 - 2 * F.min("score")) + F.lit(1e-12)).alias("bound"))
    bounded = asked.join(bounds, "query_id", "left").withColumn("bound", F.coalesce("bound", F.lit(float("inf"))))

    def routed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in batches:
            out = []
            for row in part.itertuples(index=False):
                at = row.unit @ matrix
                gap = np.maximum(0, np.maximum(low - at, at - high))
                leaves = np.flatnonzero((gap * gap).sum(1) <= limit * row.bound)
                out += [(row.query_id, row.vector, row.unit, int(b), row.bound) for leaf in leaves for b in range(leaf * parts, (leaf + 1) * parts) if b != row.block]
            yield pd.DataFrame(out, columns=["query_id", "vector", "unit", "block", "bound"])

    chosen = bounded.select("query_id", "vector", "unit", "block", "bound")
    away = search(stored(chosen.mapInPandas(routed, "query_id long, vector array<double>, unit array<double>, block long, bound double"), "ann-routed"))
    merged = home.unionByName(away).groupBy("query_id", "_id").agg(F.max("score").alias("score"))
    # One more than asked for, as every query but one of the class meets itself among them.
    top = stored(merged.withColumn("_rank", F.row_number().over(best)).where(F.col("_rank") <= k + 1).select(F.col("query_id").alias("_first"), "_id", "score"), "ann-found")
    lists = top.groupBy("_first").agg(F.sort_array(F.collect_list(F.struct((-F.col("score")).alias("minus"), "_id"))).alias("found"))
    own = alike.join(lists, "_first").select("query_id", F.slice(F.filter("found", lambda x: x["_id"] != F.col("query_id")), 1, k).alias("found"))
    ranked = own.select("query_id", F.posexplode("found").alias("_at", "x"))
    return ranked.select("query_id", (F.col("_at") + 1).cast("int").alias("rank"), F.col("x._id").alias(id), (-F.col("x.minus")).alias("score"))
