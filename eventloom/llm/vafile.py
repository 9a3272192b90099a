"""Exact top-k by inner product with a vector-approximation file.

Every vector of integers has two forms: the exact one, and one byte per component that names the cell of a grid in which
the component lies. A search scans the small approximations, which bound every score from both sides, keeps what the
bounds don't rule out, and reads exact vectors of these in the order of their bounds until the kth result is certain.
Queries meet the files in chunks of a fixed size, each broadcast to map stages: vectors are never shuffled.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from eventloom.llm.common import checked_broadcast, mapped, stored

#: Cells per component: 64.
BITS = 6
#: Distinct vectors that the grid is fitted on, at most; and the share of them outside its inner cells at either end.
SAMPLE, TAIL = 4_096, 0.002
#: Queries that one pass over the files answers, and how many of them a matrix of scores holds at a time.
QUERIES, TILE = 8_192, 512
#: Vectors of a query that are read first: what they score bounds what else has to be read.
FIRST = 16
#: Vectors still to be read, some 40 bytes each, up to which their list is broadcast; a longer one is joined by a shuffle.
UNREAD = 1_000_000
#: Scores outside of a long are given as its limits, and tie there.
LEAST, MOST = -(1 << 63), (1 << 63) - 1


# --- numbers -----------------------------------------------------------------------------------------------------
def integers(values: np.ndarray, scale: float = 256.0) -> np.ndarray:
    """floor(scale * x) as longs, cut off at 2**62 on either side."""
    with np.errstate(over="ignore"):
        return np.clip(np.floor(scale * values), -(2.0**62), 2.0**62).astype(np.int64)


def products(rows: np.ndarray, others: np.ndarray) -> np.ndarray:
    """The inner product of each row with its row of `others`, exactly, but for the limits of a long."""
    most = rows.shape[1] * float(np.abs(rows).max(initial=0)) * float(np.abs(others).max(initial=0))
    if most < 2.0**62:
        return (rows * others).sum(1)
    exact = (rows.astype(object) * others.astype(object)).sum(1)
    return np.array([min(max(int(x), LEAST), MOST) for x in exact], np.int64)


def padded(vectors: pa.Array, width: int) -> np.ndarray:
    """A list array as a matrix; shorter lists are filled with zeros."""
    sizes = np.diff(vectors.offsets.to_numpy())
    flat = vectors.flatten().to_numpy(zero_copy_only=False)
    if (sizes == width).all():
        return flat.reshape(-1, width)
    out = np.zeros((len(sizes), width), flat.dtype)
    out[np.arange(width) < sizes[:, None]] = flat
    return out


# --- the grid ------------------------------------------------------------------------------------------------------
class Grid:
    """Per component the inner borders of its cells, the outer cells reaching to the least and greatest value there is."""

    def __init__(self, sample: np.ndarray, least: np.ndarray, most: np.ndarray, bits: int = BITS) -> None:
        cells = 1 << bits
        low, high = np.quantile(sample, [TAIL, 1 - TAIL], axis=0)
        inner = np.floor(low + (high - low) * np.arange(1, cells)[:, None] / cells).T
        self.borders = np.maximum.accumulate(np.clip(inner, least[:, None], most[:, None]), axis=1)
        #: Cell c holds the integers from borders[c - 1] + 1 to borders[c].
        low_of = np.concatenate([least[:, None].astype(float), self.borders + 1], axis=1)
        high_of = np.concatenate([self.borders, most[:, None].astype(float)], axis=1)
        self.middle, self.half = (low_of + high_of) / 2, np.maximum(high_of - low_of, 0) / 2

    def cells(self, vectors: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(b, vectors[:, i], side="left") for i, b in enumerate(self.borders)], axis=1).astype(np.uint8) if len(self.borders) else np.zeros((len(vectors), 0), np.uint8)

    def bounds(self, queries: np.ndarray, cells: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The least and greatest score of each query with each approximated vector, with room for rounding, in a long's limits."""
        at = np.arange(cells.shape[1])
        middle, half = self.middle[at, cells], self.half[at, cells]
        size = np.abs(queries)
        near, far = queries @ middle.T, size @ half.T
        far += 1e-9 * (size @ (np.abs(middle) + half).T) + 0.5
        return np.clip(near - far, LEAST, MOST), np.clip(near + far, LEAST, MOST)


# --- files ---------------------------------------------------------------------------------------------------------
def exact_file(vectors: DataFrame, id: str, vector: str) -> DataFrame:
    """key, ids, vector: the distinct integer vectors of each slice of the table with all their ids, so that masses of copies
    are few rows. Rows with a null id, or a null vector, or one with a null or non-finite component are left out."""
    x = F.col(vector).cast("array<double>")
    bad = F.exists("vector", lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == F.lit(float("inf"))))
    clean = vectors.select(F.col(id).cast("long").alias("id"), x.alias("vector")).where("id is not null and vector is not null").where(~bad)

    def classes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in batches:
            if not part.num_rows:
                continue
            column, ids = part.column("vector"), part.column("id").to_numpy()
            sizes = np.diff(column.offsets.to_numpy())
            whole = integers(padded(column, int(sizes.max())))
            _, first, of = np.unique(np.column_stack([whole, sizes]), axis=0, return_index=True, return_inverse=True)
            order = np.lexsort((ids, of))
            lists = pa.ListArray.from_arrays(np.concatenate([[0], np.cumsum(np.bincount(of.ravel()))]).astype(np.int32), pa.array(ids[order]))
            taken = whole[first]
            rows = pa.ListArray.from_arrays(np.concatenate([[0], np.cumsum(sizes[first])]).astype(np.int32), pa.array(taken[np.arange(taken.shape[1]) < sizes[first][:, None]]))
            yield pa.RecordBatch.from_arrays([lists, rows], ["ids", "vector"])

    made = mapped(clean, classes, "ids array<long>, vector array<long>")
    return stored(made.withColumn("key", F.monotonically_increasing_id()), "va-exact")


def fitted_grid(exact: DataFrame, bits: int = BITS) -> Grid:
    """A grid of the extremes of all vectors and of the quantiles of a bounded sample, by hashes of the vectors' ids."""

    def extremes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in batches:
            if part.num_rows:
                width = int(np.diff(part.column("vector").offsets.to_numpy()).max())
                x = padded(part.column("vector"), width)
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(width)), pa.array(x.min(0, initial=0)), pa.array(x.max(0, initial=0))], ["at", "least", "most"])

    # One row per component.
    ends = mapped(exact.select("vector"), extremes, "at long, least long, most long").groupBy("at").agg(F.min("least").alias("least"), F.max("most").alias("most")).orderBy("at").collect()
    sample = [r["vector"] for r in exact.orderBy(F.xxhash64("ids"), "key").limit(SAMPLE).select("vector").collect()]
    matrix = np.zeros((max(1, len(sample)), len(ends)))
    for i, v in enumerate(sample):
        matrix[i, : len(v)] = v
    return Grid(matrix, np.array([r["least"] for r in ends], float), np.array([r["most"] for r in ends], float), bits)


def approximations(exact: DataFrame, grid: Grid) -> DataFrame:
    """key, cells (a byte per component), only (the id of a vector that no other id has)."""
    width = len(grid.borders)

    def coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in batches:
            cells = grid.cells(padded(part.column("vector"), width))
            data = pa.Array.from_buffers(pa.binary(), len(cells), [None, pa.py_buffer((np.arange(len(cells) + 1) * width).astype(np.int32).tobytes()), pa.py_buffer(cells.tobytes())])
            yield pa.RecordBatch.from_arrays([part.column("key"), data, part.column("only")], ["key", "cells", "only"])

    only = F.when(F.array_min("ids") == F.array_max("ids"), F.col("ids")[0]).alias("only")
    return stored(mapped(exact.select("key", "vector", only), coded, "key long, cells binary, only long"), "va-cells")


# --- search --------------------------------------------------------------------------------------------------------
def scanned(cells: DataFrame, grid: Grid, ids: np.ndarray, queries: np.ndarray, k: int) -> DataFrame:
    """query_id, key, upper, sure: what the bounds of a task's approximations don't rule out; sure is a score that k of the
    query's candidates in this task reach."""
    width, exact_queries = len(grid.borders), queries.astype(float)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sure = np.full((len(ids), k), -np.inf)  # the k greatest lower bounds, ascending
        found: list[tuple[np.ndarray, ...]] = []
        for part in batches:
            if not part.num_rows:
                continue
            keys, only = part.column("key").to_numpy(), part.column("only")
            alone, only = only.is_valid().to_numpy(zero_copy_only=False), only.fill_null(0).to_numpy()
            data = part.column("cells")
            offsets = np.frombuffer(data.buffers()[1], np.int32)[data.offset : data.offset + len(data) + 1]
            codes = np.frombuffer(data.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]].reshape(len(keys), width)
            for start in range(0, len(ids), TILE):
                end = min(start + TILE, len(ids))
                low, high = grid.bounds(exact_queries[start:end], codes)
                own = (ids[start:end, None] == only) & alone
                low[own] = high[own] = -np.inf
                best = sure[start:end]
                if len(keys) > k:
                    top = np.partition(low, len(keys) - k, axis=1)[:, -k:]
                else:
                    top = low
                sure[start:end] = np.sort(np.concatenate([best, top], axis=1), axis=1)[:, -k:]
                at, row = np.nonzero((high >= sure[start:end, :1]) & (high > -np.inf))
                found.append((at + start, keys[row], high[at, row]))
            if sum(len(f[0]) for f in found) > 1_000_000:
                found = [still(found, sure)]
        if found:
            at, key, upper = still(found, sure)
            yield pa.RecordBatch.from_arrays([pa.array(ids[at]), pa.array(key), pa.array(upper), pa.array(sure[at, 0])], ["query_id", "key", "upper", "sure"])

    def still(found: list[tuple[np.ndarray, ...]], sure: np.ndarray) -> tuple[np.ndarray, ...]:
        at, key, upper = (np.concatenate(x) for x in zip(*found, strict=True))
        kept = upper >= sure[at, 0]
        return at[kept], key[kept], upper[kept]

    return mapped(cells, scan, "query_id long, key long, upper double, sure double")


def read(candidates: DataFrame, exact: DataFrame, ids: np.ndarray, queries: np.ndarray, k: int) -> DataFrame:
    """query_id, id, score of the candidates' exact vectors, each standing for its k least ids but the query's: enough by
    the tie rule."""
    few = F.slice(F.filter("ids", lambda i: i != F.col("query_id")), 1, k).alias("ids")
    met = candidates.select("query_id", "key").join(exact, "key").select("query_id", "vector", few)
    order = np.argsort(ids)

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in batches:
            if part.num_rows:
                own = order[np.searchsorted(ids, part.column("query_id").to_numpy(), sorter=order)]
                score = products(queries[own], padded(part.column("vector"), queries.shape[1]))
                yield pa.RecordBatch.from_arrays([part.column("query_id"), part.column("ids"), pa.array(score)], ["query_id", "ids", "score"])

    return mapped(met, scored, "query_id long, ids array<long>, score long").select("query_id", F.explode("ids").alias("id"), "score")


def best(scores: DataFrame, k: int) -> DataFrame:
    """The k best rows of each query with their rank."""
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "id"))
    return scores.withColumn("rank", rank).where(F.col("rank") <= k)


def answered(exact: DataFrame, cells: DataFrame, grid: Grid, ids: np.ndarray, queries: np.ndarray, k: int) -> DataFrame:
    """query_id, id, score, rank of one chunk of queries."""
    candidates = stored(scanned(cells, grid, ids, queries, k), "va-candidates")
    by_bound = Window.partitionBy("query_id").orderBy(F.desc("upper"), "key")
    # At most FIRST rows a query, and about QUERIES queries.
    first = F.broadcast(stored(candidates.withColumn("_at", F.row_number().over(by_bound)).where(F.col("_at") <= FIRST).select("query_id", "key"), "va-first"))
    scores = stored(read(first, exact, ids, queries, k), "va-scores")
    # What k candidates are sure to score, by the bounds or as read; vectors that can't reach it aren't read.
    reached = best(scores, k).groupBy("query_id").agg(F.when(F.count("*") == k, F.min("score").cast("double")).alias("_reached"))
    bar = candidates.groupBy("query_id").agg(F.max("sure").alias("_sure")).join(reached, "query_id", "left").select("query_id", F.greatest("_sure", "_reached").alias("_bar"))
    rest = candidates.join(F.broadcast(bar), "query_id").where(F.col("upper") >= F.col("_bar")).join(first, ["query_id", "key"], "left_anti").select("query_id", "key")
    unread = checked_broadcast(stored(rest, "va-unread"), UNREAD)
    return best(scores.unionByName(read(unread, exact, ids, queries, k)), k)


def top_k(vectors: DataFrame, is_query: Callable[[Column], Column], k: int = 5, id: str = "vec_id", vector: str = "embedding", bits: int = BITS, chunk: int = QUERIES) -> DataFrame:
    """query_id, rank, the found id, score: the k ids with the highest inner products of floor(256 * x), exactly.

    `is_query` gives a condition on ids. Ties go to smaller ids; a query's own id isn't found. Vectors that are null or hold
    null or non-finite components take no part, shorter ones count as filled with zeros (an empty one too). Every row with
    another id is a candidate, so a repeated id can be found repeatedly; as a query it asks once, with the least of its
    vectors. Components are cut off at 2**62 and scores at a long's limits. An empty table gives an empty result; other columns are left out.
    """
    spark = vectors.sparkSession
    exact = exact_file(vectors, id, vector)
    asked = exact.select(F.explode(F.filter(F.array_distinct("ids"), is_query)).alias("query_id"), "vector").groupBy("query_id").agg(F.min("vector").alias("vector"))
    asked = stored(asked, "va-queries")
    count = asked.count()
    out = spark.createDataFrame([], "query_id long, id long, score long, rank int")
    if count:
        grid = fitted_grid(exact, bits)
        cells = approximations(exact, grid)
        parts = -(-count // chunk)
        for part in range(parts):
            # About `chunk` rows: the chunks are cut by a hash.
            rows = asked.where(F.pmod(F.xxhash64("query_id"), F.lit(parts)) == part).collect()
            if rows:
                ids = np.array([r["query_id"] for r in rows], np.int64)
                queries = np.zeros((len(rows), len(grid.borders)), np.int64)
                for i, r in enumerate(rows):
                    queries[i, : len(r["vector"])] = r["vector"]
                out = out.unionByName(stored(answered(exact, cells, grid, ids, queries, k).select("query_id", "id", "score", "rank"), "va-found"))
    return out.select("query_id", "rank", F.col("id").alias(id), "score")


SQL = """WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS x FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, v.vec_id, CAST(list_inner_product(q.x, v.x) AS BIGINT) AS score FROM v AS q, v WHERE q.vec_id % 50 = 0 AND v.vec_id <> q.vec_id)
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s
QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) <= 5"""
