"""Mixing sources to target weights (native DataFrame operations only).

Documents get hash-random keys, each source is range-sorted by them, distributed prefix sums of word counts find
where each source's budget ends, and budgets above a source's size repeat whole epochs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from eventloom.llm.common import WORD, checked_broadcast, grouped_prefix, stored

WEIGHTS = (1, 2, 3)
#: A source gives at most so many times its own size.
CAP = 3


def source_targets(sizes: DataFrame, cap: int = CAP, weights: tuple[int, ...] = WEIGHTS) -> DataFrame:
    """Word targets of all sources. `sizes`: one row per source (`source`, `source_size`).

    Sources in code-point order, null last, weigh `weights` in turn and share the sum of all sizes. A share above
    `cap` times its source's size stops there and the excess goes to the others by weight, until none is above.
    In closed form: by rising size per weight, a source is capped while the level that is left for it and those
    after it reaches its cap. Empty input gives no rows; sources without words get 0.

    The windows below see one row per source, never documents.
    """
    placed = Window.orderBy(F.col("source").asc_nulls_last())
    everything = Window.partitionBy()
    ranked = sizes.select(
        "source", "source_size",
        F.element_at(F.array(*map(F.lit, weights)), ((F.row_number().over(placed) - 1) % len(weights) + 1).cast("int")).cast("long").alias("w"),
        F.sum("source_size").over(everything).alias("all_words"),
    )
    rising = Window.orderBy((F.lit(float(cap)) * F.col("source_size") / F.col("w")), F.col("source").asc_nulls_last())
    tested = ranked.select(
        "*",
        F.coalesce(F.sum("source_size").over(rising.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("smaller"),
        F.sum("w").over(rising.rowsBetween(0, Window.unboundedFollowing)).alias("w_left"),
    ).withColumn("capped", (F.col("all_words") - cap * F.col("smaller")) * F.col("w") >= cap * F.col("source_size") * F.col("w_left"))
    free = ~F.col("capped")
    levelled = tested.select(
        "*",
        F.sum(F.when(F.col("capped"), F.col("source_size")).otherwise(0)).over(everything).alias("s_capped"),
        F.sum(F.when(free, F.col("w")).otherwise(0)).over(everything).alias("w_free"),
    )
    level = (F.col("all_words") - cap * F.col("s_capped")).cast("double") / F.col("w_free")
    target = F.when(F.col("capped"), (cap * F.col("source_size")).cast("double")).otherwise(level * F.col("w"))
    return levelled.select("source", "source_size", target.alias("target"))


def sized(docs: DataFrame) -> DataFrame:
    """doc_id, source, size in words (null text: 0) and the hash-random key from id and text, so that rows of a null or
    repeated doc_id spread; `tie` settles repeated doc_ids."""
    return docs.select(
        "doc_id", "source",
        F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("size"),
        F.md5(F.concat_ws(":", F.col("doc_id").cast("string"), F.md5(F.col("text").cast("binary"))).cast("binary")).alias("key"),
        F.xxhash64("text").alias("tie"),
    )


def mix(docs: DataFrame, cap: int = CAP, weights: tuple[int, ...] = WEIGHTS) -> DataFrame:
    """What the mix takes of each document: doc_id, source, tie, size, source_size, target, before, taken.

    `taken` counts words with repeats: `budget div source_size` whole epochs, and of one further epoch, in key
    order, what the rest of the budget covers; the document at the cut gives only its part, so that the sum over a
    source is its target rounded down. Null sources are a source, null texts have size 0, repeated rows each count,
    an empty table gives an empty result; texts of any length are counted whole; further columns are left out, whatever
    their names. Same rows, same result.
    """
    base = stored(sized(docs), "mix-sizes")
    sizes = base.groupBy("source").agg(F.sum("size").alias("source_size"))
    targets = stored(source_targets(sizes, cap, weights), "mix-targets")
    summed = grouped_prefix(base, "source", "key", ["doc_id", "size", "tie"], "size", "before")
    named = targets.withColumnRenamed("source", "_source")
    joined = summed.join(checked_broadcast(named), summed["source"].eqNullSafe(named["_source"])).drop("_source")
    budget = F.floor("target").cast("long")
    some = F.when(F.col("source_size") > 0, F.col("source_size")).otherwise(1)
    epochs = F.floor(budget / some).cast("long")
    rest = budget - epochs * some
    part = F.greatest(F.lit(0).cast("long"), F.least(F.col("size"), rest - F.col("before")))
    return joined.select("doc_id", "source", "tie", "size", "source_size", "target", "before", (epochs * F.col("size") + part).alias("taken"))


def mixed_documents(docs: DataFrame, cap: int = CAP, weights: tuple[int, ...] = WEIGHTS) -> DataFrame:
    """The mixed documents themselves, whole: each as often as its taken words make it, halves rounded up.

    Documents without words carry no budget and stay once. Columns are those of `docs`, whatever their names; rows that
    agree in id, source and text share their copies as evenly as whole numbers allow; an empty table stays empty.
    """
    taken = mix(docs, cap, weights)
    copies = F.when(F.col("size") == 0, 1).otherwise(F.floor((2 * F.col("taken") + F.col("size")) / F.when(F.col("size") > 0, 2 * F.col("size")).otherwise(1)))
    wanted = taken.withColumn("copies", copies.cast("int")).groupBy("doc_id", "source", "tie").agg(F.sum("copies").alias("total"), F.count("*").alias("rows"))
    row = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("doc"), F.col("doc_id").alias("id"), F.col("source").alias("of"), F.xxhash64("text").alias("hash"))
    joined = row.join(wanted, row["id"].eqNullSafe(F.col("doc_id")) & row["of"].eqNullSafe(F.col("source")) & (F.col("hash") == F.col("tie")))
    # Of equal rows the first ones get one copy more; only rows that have equals are numbered.
    equal = F.row_number().over(Window.partitionBy("id", "of", "hash").orderBy(F.lit(0)))
    single = joined.where("rows = 1").withColumn("each", F.col("total").cast("int"))
    several = joined.where("rows > 1").withColumn("each", (F.floor(F.col("total") / F.col("rows")) + F.when(equal <= F.col("total") % F.col("rows"), 1).otherwise(0)).cast("int"))
    made = single.unionByName(several).where("each > 0").select("doc", F.explode(F.sequence(F.lit(1), F.col("each"))).alias("copy"))
    return made.select(*[F.col("doc")[c].alias(c) for c in docs.columns])


SQL = r"""
WITH d AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
         md5(concat_ws(':', doc_id, md5(text))) AS k
  FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
o AS (SELECT source, source_size, 1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 AS w,
             CAST(sum(source_size) OVER () AS BIGINT) AS t FROM s),
r AS (SELECT *, coalesce(sum(source_size) OVER (ORDER BY 3.0::DOUBLE * source_size / w, source NULLS LAST
                 ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS smaller,
             sum(w) OVER (ORDER BY 3.0::DOUBLE * source_size / w, source NULLS LAST
                 ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS w_left FROM o),
c AS (SELECT *, (t - 3 * smaller) * w >= 3 * source_size * w_left AS capped FROM r),
l AS (SELECT *, sum(CASE WHEN capped THEN source_size ELSE 0 END) OVER () AS s_capped,
             sum(CASE WHEN capped THEN 0 ELSE w END) OVER () AS w_free FROM c),
g AS (SELECT source, source_size,
             CASE WHEN capped THEN CAST(3 * source_size AS DOUBLE)
                  ELSE CAST(t - 3 * s_capped AS DOUBLE) / CAST(w_free AS DOUBLE) * w END AS target FROM l),
p AS (SELECT d.*, g.source_size, g.target,
             coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY k, doc_id
                 ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
      FROM d JOIN g ON d.source IS NOT DISTINCT FROM g.source),
e AS (SELECT *, CAST(floor(target) AS BIGINT) // greatest(source_size, 1) AS epochs,
             CAST(floor(target) AS BIGINT) % greatest(source_size, 1) AS rest FROM p)
SELECT doc_id, size, source_size, target,
       CAST(epochs * size + greatest(0, least(size, rest - before)) AS BIGINT) AS taken
FROM e
"""
