"""Two-condition answers: pairing, scores, contingency tables and the tests on them."""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce
from operator import and_
from statistics import NormalDist

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from eventloom.functions import vocabulary as V
from eventloom.functions.decimals import fixed
from eventloom.functions.expressions import custom_id_parts
from eventloom.operators.ordinals import with_ordinals


def paired(responses: DataFrame) -> DataFrame:
    """One row per (index, chain) from responses (custom_id, text): baseline and intervention answers."""
    parts = responses.select(custom_id_parts(F.col("custom_id")).alias("p"), "text").select("p.*", "text")
    side = lambda v: F.first(F.when(F.col("variant") == v, F.col("text")), ignorenulls=True).alias(v)
    return parts.groupBy("index", "chain").agg(side("baseline"), side("intervention"))


def answered(requests: DataFrame, responses: DataFrame) -> DataFrame:
    """Requests with their answers; a missing one is the empty answer, which abstains."""
    return requests.join(responses, "custom_id", "left").withColumn("text", F.coalesce("text", F.lit("")))


def positional(chains: DataFrame, truths: DataFrame, baseline: DataFrame, intervention: DataFrame) -> DataFrame:
    """cell, place, chain_id, truth, baseline_raw, intervention_raw from four lists by place.

    `chains` has cell, place, chain_id, `truths` cell, place, text, the answers cell, place, chain_id, text. A place that
    some list lacks or has twice, or whose answers are another chain's, raises: a batch that came back short or in
    another order would pair wrong answers.
    """
    sides = {"truth": truths, "baseline": baseline, "intervention": intervention}
    rows = chains.select("cell", "place", "chain_id", F.lit("chain").alias("side"), F.lit(None).cast("string").alias("text"))
    for name, side in sides.items():
        id = F.col("chain_id") if "chain_id" in side.columns else F.lit(None).cast("string").alias("chain_id")
        rows = rows.unionByName(side.select("cell", "place", id, F.lit(name).alias("side"), F.col("text").cast("string")))
    of = lambda side, what: F.first(F.when(F.col("side") == side, F.col(what)), ignorenulls=True)
    each = [F.count_if(F.col("side") == s) for s in ("chain", *sides)]
    whole = reduce(and_, [n == 1 for n in each])
    per = rows.groupBy("cell", "place").agg(
        of("chain", "chain_id").alias("chain_id"), of("truth", "text").alias("truth"), of("baseline", "text").alias("baseline_raw"), of("intervention", "text").alias("intervention_raw"),
        whole.alias("_whole"), F.count_distinct(F.when(F.col("side") != "truth", F.col("chain_id"))).alias("_ids"),
    )
    told = lambda what: F.raise_error(F.concat(F.lit(f"{what} in cell "), F.coalesce("cell", F.lit("?")), F.lit(" at place "), F.col("place").cast("string"))).cast("boolean")
    good = F.when(~F.col("_whole"), told("lists of different length")).when(F.col("_ids") > 1, told("answers of another chain")).otherwise(F.lit(True))
    return per.where(good).drop("_whole", "_ids")


def summary() -> Column:
    """One line of a tested table (cell, n, b, c, statistic, p, p_corrected, significant, h, lo, hi)."""
    sign = F.when(F.col("significant"), "SIGNIFICANT").otherwise("not significant")
    numbers = [F.coalesce(fixed(F.col(c), 4), F.lit("?")) for c in ("statistic", "p", "p_corrected", "h", "lo", "hi")]
    return F.format_string("[%s] McNemar n=%d b=%d c=%d χ²=%s p=%s p_corr=%s (%s) h=%s 95%%CI=[%s,%s]", "cell", "n", "b", "c", *numbers[:3], sign, *numbers[3:])


def aggregate(tables: DataFrame) -> DataFrame:
    """One row over the tested tables of all cells: n_cells, n_cells_significant, total_chains, total_discordant, pooled_chi2 and
    pooled_p of the discordant pairs of all cells together, cell_summaries, a line per cell in the order of cells.

    Without tables all counts are 0 and p is 1.
    """
    line = F.struct("cell", summary().alias("line"))
    sums = tables.agg(
        F.count("*").alias("n_cells"), F.count_if("significant").alias("n_cells_significant"), F.coalesce(F.sum("n"), F.lit(0)).alias("total_chains"),
        F.coalesce(F.sum("b"), F.lit(0)).alias("b"), F.coalesce(F.sum("c"), F.lit(0)).alias("c"), F.array_sort(F.collect_list(line)).alias("_lines"),
    )
    tested = with_p(sums.withColumn("statistic", statistic()))
    return tested.select(
        "n_cells", "n_cells_significant", "total_chains", (F.col("b") + F.col("c")).alias("total_discordant"), F.col("statistic").alias("pooled_chi2"), F.col("p").alias("pooled_p"),
        F.transform("_lines", lambda x: x["line"]).alias("cell_summaries"),
    )


def contingency(pairs: DataFrame, by: list[str]) -> DataFrame:
    """n, a, b, c, d from baseline_ok and intervention_ok; a pair with a null on either side is left out.

    b: only the baseline is right, c: only the intervention.
    """
    x, y = F.col("baseline_ok"), F.col("intervention_ok")
    return pairs.where(x.isNotNull() & y.isNotNull()).groupBy(*by).agg(
        F.count("*").alias("n"), F.count_if(x & y).alias("a"), F.count_if(x & ~y).alias("b"), F.count_if(~x & y).alias("c"), F.count_if(~x & ~y).alias("d")
    )


def statistic(corrected: bool = True) -> Column:
    """McNemar's chi square from b and c, 0 without discordant pairs."""
    off = F.abs(F.col("b") - F.col("c")) - (1 if corrected else 0)
    return F.coalesce(F.try_divide((off * off).cast("double"), F.col("b") + F.col("c")), F.lit(0.0))


def effect() -> Column:
    """Cohen's h on the discordant shares c/n and b/n."""
    share = lambda k: F.asin(F.sqrt(F.coalesce(F.try_divide(F.col(k).cast("double"), F.col("n")), F.lit(0.0))))
    return 2 * (share("c") - share("b"))


def exact_p() -> Column:
    """The two-sided exact binomial p of b against c, for fewer than 25 discordant pairs; null otherwise.

    Terms comb(n, i) come one from the other, so nothing overflows.
    """
    total, low = F.col("b") + F.col("c"), F.least("b", "c")
    tail = F.expr("aggregate(sequence(0, least(b, c)), named_struct('t', cast(1 as double), 's', cast(0 as double)), (s, i) -> named_struct('t', s.t * (b + c - i) / (i + 1), 's', s.s + s.t)).s")
    return F.when((total > 0) & (total < 25), F.least(F.lit(1.0), 2 * tail / F.pow(F.lit(2.0), total))).when(total == 0, F.lit(1.0))


def _chi_tail(x: float) -> float:
    return math.erfc(math.sqrt(max(x, 0.0) / 2))


def _per_row(rows: DataFrame, name: str, made, columns: list[str]) -> DataFrame:  # noqa: ANN001
    """A number per row of a result that has one row per cell: special functions that Spark lacks."""

    def filled(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in batches:
            yield part.assign(**{name: [float(made(*x)) for x in part[columns].itertuples(index=False)]})

    return rows.mapInPandas(filled, T.StructType([*rows.schema, T.StructField(name, T.DoubleType())]))


def with_p(tables: DataFrame) -> DataFrame:
    """Adds p from `statistic` by erfc, which doesn't underflow where 1 - cdf does; 1 without discordant pairs."""
    return _per_row(tables, "p", lambda x, b, c: _chi_tail(x) if b + c else 1.0, ["statistic", "b", "c"])


def with_chosen_p(tables: DataFrame) -> DataFrame:
    """Adds p and method: exact binomial for fewer than 25 discordant pairs, else chi square with continuity correction."""
    total = F.col("b") + F.col("c")
    rows = _per_row(tables.withColumn("_statistic", statistic()), "p", _chi_tail, ["_statistic"])
    method = F.when(total == 0, "no_discordance").when(total < 25, "exact_binomial").otherwise("chi2_with_cc")
    return rows.withColumn("p", F.coalesce(exact_p(), F.col("p"))).withColumn("method", method).drop("_statistic")


def corrected(tables: DataFrame, tests: int = V.BONFERRONI, alpha: float = V.ALPHA) -> DataFrame:
    """Adds p_corrected (Bonferroni) and significant."""
    p = F.least(F.col("p") * tests, F.lit(1.0))
    return tables.withColumn("p_corrected", p).withColumn("significant", p < alpha)


def with_power(tables: DataFrame, alpha: float = V.ALPHA, power: float = 0.8) -> DataFrame:
    """Adds power (after the fact, in [0, 1]) and mde, the least difference that n pairs detect."""
    z, law = NormalDist().inv_cdf(1 - alpha / 2), NormalDist()
    mde = (z + law.inv_cdf(power)) / F.sqrt(F.greatest(F.col("n"), F.lit(1)))
    found = _per_row(tables, "power", lambda b, c: min(1.0, max(0.0, law.cdf(abs(b - c) / math.sqrt(b + c) - z))) if b + c else 0.0, ["b", "c"])
    return found.withColumn("mde", mde)


def interim(tables: DataFrame, alpha: float = V.ALPHA, least: float = 0.04) -> DataFrame:
    """Adds delta, p_discordant, projected power by the non-central chi-square law of one degree, and pause."""
    z, law = NormalDist().inv_cdf(1 - alpha / 2), NormalDist()
    delta = F.coalesce(F.try_divide((F.col("c") - F.col("b")).cast("double"), F.col("n")), F.lit(0.0))
    rows = tables.withColumn("delta", delta).withColumn("p_discordant", F.coalesce(F.try_divide((F.col("b") + F.col("c")).cast("double"), F.col("n")), F.lit(0.0)))

    def projected(d: float, p: float, n: int) -> float:
        root = math.sqrt(n * d * d / p) if p else 0.0
        return 1 - (law.cdf(z - root) - law.cdf(-z - root))

    return _per_row(rows, "projected_power", projected, ["delta", "p_discordant", "n"]).withColumn("pause", F.abs("delta") < least)


def pooled(pairs: DataFrame, by: str) -> DataFrame:
    """The contingency per cell and over all (null cell), from one pass with grouping sets."""
    x, y = F.col("baseline_ok"), F.col("intervention_ok")
    counts = [F.count("*").alias("n"), F.count_if(x & y).alias("a"), F.count_if(x & ~y).alias("b"), F.count_if(~x & y).alias("c"), F.count_if(~x & ~y).alias("d")]
    return pairs.where(x.isNotNull() & y.isNotNull()).rollup(by).agg(*counts)


def leakage(effects: DataFrame) -> DataFrame:
    """ratio of |control| to |primary| effects, null for a primary below 0.01, and suspected: of one sign and over 0.5."""
    ratio = F.when(F.abs("primary") >= 0.01, F.abs("control") / F.abs("primary"))
    same = F.signum("control") == F.signum("primary")
    return effects.withColumn("ratio", ratio).withColumn("suspected", F.coalesce(same & (ratio > 0.5), F.lit(False)))


def bootstrap(pairs: DataFrame, by: str, index: str, iterations: int = 200, seed: int = 42) -> DataFrame:
    """Per cell: lo and hi, 2.5 and 97.5 percentiles of the difference of accuracies over resamples.

    Draws are keyed hashes, so all resamples are one distributed join of iterations x pairs places with the pairs at them,
    with no random state. Draws stream past the pairs of their share of places and are summed at once: no task holds or
    sorts them.
    """
    value = F.col("intervention_ok").cast("int") - F.col("baseline_ok").cast("int")
    ranked = with_ordinals(pairs.select(by, index, value.alias("v")), [by], [index], "at", "n")
    draws = ranked.select(by, F.explode(F.sequence(F.lit(0), F.lit(iterations - 1))).alias("iteration"), "at", "n")
    key = F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(seed), F.col("iteration"), F.col(by), F.col("at")).cast("binary")), 1, 12), 16, 10).cast("long")
    taken = draws.select(by, "iteration", (key % F.col("n")).alias("at"))
    drawn = taken.join(ranked.select(by, "at", "v", "n").hint("shuffle_hash"), [by, "at"])
    means = drawn.groupBy(by, "iteration").agg((F.sum("v").cast("double") / F.first("n")).alias("delta"))
    return means.groupBy(by).agg(F.percentile("delta", 0.025).alias("lo"), F.percentile("delta", 0.975).alias("hi"))
