"""Fixed decimals against Python's own, on ties, signs, sizes and random doubles."""

from __future__ import annotations

import math
import random
import struct

import pytest
from pyspark.sql import functions as F

from eventloom.functions.decimals import fixed, rounded


def numbers():
    draw = random.Random(8)
    some = [0.0, -0.0, 2.25, 2.35, 0.05, 0.15, 0.25, -0.04, -0.05, 0.5, 1.5, 2.5, 1e15, 2.0**52, 2.0**53 + 2, 1e18, 9e18, 1e22, 1e23, 3e37, 5e-324, 4503599627370495.5, 0.1 + 0.2, 1e300 * 0]
    some += [k / 8 for k in range(-40, 40)] + [k / 16 + 1e6 for k in range(40)] + [2.0**50 + k / 4 for k in range(9)] + [2.0**49 + k / 8 for k in range(17)]
    for _ in range(20_000):
        some.append(draw.choice([draw.uniform(-100, 100), draw.uniform(-1e6, 1e6), round(draw.uniform(0, 1000), 2) + 0.005, draw.uniform(0, 2.0**53), draw.randrange(10**6) / 1000, 10 ** draw.uniform(-5, 37)]))
    bits = [struct.unpack("d", struct.pack("Q", draw.getrandbits(64)))[0] for _ in range(5_000)]
    return some + [x for x in bits if math.isfinite(x) and abs(x) < 1e38]


@pytest.mark.parametrize("places", [0, 1, 2, 3])
def test_as_python(spark, places):
    some = numbers()
    rows = spark.createDataFrame([(x,) for x in some], "x double").select("x", fixed(F.col("x"), places, 7).alias("t"), rounded(F.col("x"), places).alias("r")).collect()
    assert len(rows) == len(some)
    wrong = [(r["x"], r["t"], f"{r['x']:7.{places}f}") for r in rows if r["t"] != f"{r['x']:7.{places}f}" or r["r"] != round(r["x"], places)]
    assert not wrong, wrong[:5]


def test_odd_values(spark):
    rows = spark.createDataFrame([(float("nan"),), (float("inf"),), (float("-inf"),), (None,)], "x double").select(fixed(F.col("x"), 1).alias("t")).collect()
    assert [r["t"] for r in rows] == ["nan", "inf", "-inf", None]
    with pytest.raises(ValueError):
        fixed(F.col("x"), 9)
