"""Resamples by keyed hashes against drawing them one by one, and what their tasks hold."""

from __future__ import annotations

import hashlib
import re

import numpy as np

from eventloom.operators import pairing as P


def pairs_of(spark):
    made = [("a" if i % 3 else "b", i, None if i % 17 == 5 else i % 5 > 1, i % 7 == 0) for i in range(400)] + [(None, 1, True, False)]
    return made, spark.createDataFrame(made, "cell string, i long, intervention_ok boolean, baseline_ok boolean").repartition(3)


def test_bounds_of_resamples(spark):
    made, pairs = pairs_of(spark)
    found = {r["cell"]: (r["lo"], r["hi"]) for r in P.bootstrap(pairs, "cell", "i", iterations=30).collect()}
    assert set(found) == {"a", "b"}
    for cell, (lo, hi) in found.items():
        v = [None if y is None else int(y) - int(x) for c, _, y, x in sorted(made, key=lambda r: r[1]) if c == cell]
        deltas = []
        for k in range(30):
            at = [int(hashlib.md5(f"42:{k}:{cell}:{place}".encode()).hexdigest()[:12], 16) % len(v) for place in range(len(v))]
            deltas.append(sum(v[x] or 0 for x in at) / len(v))
        assert np.allclose([lo, hi], np.quantile(deltas, [0.025, 0.975]), rtol=0, atol=1e-12)


def test_no_task_holds_the_draws(spark):
    # Draws counted by place were as many groups as draws; only sums per cell and resample are aggregated.
    plan = P.bootstrap(pairs_of(spark)[1], "cell", "i", iterations=30)._jdf.queryExecution().executedPlan().toString()
    keys = re.findall(r"(?:Hash|Sort|ObjectHash)Aggregate\(keys=\[([^\]]*)\]", plan)
    assert keys and not any(re.search(r"\bat#", k) for k in keys)
    assert "ShuffledHashJoin" in plan
