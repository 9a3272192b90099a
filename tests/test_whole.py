"""Queries over whole hands, texts and resamples against sequential versions."""

from __future__ import annotations

import json
import math
import re

import numpy as np
import pytest
from comparing import SF_DIR, duck
from pyspark.sql import functions as F

from eventloom.functions import expressions as X
from eventloom.operators import pairing as P
from eventloom.plans import harness as H
from eventloom.plans import queries as Q
from eventloom.plans.tables import EVENTS_SQL


def test_stack_fold_whole(spark):
    rows = duck(SF_DIR).execute(f"WITH {EVENTS_SQL} SELECT game_id, sequence_idx, k, event_type FROM ev ORDER BY game_id, sequence_idx").fetchall()
    want, at = {}, None
    for hand, step, k, kind in rows:
        if hand != at:
            at, stacks, put, pot, bet = hand, [1000] * 3, [0] * 3, 0, 0
        seat, amount = k % 3, k * 3 % 400
        move = {"player_idle": "deal", "zone_enter": "fold", "resource_spend": "raise"}.get(kind, "call")
        added = {"raise": max(0, amount - put[seat]), "call": min(max(0, bet - put[seat]), stacks[seat])}.get(move, 0)
        stacks[seat], pot = max(0, stacks[seat] - added), pot + added
        if move == "deal":
            put, bet = [0] * 3, 0
        elif move == "raise":
            put[seat] = bet = amount
        else:
            put[seat] += added
        want[hand, step] = (seat, move, stacks[seat], pot, bet)
    got = {(r["hand"], r["step"]): tuple(r)[2:] for r in Q.QUERIES["stack_fold_whole"](spark, SF_DIR).collect()}
    assert max(step for _, step in want) > 12 and len(got) == len(rows) and got == want


ABSTAIN = re.compile(r"^\s*(i\s*don'?t\s*know|abstain|n/?a|unknown|cannot\s*determine|insufficient|no\s*answer|skip)\s*\.?\s*$", re.I)
FILL = "word " * 400


def strict(raw):
    s = (raw or "").strip()
    if not s or ABSTAIN.search(s):
        return ""
    if s.startswith("{") and s.endswith("}"):
        try:
            made = json.loads(s)
            return next(str(made[k]).strip().lower() for k in ("answer", "prediction", "response", "value") if k in made)
        except (ValueError, StopIteration):
            pass
    first = re.sub(r"[.!?,]+$", "", re.split(r"\r\n|\n|\r", s)[0].strip()).lower()
    return first if first in ("yes", "no") else ""


def lenient(raw):
    first = (raw or "").strip().split("\n")[0].strip().lower()
    return next((x for x in ("yes", "no") if first.startswith(x)), None)


def cited(raw):
    found = None if raw is None else re.search(r"^\s*RULE:\s*(.+)$", raw, re.I | re.M)
    return None if raw is None else found[1] if found else ""


LONG = [
    ("Yes.\n" + FILL, "yes", "yes"), ("  no,\r\n" + FILL, "no", "no"), ("Yes, since " + FILL, "", "yes"), (FILL + "\nyes", "", None),
    ('{"why": "' + FILL + '", "answer": "Yes"}', "yes", None), ("\n" * 30 + "NO!", "no", "no"), ("  yes  ", "yes", "yes"), ("No.", "no", "no"), ("I don't know", "", None), ("", "", None), ("yes, since\nno", "", "yes"), (None, "", None),
]


@pytest.mark.parametrize(("name", "columns", "brute"), [("parse_strict_texts", ("doc_id",), strict), ("parse_lenient_texts", ("doc_id",), lenient), ("cited_rules_texts", ("conv_id", "turn"), cited)])
def test_whole_texts(spark, tmp_path, name, columns, brute):
    """On the table and on a table of long answers whose end decides."""
    source = "conversations" if "turn" in columns else "documents"
    real = spark.read.parquet(f"{SF_DIR}/{source}.parquet").select(*columns, "text")
    made = [*[x for x, *_ in LONG], FILL + "\n  rule: the " + FILL + "end", "Rule: first\nRULE: second"]
    rows = [(-1 - i, *[0] * (len(columns) - 1), t) for i, t in enumerate(made)]
    real.unionByName(spark.createDataFrame(rows, f"{', '.join(f'{c} long' for c in columns)}, text string").select(*[F.col(c).cast(real.schema[c].dataType) for c in columns], "text")).write.parquet(f"{tmp_path}/{source}.parquet")
    want = [(*r[:-1], brute(r["text"])) for r in spark.read.parquet(f"{tmp_path}/{source}.parquet").collect()]
    got = [tuple(r) for r in Q.QUERIES[name](spark, str(tmp_path)).collect()]
    assert sorted(map(repr, got)) == sorted(map(repr, want)) and len(got) == real.count() + len(rows)


def test_long_answers(spark):
    rows = spark.createDataFrame([(i, t) for i, (t, *_) in enumerate(LONG)], "i long, raw string")
    got = rows.select("i", X.parse_strict(F.col("raw"), ("yes", "no")).alias("s"), X.parse_lenient(F.col("raw")).alias("l")).orderBy("i").collect()
    assert [(r["s"], r["l"]) for r in got] == [(s, x) for _, s, x in LONG] == [(strict(t), lenient(t)) for t, *_ in LONG]


def resamples(values, iterations, seed=7):
    """Means of resampled values, one by one."""
    rng = np.random.default_rng(seed)
    return np.array([values[rng.integers(0, len(values), len(values))].mean() for _ in range(iterations)])


def test_bootstrap_interval_whole(spark):
    per = {}
    for lang, quality in duck(SF_DIR).execute("SELECT lang, quality FROM documents JOIN labels USING (doc_id)").fetchall():
        per.setdefault(lang, []).append(quality == 1)
    got = {r["cell"]: (r["lo"], r["hi"]) for r in Q.QUERIES["bootstrap_interval_whole"](spark, SF_DIR).collect()}
    assert got.keys() == per.keys()
    for cell, values in per.items():
        x = np.array(values, float)
        # A draw's value moves in steps of 1 / n.
        assert got[cell] == pytest.approx(tuple(np.quantile(resamples(x, 10_000), [0.025, 0.975])), abs=1.01 / len(x) + 0.1 * x.std() / math.sqrt(len(x)))


def test_second_design(spark):
    tables = spark.createDataFrame([("none", 0, 0, 0), ("few", 50, 3, 9), ("edge", 90, 8, 16), ("next", 90, 8, 17), ("many", 400, 60, 100), ("even", 80, 20, 20)], "cell string, n long, b long, c long")
    got = {r["cell"]: r for r in H.ordered_bounds(P.with_chosen_p(tables)).collect()}
    exact = lambda b, c: min(1.0, 2 * sum(math.comb(b + c, i) for i in range(min(b, c) + 1)) / 2 ** (b + c))
    chi = lambda b, c: math.erfc(math.sqrt((abs(b - c) - 1) ** 2 / (b + c) / 2))
    for cell, b, c, p, method in [("few", 3, 9, exact, "exact_binomial"), ("edge", 8, 16, exact, "exact_binomial"), ("next", 8, 17, chi, "chi2_with_cc"), ("many", 60, 100, chi, "chi2_with_cc"), ("even", 20, 20, chi, "chi2_with_cc")]:
        assert (got[cell]["p"], got[cell]["method"]) == (pytest.approx(p(b, c)), method)
    none = got["none"]
    assert (none["p"], none["method"], none["delta"], none["lo"], none["hi"]) == (1.0, "no_discordance", 0.0, 0.0, 0.0)
    r = got["many"]
    drawn = np.sort(resamples(np.repeat([-1.0, 1.0, 0.0], [60, 100, 240]), 5_000))
    assert (r["delta"], r["lo"], r["hi"]) == (pytest.approx(0.1), pytest.approx(drawn[125], abs=0.006), pytest.approx(drawn[4875], abs=0.006))
    # Order statistics are draws themselves.
    assert all(abs(r[k] * r["n"] - round(r[k] * r["n"])) < 1e-9 for r in got.values() for k in ("lo", "hi"))
    assert {r["method"] for r in Q.QUERIES["second_design"](spark, SF_DIR).collect()}
