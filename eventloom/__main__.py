"""Thin commands over the plans: `python -m eventloom pilot|evaluate|cost|config`."""

from __future__ import annotations

import argparse
import os
import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from eventloom.functions import vocabulary as V
from eventloom.plans import config, harness
from eventloom.sources import acquire, files

#: Prices per million tokens in and out, tokens of a prompt and of an answer.
PRICES, TOKENS = (0.25, 1.25), (500, 30)


def cost(chains: int, cells: int, calls: int = 2, tokens: tuple[int, int] = TOKENS, prices: tuple[float, float] = PRICES) -> float:
    return chains * cells * calls * sum(t * p for t, p in zip(tokens, prices, strict=True)) / 1e6


def cost_report(chains: int, cells: int, calls: int = 2, tokens: tuple[int, int] = TOKENS, prices: tuple[float, float] = PRICES) -> str:
    """What a run would take: calls, tokens and dollars, in all and per cell."""
    total = chains * cells * calls
    spent = [total * t * p / 1e6 for t, p in zip(tokens, prices, strict=True)]
    lines = [
        ("Cells", f"{cells}"), ("Chains per cell", f"{chains:,}"), ("Calls per chain", f"{calls}"), ("Tokens per call", f"{tokens[0]} in, {tokens[1]} out"),
        ("Calls", f"{total:,}"), ("Tokens in", f"{total * tokens[0]:,}"), ("Tokens out", f"{total * tokens[1]:,}"),
        ("Cost in", f"{spent[0]:.4f} USD"), ("Cost out", f"{spent[1]:.4f} USD"), ("Cost", f"{sum(spent):.4f} USD"),
        ("Per cell", f"{chains * calls:,} calls, {sum(spent) / cells if cells else 0:.4f} USD"),
    ]
    return "\n".join(f"{name + ':':<17}{value}" for name, value in lines)


def gathered(spark: SparkSession, given: argparse.Namespace) -> DataFrame:
    """The events of all wanted cells: records below `records`/cell, or synthetic ones."""
    known, made = config.cells(given.cells_file), None
    for cell in given.cells:
        one = acquire.acquired(spark, known[cell], f"{given.records}/{cell}" if given.records else None, dict(os.environ), given.synthetic)
        made = one if made is None else made.unionByName(one)
    numbered = lambda name: F.when(F.col("cell") == name, F.get_json_object("context", f"$.{ {'nba': 'period', 'csgo': 'round'}[name] }").try_cast("long"))
    return made.withColumns({"period": numbered("nba"), "round": numbered("csgo")})


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="eventloom")
    parser.add_argument("command", choices=("pilot", "evaluate", "cost", "config"))
    parser.add_argument("--cells", nargs="+", default=list(V.CELLS))
    parser.add_argument("--records", help="folder with one folder of records per cell")
    parser.add_argument("--synthetic", action="store_true")
    parser.add_argument("--chains", type=int, default=harness.WANTED, help="chains of a cell at most")
    parser.add_argument("--cells-file", help="YAML file of the cells")
    given = parser.parse_args(argv)
    if given.command == "cost":
        print(f"{cost(given.chains, len(given.cells)):.2f} USD for {given.chains * len(given.cells) * 2} calls")
        print(cost_report(given.chains, len(given.cells)))
        return 0
    if given.command == "config":
        missing = config.missing_credentials({k: v for k, v in config.cells(given.cells_file).items() if k in given.cells}, dict(os.environ))
        for cell, names in missing.items():
            print(f"{cell}: {'missing ' + ', '.join(names) if names else 'ready'}")
        return int(any(missing.values()))
    spark = SparkSession.builder.appName("eventloom").getOrCreate()
    events = gathered(spark, given)
    if given.command == "pilot":
        report = harness.pilot(events, tuple(given.cells))
        print(files.report_markdown(report.drop("event_types", "warnings")))
        return int(not report.where("not passed").isEmpty())
    print(files.report_markdown(harness.consistency_run(events, tuple(given.cells), given.chains)))
    return 0


if __name__ == "__main__":
    sys.exit(main())
