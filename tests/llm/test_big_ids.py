"""Ids beyond the exact doubles beside a null one, through every operator that carries ids."""

from __future__ import annotations

import pytest

from eventloom.llm import jaccard, media, mixing, packing, quality, secrets, tokenfile

BIG = 2**53 + 1


def docs(spark):
    rows = [(BIG, "one two three four five token = abcdefgh12345", "en", "a", 45), (None, "other text", "en", "a", 10), (-BIG, None, None, None, None)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").coalesce(1)


def labels(spark):
    return spark.createDataFrame([(BIG, 1, 0), (5, 0, 0)], "doc_id long, quality int, toxic int")


RUNS = {
    "token file": lambda s: tokenfile.read_documents(tokenfile.written_segments(docs(s))),
    "mix": lambda s: mixing.mix(docs(s)),
    "mixed": lambda s: mixing.mixed_documents(docs(s)),
    "pieces": lambda s: packing.pack_documents(docs(s)),
    "scores": lambda s: quality.quality_scores(docs(s), labels(s)),
    "accepted": lambda s: quality.accepted(docs(s), labels(s), threshold=-1.0),
    "components": lambda s: jaccard.near_duplicate_components(docs(s)),
    "media": lambda s: media.resolved(media.interleaved(media.pages_of(docs(s))), media.media_features(media.stored_media(docs(s)))),
    "secrets": lambda s: secrets.digest_columns(secrets.scan(docs(s))),
    "redacted": lambda s: secrets.redacted(docs(s)),
}


@pytest.mark.parametrize("name", sorted(RUNS))
def test_ids_stay(spark, name):
    rows = RUNS[name](spark).collect()
    assert {r["doc_id"] for r in rows} == {BIG, None, -BIG}
    if name == "scores":
        assert all(r["held_out"] is not None for r in rows)


def test_repeated_labelled_rows(spark):
    """A labelled id on many rows is one bag."""
    many = spark.range(500).selectExpr(f"{BIG} doc_id", "concat('text ', id) text")
    seen = []
    fitted = quality.fitted
    quality.fitted, kept = lambda bags, y: seen.append(len(bags)) or fitted(bags, y), fitted
    try:
        quality.trained(many, labels(spark))
    finally:
        quality.fitted = kept
    assert seen[0] <= 1
