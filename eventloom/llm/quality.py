"""Document quality by attention-based multiple-instance learning.

A document is a bag of passages. Every passage is encoded from its bytes; gated attention weights, learned from document
labels alone, form the weighted passage representation that is scored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from eventloom.llm.common import mapped, remembering

#: Bytes of a passage.
PASSAGE = 400
#: Labelled documents that the model is fitted on, at most, and passages of one of them (evenly spread).
SAMPLE = 4_000
SAMPLE_PASSAGES = 64
HIDDEN, ATTENTION, EPOCHS, BATCH, RATE, DECAY, SEED = 32, 16, 20, 64, 3e-3, 1e-4, 11
THRESHOLD = 0.7
#: Characters of texts that are encoded at once; an encoder's arrays take some 60 bytes for each.
SLICE_BYTES = 1 << 19


def byte_kinds() -> tuple[np.ndarray, int, np.ndarray, int]:
    """Fine kinds (each punctuation mark its own) and coarse ones of all bytes."""
    fine, coarse, n = np.zeros(256, np.int64), np.zeros(256, np.int64), 7
    for b in range(256):
        c = chr(b)
        if b >= 128:
            fine[b], coarse[b] = (1, 1) if b < 192 else (2, 2)
        elif c.islower():
            fine[b] = coarse[b] = 3
        elif c.isupper():
            fine[b] = coarse[b] = 4
        elif c.isdigit():
            fine[b] = coarse[b] = 5
        elif c == " ":
            fine[b] = coarse[b] = 6
        elif c.isprintable():
            fine[b], coarse[b], n = n, 7, n + 1
    return fine, n, coarse, 8


FINE, N_FINE, COARSE, N_COARSE = byte_kinds()
#: Places back at which equal bytes are counted: repeated words and lines show there.
LAGS = 16
#: Shares of fine kinds, of coarse pairs, of bytes equal to the one 1..LAGS before; words' mean length; fill.
WIDTH = N_FINE + N_COARSE**2 + LAGS + 2


def encoded(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Features of all passages of all texts, and where each text's passages start. An empty text has one passage."""
    blobs = [(t or "").encode("utf-8", "surrogatepass") for t in texts]
    sizes = np.array([len(b) for b in blobs])
    counts = np.maximum(1, -(-sizes // PASSAGE))
    starts = np.concatenate([[0], np.cumsum(counts)])
    data = np.frombuffer(b"".join(blobs), np.uint8)
    total = int(starts[-1])
    ends = np.cumsum(sizes)
    inside = np.arange(len(data)) - np.repeat(ends - sizes, sizes)
    place = np.repeat(starts[:-1], sizes) + inside // PASSAGE
    fine = np.bincount(place * N_FINE + FINE[data], minlength=total * N_FINE).reshape(total, N_FINE).astype(np.float32)
    length = fine.sum(1, keepdims=True)
    some = np.maximum(length, 1)
    kinds = COARSE[data]
    pairs = np.zeros(total * N_COARSE**2, np.float32)
    repeats = np.zeros((total, LAGS), np.float32)
    if len(data):
        # Neighbours in the same text only, so that a text's features don't depend on the batch.
        pairs = np.bincount((place[1:] * N_COARSE + kinds[:-1]) * N_COARSE + kinds[1:], weights=inside[1:] > 0, minlength=total * N_COARSE**2).astype(np.float32)
        held = np.flatnonzero(np.r_[True, place[1:] != place[:-1]])
        for k in range(1, min(LAGS + 1, len(data))):
            equal = np.zeros(len(data), bool)
            np.logical_and(data[k:] == data[:-k], inside[k:] >= k, out=equal[k:])
            repeats[place[held], k - 1] = np.add.reduceat(equal, held, dtype=np.int32)
    spaces = fine[:, 6:7] + fine[:, 0:1]
    return np.hstack([fine / some, pairs.reshape(total, -1) / some, repeats / some, some / (spaces + 1) / 10, length / PASSAGE]).astype(np.float32), starts


@dataclass
class Model:
    mean: np.ndarray
    scale: np.ndarray
    weights: dict[str, np.ndarray]

    def forward(self, x: np.ndarray, starts: np.ndarray) -> dict[str, np.ndarray]:
        """`starts` ends with the number of passages."""
        w, first = self.weights, starts[:-1]
        bag = np.repeat(np.arange(len(first)), np.diff(starts))
        x = np.clip((x - self.mean) / self.scale, -8, 8)
        h = np.tanh(x @ w["w"] + w["b"])
        t, s = np.tanh(h @ w["v"]), 1 / (1 + np.exp(-(h @ w["u"])))
        e = (t * s) @ w["a"]
        e = np.exp(e - np.maximum.reduceat(e, first)[bag])
        a = e / np.add.reduceat(e, first)[bag]
        z = np.add.reduceat(a[:, None] * h, first)
        return {"x": x, "bag": bag, "h": h, "t": t, "s": s, "a": a, "z": z, "p": 1 / (1 + np.exp(-np.clip(z @ w["c"] + w["d"], -30, 30)))}

    def scores(self, texts: list[str | None]) -> np.ndarray:
        x, starts = encoded(texts)
        return self.forward(x, starts)["p"].astype(float)


def gradients(model: Model, f: dict[str, np.ndarray], first: np.ndarray, y: np.ndarray, weight: np.ndarray) -> dict[str, np.ndarray]:
    w, bag, h, t, s, a = model.weights, f["bag"], f["h"], f["t"], f["s"], f["a"]
    ds = (f["p"] - y) * weight / len(y)
    dz = (ds[:, None] * w["c"])[bag]
    da = (dz * h).sum(1)
    de = a * (da - np.add.reduceat(a * da, first)[bag])
    dg = de[:, None] * w["a"]
    dt, dsig = dg * s * (1 - t * t), dg * t * s * (1 - s)
    dh = (a[:, None] * dz + dt @ w["v"].T + dsig @ w["u"].T) * (1 - h * h)
    return {"w": f["x"].T @ dh, "b": dh.sum(0), "v": h.T @ dt, "u": h.T @ dsig, "a": (t * s).T @ de, "c": f["z"].T @ ds, "d": ds.sum(keepdims=True)}


def fitted(bags: list[np.ndarray], labels: np.ndarray) -> Model:
    """Adam on class-balanced cross entropy. Without labels of both kinds, the model scores their mean, or 0.5."""
    rng = np.random.default_rng(SEED)
    normal = lambda *shape: (rng.standard_normal(shape) / np.sqrt(shape[0])).astype(np.float32)
    weights = {"w": normal(WIDTH, HIDDEN), "b": np.zeros(HIDDEN, np.float32), "v": normal(HIDDEN, ATTENTION), "u": normal(HIDDEN, ATTENTION), "a": normal(ATTENTION), "c": normal(HIDDEN), "d": np.zeros(1, np.float32)}
    if len(set(labels.tolist())) < 2:
        share = float(np.clip(labels.mean(), 0.01, 0.99)) if len(labels) else 0.5
        weights["c"] = np.zeros(HIDDEN, np.float32)
        weights["d"] = np.array([np.log(share / (1 - share))], np.float32)
        return Model(np.zeros(WIDTH, np.float32), np.ones(WIDTH, np.float32), weights)
    every = np.concatenate(bags)
    model = Model(every.mean(0), every.std(0) + 1e-3, weights)
    share = labels.mean()
    balance = np.where(labels == 1, 0.5 / share, 0.5 / (1 - share)).astype(np.float32)
    moment = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in weights.items()}
    step = 0
    for epoch in range(EPOCHS):
        rate = RATE * (1 - epoch / EPOCHS)
        order = rng.permutation(len(bags))
        for at in range(0, len(order), BATCH):
            chosen = order[at : at + BATCH]
            starts = np.concatenate([[0], np.cumsum([len(bags[i]) for i in chosen])])
            f = model.forward(np.concatenate([bags[i] for i in chosen]), starts)
            step += 1
            for k, g in gradients(model, f, starts[:-1], labels[chosen], balance[chosen]).items():
                m, v = moment[k]
                g = g + DECAY * weights[k]
                m += 0.1 * (g - m)
                v += 0.001 * (g * g - v)
                weights[k] -= (rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)).astype(np.float32)
    return model


def fold(id: str) -> Column:
    """crc32 of the id as text, modulo 4; null for a null id."""
    return F.crc32(F.col(id).cast("string").cast("binary")) % 4


def trained(docs: DataFrame, labels: DataFrame, held_out: int = 2, sample: int = SAMPLE) -> Model:
    """Fits on up to `sample` labelled documents outside the held-out fold, chosen by a hash of their ids.

    Texts are encoded where they lie; the driver gets at most `sample` bags of SAMPLE_PASSAGES passages: of rows that
    share a labelled id, the first by the hash of their text is the document.
    """
    usable = labels.where("doc_id is not null and quality in (0, 1)").where(fold("doc_id") != held_out)
    chosen = usable.groupBy("doc_id").agg(F.max("quality").cast("int").alias("quality")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)

    def bags(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        remembering("quality")
        for part in batches:
            x, starts = encoded(part.column("text").to_pylist())
            kept = [np.unique(np.linspace(s, e - 1, min(e - s, SAMPLE_PASSAGES)).round().astype(int)) for s, e in zip(starts[:-1], starts[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("quality"), pa.array([x[k].tobytes() for k in kept], pa.binary())], ["doc_id", "quality", "bag"])

    # At most `sample` rows are broadcast.
    joined = docs.select(F.col("doc_id").cast("long"), "text").join(F.broadcast(chosen.withColumn("doc_id", F.col("doc_id").cast("long"))), "doc_id")
    single = joined.groupBy("doc_id", "quality").agg(F.min_by("text", F.xxhash64("text")).alias("text"))
    rows = sorted(mapped(single.select("doc_id", "quality", "text"), bags, "doc_id long, quality int, bag binary").collect(), key=lambda r: r["doc_id"])
    return fitted([np.frombuffer(r["bag"], np.float32).reshape(-1, WIDTH) for r in rows], np.array([r["quality"] for r in rows], np.float32))


def scores_of(texts: pa.Array, model: Model) -> np.ndarray:
    """As many texts at a time as have about SLICE_BYTES keep the byte arrays small."""
    remembering("quality")
    found, some, held = [], [], 0
    for text in texts.to_pylist():
        some.append(text)
        held += len(text or "")
        if held >= SLICE_BYTES:
            found.append(model.scores(some))
            some, held = [], 0
    if some:
        found.append(model.scores(some))
    return np.concatenate(found) if found else np.empty(0)


def scored(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """`docs` with score (0 to 1) and predicted (1 from `threshold` on): all passages of the whole texts, in one map stage.

    Null and empty texts are one empty passage; repeated rows score alike; an empty table gives an empty result; columns
    of these two names are replaced.
    """
    rest = docs.drop("score", "predicted")
    schema = rest.select("*", F.lit(0.0).alias("score"), F.lit(0).alias("predicted")).schema

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in batches:
            scores = scores_of(part.column("text"), model)
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array(scores), pa.array((scores >= threshold).astype(np.int32))], [*part.schema.names, "score", "predicted"])

    return mapped(rest, made, schema)


def quality_scores(docs: DataFrame, labels: DataFrame, held_out: int = 2) -> DataFrame:
    """doc_id, held_out, score, predicted for all documents; one without an id is in no fold, so not held out."""
    model = trained(docs, labels, held_out)
    done = scored(docs.select("doc_id", "text"), model)
    return done.select("doc_id", F.coalesce(fold("doc_id") == held_out, F.lit(False)).alias("held_out"), "score", "predicted")


def accepted(docs: DataFrame, labels: DataFrame, held_out: int = 2, threshold: float = THRESHOLD) -> DataFrame:
    """The documents that the classifier accepts, with the columns of `docs`.

    Null and empty texts are judged as one empty passage, repeated rows alike; a null id doesn't matter; an empty table
    stays empty; long texts are scored whole; other columns pass through, whatever their names.
    """
    model = trained(docs, labels, held_out)

    def kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in batches:
            yield part.filter(pa.array(scores_of(part.column("text"), model) >= threshold))

    return mapped(docs, kept, docs.schema)
