"""Remembered units against the tokenizers themselves."""

from __future__ import annotations

import random
import zlib

import edges
import numpy as np
import pyarrow.parquet as pq
import pytest
from tokenizers import Tokenizer

from eventloom.llm import packing, tokenfile
from eventloom.llm.tokens import Encoder, encoder, tokenizer_path

ODD = [
    "", " ", "a", " a", "a ", "a  b", "a\nb", "a\n\nb", "\ta b", "it's IT'S don't", "x1234y 12 3.14", "naïve Ärger ÀÉ ß", "東京 tower", "é ö", "😀 😀x", "a b", "a b",
    "a\r\nb", "İstanbul ıi", "ǅ ŉ", "<|endoftext|> <|startoftext|>", "a\u0000b", "–—…", "“quoted” text", "a​b", "x" * 500, "'s't 'S", "½ ² ¼", "_a_ __", "a.b,c;d!",
]


@pytest.mark.parametrize(("name", "keeps"), [("byte_bpe_50k.json", True), ("word_bpe_49k.json", False)])
def test_equals_tokenizer(name, keeps):
    path = tokenizer_path(name)
    plain = Tokenizer.from_file(path)
    plain.encode_special_tokens = True
    rng = random.Random(5)
    mixed = ["".join(rng.choice(ODD) + rng.choice([" ", "\n", "", "  "]) for _ in range(rng.randint(1, 8))) for _ in range(400)]
    texts = [t or "" for t in pq.read_table("/root/testdata/sf0.01/documents.parquet")["text"].to_pylist()]
    texts += ODD + mixed
    found = Encoder(path, keeps).encode(texts)
    for text, got, want in zip(texts, found, plain.encode_batch(texts, add_special_tokens=False), strict=True):
        assert np.frombuffer(got, "<u4").tolist() == want.ids, text[:200]


@pytest.mark.parametrize(("name", "keeps"), [("byte_bpe_50k.json", True), ("word_bpe_49k.json", False)])
def test_operators_equal_untouched_library(name, keeps):
    path, rng = tokenizer_path(name), random.Random(6)
    untouched = Tokenizer.from_file(path)
    marks = ["<|endoftext|>", "<|startoftext|>", "<|ENDOFTEXT|>", "<|endoftext", "end. <|endoftext|> next", "a<|endoftext|>b", "İ<|startoftext|>É"]
    texts = marks + ["".join(rng.choice(ODD + marks) + rng.choice([" ", "\n", "", "  "]) for _ in range(rng.randint(1, 8))) for _ in range(400)]
    for text, got, want in zip(texts, encoder(path, keeps).encode(texts), untouched.encode_batch(texts, add_special_tokens=False), strict=True):
        assert np.frombuffer(got, "<u4").tolist() == want.ids, text


def test_queries_keep_added_tokens(spark):
    docs = edges.documents(spark, ["end. <|endoftext|> next", "plain words"])
    read = {r["doc_id"]: r for r in tokenfile.read_documents(tokenfile.written_segments(docs)).collect()}
    packed = {r["doc_id"]: r for r in packing.pack_documents(docs).collect()}
    crc = lambda name: zlib.crc32(np.asarray([*Tokenizer.from_file(tokenizer_path(name)).encode("end. <|endoftext|> next", add_special_tokens=False).ids, 0], "<u4").tobytes())
    assert (read[0]["n_tokens"], read[1]["start"], read[0]["ids_crc32"]) == (6, 6, crc("byte_bpe_50k.json"))
    assert (packed[0]["length"], packed[0]["ids_crc32"]) == (5, crc("word_bpe_49k.json"))


@pytest.mark.parametrize(("name", "keeps"), [("byte_bpe_50k.json", True), ("word_bpe_49k.json", False)])
def test_known_units_are_not_learned_again(name, keeps, monkeypatch):
    """A text with one new unit learns that one only, and words with a sign behind them equal the tokenizer's own ids."""
    asked, made = [], Encoder(tokenizer_path(name), keeps)
    learn = made.learn
    monkeypatch.setattr(made, "learn", lambda units: (asked.extend(units), learn(units)))
    made.encode(["x one two three"])
    texts = ["x one two three four", "x Über, naïve. s' don't. a_ ab! é; ªb: ab\u0307 a1, ab@ ab' 're. \u0130a,"]
    found = made.encode(texts)
    assert asked[:8].count("two") == 1 and asked.count("four") == 1
    plain = Tokenizer.from_file(tokenizer_path(name))
    for text, got in zip(texts, found, strict=True):
        assert np.frombuffer(got, "<u4").tolist() == plain.encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize(("name", "keeps"), [("byte_bpe_50k.json", True), ("word_bpe_49k.json", False)])
def test_words_are_learned_once(name, keeps, monkeypatch):
    """Signs behind a word don't make it a new unit, and units met again outlive those that are forgotten."""
    asked, made = [], Encoder(tokenizer_path(name), keeps)
    learn = made.learn
    monkeypatch.setattr(made, "learn", lambda units: (asked.extend(units), learn(units)))
    monkeypatch.setattr("eventloom.llm.tokens.REMEMBERED", 20)
    texts = ["x often, often. often! often*** often"] + [f"x often {chr(97 + k)}one {chr(97 + k)}two {chr(97 + k)}three" for k in range(20)]
    plain = Tokenizer.from_file(tokenizer_path(name))
    for text in texts:
        assert np.frombuffer(made.encode([text])[0], "<u4").tolist() == plain.encode(text, add_special_tokens=False).ids
    assert [u for u in asked if u.startswith("often")] == ["often"]
    assert len(made.known) + len(made.older) < 40
