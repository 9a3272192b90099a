from __future__ import annotations

import json
import random

from eventloom.llm import chat

SCHEMAS = {"add": {"a": ("integer", True), "b": ("number", True), "note": ("string", False)}}


def call(id, name, arguments, *needs):
    return {"id": id, "name": name, "arguments": arguments if isinstance(arguments, str) else json.dumps(arguments), "depends_on": list(needs)}


def rows_of(spark, messages, plain=False):
    frame = spark.createDataFrame(messages, "conv_id long, turn long, role string, text string, level string")
    return chat.linked_conversations(frame, SCHEMAS, plain_turns=plain).collect()


def test_links_order_and_errors(spark):
    calls = json.dumps({"tool_calls": [call("x", "add", {"a": 1, "b": 2.5}), call("y", "add", {"a": "one"}, "x"), call("z", "none", "{}"), call("w", "add", "not json"), call("c1", "add", {"a": 1, "b": 1}, "c2"), call("c2", "add", {"a": 1, "b": 1}, "c1")]})
    messages = [(1, 1, "user", "hello", ""), (1, 2, "assistant", calls, ""), (1, 3, "tool", '{"tool_call_id":"x","content":"3.5"}', ""), (1, 4, "tool", '{"tool_call_id":"gone","content":"?"}', "")]
    rows = {(r["kind"], r["call_id"]): r for r in rows_of(spark, messages)}
    assert rows["call", "x"]["is_linked"] and rows["result", "x"]["is_linked"] and not rows["result", "gone"]["is_linked"] and not rows["call", "y"]["is_linked"]
    assert rows["call", "x"]["errors"] == [] and rows["call", "y"]["errors"] == ["a is not integer", "missing b"]
    assert rows["call", "z"]["errors"] == ["unknown tool none"] and rows["call", "w"]["errors"] == ["arguments are not an object"]
    assert [rows[k]["level"] for k in (("message", None), ("call", "x"), ("result", "x"), ("call", "y"), ("call", "c1"))] == [0, 0, 1, 2, None]
    done = json.loads(rows["call", "x"]["json"])
    assert list(done) == sorted(done) and json.loads(done["arguments"]) == {"a": 1, "b": 2.5}


def test_words_beside_calls(spark):
    """What is said beside calls stays, once, also when the calls are several or hold nulls."""
    text = lambda said, *calls: json.dumps({"content": said, "tool_calls": list(calls)})
    one, two = call("x", "add", {"a": 1, "b": 1}), call("y", "add", {"a": 1, "b": 1})
    messages = [(1, 1, "assistant", text("thinking", one, two), ""), (2, 1, "assistant", text("", one), ""), (3, 1, "assistant", text(None, one), ""), (4, 1, "assistant", text("only words"), ""), (5, 1, "assistant", text("with null", None, one), "")]
    rows = rows_of(spark, messages)
    kinds = {}
    for r in rows:
        kinds.setdefault(r["conv_id"], []).append((r["kind"], r["call_id"]))
    assert {k: sorted(v, key=str) for k, v in kinds.items()} == {
        1: [("call", "x"), ("call", "y"), ("message", None)], 2: [("call", "x")], 3: [("call", "x")], 4: [("message", None)], 5: [("call", "x"), ("message", None)],
    }
    said = {r["conv_id"]: json.loads(r["json"])["content"] for r in rows if r["kind"] == "message"}
    assert said[1] == "thinking" and said[5] == "with null" and json.loads(said[4])["content"] == "only words"


def test_awkward_rows(spark):
    messages = [(1, 1, "user", None, ""), (1, 1, "user", None, ""), (None, 1, "user", "x", ""), (2, None, "assistant", "", ""), (3, 1, None, "{broken", ""), (4, 1, "assistant", "{}", "")]
    rows = rows_of(spark, messages, plain=True)
    assert len(rows) == 5 and sum(r["n_copies"] for r in rows) == 6
    assert rows_of(spark, [], plain=True) == []


def test_null_turns_and_conversations(spark):
    rows = rows_of(spark, [(1, None, "user", "a", ""), (1, None, "assistant", "b", "")], plain=True)
    assert [(r["call_id"], r["is_linked"], r["level"]) for r in rows] == [(None, False, 0)] * 2
    calls = json.dumps({"tool_calls": [call("a", "add", {"a": 1, "b": 1}), call("b", "add", {"a": 1, "b": 1}, "a")]})
    for conv in (None, 1):
        rows = rows_of(spark, [(conv, 1, "assistant", calls, ""), (conv, 2, "tool", '{"tool_call_id":"a","content":"2"}', "")])
        assert {(r["kind"], r["call_id"]): (r["level"], r["is_linked"]) for r in rows} == {("call", "a"): (0, True), ("call", "b"): (2, False), ("result", "a"): (1, True)}


def test_canonical_arguments(spark):
    forms = ['{"b":1, "a":{"y":[1, {"q":2,"p":"x y"}],"x":null}}', '{ "a": {"x":null, "y":[1,{"p":"x y","q":2}]}, "b": 1 }']
    rows = rows_of(spark, [(k, 1, "assistant", json.dumps({"tool_calls": [call("x", "add", f)]}), "") for k, f in enumerate(forms)])
    told = {json.loads(r["json"])["arguments"] for r in rows}
    assert told == {'{"a":{"x":null,"y":[1,{"p":"x y","q":2}]},"b":1}'}


def levels(calls):
    """Sequential: a call is one above the results it needs, if all of them can be had."""
    known = {}
    while new := {c: max((known[n] + 2 for n in needs), default=0) for c, needs in calls.items() if c not in known and all(n in known for n in needs)}:
        known |= new
    return known


def test_levels_of_random_graphs(spark):
    rng = random.Random(7)
    messages, want = [], {}
    for conv in range(25):
        names = [f"c{i}" for i in range(rng.randint(1, 12))]
        calls = {c: rng.sample(names + ["gone"], min(len(names), rng.randint(0, 3))) if rng.random() < 0.3 else rng.sample(names[:i], min(i, rng.randint(0, 3))) for i, c in enumerate(names)}
        messages += [(conv, i + 1, "assistant", json.dumps({"tool_calls": [call(c, "add", {"a": 1, "b": 1}, *needs)]}), "") for i, (c, needs) in enumerate(calls.items())]
        found = levels(calls)
        want |= {(conv, c): found.get(c) for c in names}
    assert {(r["conv_id"], r["call_id"]): r["level"] for r in rows_of(spark, messages)} == want
