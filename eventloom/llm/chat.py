"""Tool-call linking in conversations (native DataFrame operations only).

Calls and results are hash-joined by identifier, arguments are validated against schemas, messages are ordered
topologically (a result never before its call, a call never before the results it refers to), and each is serialised as
canonical JSON: keys sorted, no spaces, nulls left out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from eventloom.llm.common import stored

#: tool name -> field -> (type, required). Types: string, integer, number, boolean.
Schemas = dict[str, dict[str, tuple[str, bool]]]
#: The tool that a plain user turn calls in `turns_as_calls`.
REPLY = "reply"
REPLY_SCHEMAS: Schemas = {REPLY: {"prompt": ("string", True), "turn": ("integer", True)}}
CALL = "struct<id:string,name:string,arguments:string,depends_on:array<string>>"
RESULT = "struct<tool_call_id:string,content:string>"
#: What a JSON value of each type looks like.
SHAPES = {"string": r'^".*"$', "integer": r"^-?(0|[1-9]\d*)$", "number": r"^-?(0|[1-9]\d*)(\.\d+)?([eE][-+]?\d+)?$", "boolean": r"^(true|false)$"}


def distinct_messages(conversations: DataFrame) -> DataFrame:
    """Repeated rows become one message with its number of copies, counted before anything is shuffled whole."""
    return conversations.groupBy("conv_id", "turn", "role", "text").agg(F.count("*").alias("n_copies"))


def canonical_text(json: str) -> Column:
    """JSON text with the keys of all its objects sorted and without spaces; text that isn't JSON as it is.

    A variant's objects are ordered by key at every depth, and numbers lose trailing zeros.
    """
    return F.coalesce(F.to_json(F.try_parse_json(F.col(json))), F.col(json))


def tool_messages(messages: DataFrame) -> DataFrame:
    """Explicit calls and results: an assistant text that is JSON with `tool_calls` gives one row per call, a tool text
    that is JSON with `tool_call_id` a result; all other messages keep a null call_id. What an assistant says beside its
    calls, a `content` that isn't empty, is a message of its own. Adds kind, call_id, name, arguments (canonical JSON
    text), depends_on, content."""
    asked = F.from_json("text", f"content string, tool_calls array<{CALL}>")
    calls, said = asked["tool_calls"], asked["content"]
    result = F.from_json("text", RESULT)
    none = F.lit(None).cast(CALL)
    looks = F.col("text").startswith("{")
    calling = (F.col("role") == "assistant") & looks & (F.size(F.coalesce(calls, F.array())) > 0)
    beside = F.when(F.coalesce(said != "", F.lit(False)), F.array(none)).otherwise(F.array().cast(f"array<{CALL}>"))
    each = F.explode(F.when(calling, F.concat(beside, F.filter(calls, lambda c: c.isNotNull()))).otherwise(F.array(none))).alias("call")
    opened = messages.select("*", F.when(calling, said).alias("said"), each, F.when((F.col("role") == "tool") & looks, result).alias("result"))
    return opened.select(
        *messages.columns,
        F.when(F.col("call.id").isNotNull(), "call").when(F.col("result.tool_call_id").isNotNull(), "result").otherwise("message").alias("kind"),
        F.coalesce("call.id", "result.tool_call_id").alias("call_id"), F.col("call.name").alias("name"), canonical_text("call.arguments").alias("arguments"),
        F.coalesce("call.depends_on", F.array().cast("array<string>")).alias("depends_on"),
        F.when(F.col("result.tool_call_id").isNotNull(), F.col("result.content")).otherwise(F.when(F.col("call").isNull(), F.coalesce("said", "text")).when(F.col("call.id").isNull(), F.col("text"))).alias("content"),
    )


def turns_as_calls(messages: DataFrame) -> DataFrame:
    """Plain turns as calls: a user turn calls `reply` with its text, the assistant turn behind it is the result of the
    call that the turn before it names. A null turn names none. Rows that `tool_messages` made calls or results stay."""
    plain = F.col("kind") == "message"
    named = lambda turn: F.when(turn.isNotNull(), F.concat_ws(":", F.col("conv_id").cast("string"), turn.cast("string")))
    user, answer = plain & (F.col("role") == "user"), plain & (F.col("role") == "assistant")
    return messages.withColumns(
        {
            "call_id": F.when(user, named(F.col("turn"))).when(answer, named(F.col("turn") - 1)).otherwise(F.col("call_id")),
            "kind": F.when(user, "call").when(answer, "result").otherwise(F.col("kind")),
            "name": F.when(user, REPLY).otherwise(F.col("name")),
            "arguments": F.when(user, F.to_json(F.struct(F.col("text").alias("prompt"), "turn"))).otherwise(F.col("arguments")),
            "content": F.when(~user, F.col("content")),
        }
    )


def raw_field(json: Column, field: str) -> Column:
    """A field's JSON value as text: strings keep their quotes."""
    return F.try_variant_get(F.try_parse_json(json), f"$.{field}", "variant")


def argument_errors(schemas: Schemas) -> Column:
    """The sorted errors of a call's arguments: unknown tool, not an object, missing or ill-typed fields."""
    opened = F.from_json("arguments", "map<string,variant>")
    cases = F.when(F.lit(False), F.array().cast("array<string>"))
    for name, fields in sorted(schemas.items()):
        found = []
        for field, (kind, required) in sorted(fields.items()):
            value = F.to_json(raw_field(F.col("arguments"), field))
            missing = F.lit(f"missing {field}") if required else F.lit(None).cast("string")
            found.append(F.when(value.isNull() | (value == "null"), missing).when(~value.rlike(SHAPES[kind].replace("^", "(?s)^", 1)), f"{field} is not {kind}"))
        whole = F.when(opened.isNull(), F.array(F.lit("arguments are not an object"))).otherwise(F.array_compact(F.array(*found)))
        cases = cases.when(F.col("name") == name, whole)
    return F.when(F.col("kind") == "call", cases.otherwise(F.array(F.concat(F.lit("unknown tool "), F.coalesce("name", F.lit("null"))))))


def linked(messages: DataFrame, schemas: Schemas) -> DataFrame:
    """Messages with has_call / has_result, the call's turn, and errors.

    Each side of the join is first aggregated to one row per (conv_id, call_id), so equal identifiers can't multiply
    rows; the row side may be skewed, which adaptive execution splits.
    """
    keys = ["conv_id", "call_id"]
    sides = (
        messages.where(F.col("kind").isin("call", "result")).groupBy(*keys)
        .agg(F.min(F.when(F.col("kind") == "call", F.col("turn"))).alias("call_turn"), F.count_if(F.col("kind") == "call").alias("n_calls"), F.count_if(F.col("kind") == "result").alias("n_results"))
        .select(*(F.col(k).alias(f"_{k}") for k in keys), "call_turn", "n_calls", "n_results")
    )
    on = messages["conv_id"].eqNullSafe(F.col("_conv_id")) & (messages["call_id"] == F.col("_call_id"))
    errors = argument_errors(schemas)
    call, result = F.col("kind") == "call", F.col("kind") == "result"
    return (
        messages.withColumn("errors", errors).join(sides, on, "left").drop("_conv_id", "_call_id")
        .withColumn("is_linked", F.when(call, F.coalesce(F.col("n_results") > 0, F.lit(False))).when(result, F.coalesce(F.col("n_calls") > 0, F.lit(False))))
        .withColumn("errors", F.when(call, F.concat("errors", F.when(F.col("n_calls") > 1, F.array(F.lit("repeated identifier"))).otherwise(F.array().cast("array<string>")))))
    )


def levelled(messages: DataFrame) -> DataFrame:
    """Adds `level` and `at_turn`, the topological place: messages 0; calls without dependencies 0, others one above the
    highest result they depend on; a result one above its call. `at_turn` is the latest turn among a message and all it
    needs. Calls in a cycle or that depend on unknown identifiers get level null; one without an identifier depends on
    nothing.

    One round per level of dependency: the needs are joined only to the calls that were settled last, and the calls that
    wait for more, fewer every round, count off what they got.
    """
    with_needs = messages.where((F.col("kind") == "call") & (F.size("depends_on") > 0))
    # A null conversation is one like others, also in joins.
    conv = F.coalesce(F.concat(F.lit("="), F.col("conv_id").cast("string")), F.lit("")).alias("_conv")
    calls = messages.where((F.col("kind") == "call") & F.col("call_id").isNotNull()).groupBy(conv, F.col("call_id").alias("_call")).agg(
        F.min("turn").alias("_at"), F.array_distinct(F.flatten(F.collect_set("depends_on"))).alias("needs")
    )
    if with_needs.isEmpty():
        ranks = calls.select("_conv", "_call", F.lit(0).alias("_level"), "_at")
    else:
        calls = stored(calls, "chat-calls")
        edges = stored(calls.select("_conv", "_call", F.explode("needs").alias("_need")), "chat-edges")
        ranks = last = calls.where(F.size("needs") == 0).select("_conv", "_call", F.lit(0).alias("_level"), "_at")
        waiting = calls.where(F.size("needs") > 0).select("_conv", "_call", F.size("needs").alias("_open"), F.lit(0).alias("_level"), "_at")
        while not last.isEmpty():
            settled = last.select("_conv", F.col("_call").alias("_need"), "_level", "_at")
            got = edges.join(settled, ["_conv", "_need"]).groupBy("_conv", "_call").agg(F.count("*").cast("int").alias("_n"), (F.max("_level") + 2).alias("_l"), F.max("_at").alias("_t"))
            counted = waiting.join(got, ["_conv", "_call"], "left").select(
                "_conv", "_call", (F.col("_open") - F.coalesce("_n", F.lit(0))).alias("_open"), F.greatest("_level", "_l").alias("_level"), F.greatest("_at", "_t").alias("_at")
            )
            counted = stored(counted, "chat-waiting")
            waiting, last = counted.where("_open > 0"), counted.where("_open = 0").drop("_open")
            ranks = ranks.unionByName(last)
    on = (F.coalesce(F.concat(F.lit("="), messages["conv_id"].cast("string")), F.lit("")) == F.col("_conv")) & (messages["call_id"] == F.col("_call"))
    call, result = F.col("kind") == "call", F.col("kind") == "result"
    return (
        messages.join(ranks, on, "left")
        .withColumn("level", F.when(call, F.when(F.col("call_id").isNull(), 0).otherwise(F.col("_level"))).when(result, F.coalesce(F.col("_level") + 1, F.lit(0))).otherwise(0))
        .withColumn("at_turn", F.when(call | result, F.greatest("turn", F.col("_at"))).otherwise(F.col("turn")))
        .drop("_conv", "_call", "_level", "_at")
    )


def canonical_json(kind: Column) -> Column:
    """One JSON object per message; the fields of each kind in alphabetical order."""
    call = F.to_json(F.struct("arguments", F.col("call_id").alias("id"), "name", "role", F.lit("call").alias("type")))
    result = F.to_json(F.struct("content", "role", F.col("call_id").alias("tool_call_id"), F.lit("result").alias("type")))
    plain = F.to_json(F.struct("content", "role", F.lit("message").alias("type")))
    return F.when(kind == "call", call).when(kind == "result", result).otherwise(plain)


def linked_conversations(conversations: DataFrame, schemas: Schemas = REPLY_SCHEMAS, plain_turns: bool = True) -> DataFrame:
    """One row per distinct message (call): conv_id, turn, role, n_copies, kind, call_id, is_linked, errors, level,
    at_turn, json. Order a conversation by at_turn, level, turn, call_id, json; no conversation is gathered into one
    row or task.

    Null texts are messages without content (a user turn's null prompt is reported as missing), null conv_ids form a
    conversation, null turns have no identifier and no partner, an empty table gives an empty result; texts of any length
    stay whole; further columns of the input are left out, whatever their names.
    """
    messages = tool_messages(distinct_messages(conversations.select("conv_id", "turn", "role", "text")))
    if plain_turns:
        messages = turns_as_calls(messages)
    done = levelled(linked(messages, schemas))
    return done.select(
        "conv_id", "turn", "role", "n_copies", "kind", "call_id", "is_linked", "errors", "level", "at_turn", canonical_json(F.col("kind")).alias("json")
    )


SQL = r"""
WITH d AS (SELECT conv_id, turn, role, text, count(*) AS n_copies FROM conversations GROUP BY ALL),
m AS (SELECT *, CASE role WHEN 'user' THEN 'call' WHEN 'assistant' THEN 'result' ELSE 'message' END AS kind,
             CASE WHEN turn IS NULL THEN NULL WHEN role = 'user' THEN concat_ws(':', conv_id, turn) WHEN role = 'assistant' THEN concat_ws(':', conv_id, turn - 1) END AS call_id
      FROM d),
s AS (SELECT conv_id, call_id, min(turn) FILTER (kind = 'call') AS call_turn, count(*) FILTER (kind = 'call') AS n_calls,
             count(*) FILTER (kind = 'result') AS n_results
      FROM m WHERE kind <> 'message' GROUP BY ALL)
SELECT m.conv_id, m.turn, m.role, m.n_copies, m.kind, m.call_id,
       CASE m.kind WHEN 'call' THEN coalesce(s.n_results > 0, false) WHEN 'result' THEN coalesce(s.n_calls > 0, false) END AS is_linked,
       CASE WHEN m.kind = 'call' THEN concat_ws(', ', CASE WHEN m.text IS NULL THEN 'missing prompt' END, CASE WHEN s.n_calls > 1 THEN 'repeated identifier' END) END AS errors,
       CAST(CASE WHEN m.kind = 'result' AND s.n_calls > 0 THEN 1 ELSE 0 END AS INTEGER) AS level,
       CASE WHEN m.kind = 'message' THEN m.turn ELSE greatest(m.turn, s.call_turn) END AS at_turn,
       CASE m.kind
         WHEN 'call' THEN concat('{"arguments":', to_json(concat('{"prompt":', to_json(m.text), ',"turn":', m.turn, '}')), ',"id":', to_json(m.call_id), ',"name":"reply","role":"user","type":"call"}')
         WHEN 'result' THEN concat('{"content":', to_json(m.text), ',"role":"assistant","tool_call_id":', to_json(m.call_id), ',"type":"result"}')
         ELSE concat('{"content":', to_json(m.text), ',"role":', to_json(m.role), ',"type":"message"}') END AS json
FROM m LEFT JOIN s ON m.conv_id IS NOT DISTINCT FROM s.conv_id AND m.call_id = s.call_id
"""
