"""Chat formatting: link tool calls with their results, order them, validate arguments, write canonical JSON.

DataFrame functions only. Calls stand in an assistant's message that is a JSON object with `tool_calls`: a list of
{id, name, arguments, after}, where `after` lists ids of calls whose results the call uses. A result is a message of
role tool that is a JSON object {tool_call_id, content}. Calls and results are joined by conversation and identifier.
Every message stays one row (a call message: one for each call), so no conversation is collected; the order of a
conversation is turn, then layer, then place.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import keep

#: Types of a schema and what a JSON value of that type is called.
TYPES = {"string": "STRING", "integer": "BIGINT", "number": "(BIGINT|DECIMAL.*|DOUBLE|FLOAT)", "boolean": "BOOLEAN", "object": "OBJECT.*", "array": "ARRAY.*", "null": "VOID"}
#: Tools, their parameters' types, and the parameters that a call needs.
SCHEMAS = {
    "search": ({"query": "string", "limit": "integer"}, ["query"]),
    "calculate": ({"expression": "string", "precision": "integer"}, ["expression"]),
    "lookup": ({"key": "string", "fields": "array", "strict": "boolean"}, ["key"]),
    "ask": ({"text": "string", "turn": "integer"}, ["text", "turn"]),
}


def _quoted(c: Column) -> Column:
    """A string as JSON; null: null."""
    x = F.to_json(F.array(c.cast("string")))
    return F.when(c.isNull(), F.lit("null")).otherwise(F.substring(x, F.lit(2), F.length(x) - 2))


def _errors(name: Column, arguments: Column, schemas: dict) -> Column:
    """What a call's arguments break of its tool's schema, sorted; the arguments are a variant."""
    kind = F.schema_of_variant(arguments)
    out = F.array(F.concat(F.lit("unknown tool "), F.coalesce(name, F.lit("null"))))
    for tool, (parameters, needed) in schemas.items():
        checks = []
        for p, t in parameters.items():
            value = F.try_variant_get(arguments, f"$.{p}", "variant")
            if p in needed:
                checks.append(F.when(value.isNull(), F.lit(f"missing {p}")))
            checks.append(F.when(value.isNotNull() & ~F.schema_of_variant(value).rlike(f"^{TYPES[t]}$"), F.lit(f"{p} is no {t}")))
        keys = F.coalesce(F.json_object_keys(F.to_json(arguments)), F.array().cast("array<string>"))
        extra = F.transform(F.array_except(keys, F.array(*[F.lit(p) for p in parameters])), lambda k: F.concat(F.lit("unknown "), k))
        found = F.when(kind.startswith("OBJECT"), F.array_sort(F.concat(F.array_compact(F.array(*checks)), extra))).otherwise(F.array(F.lit("arguments are no object")))
        out = F.when(name == tool, F.coalesce(found, F.array(F.lit("arguments are no object")))).otherwise(out)
    return out


def _layers(calls: DataFrame) -> DataFrame:
    """calls: c (conversation), id, after. Returns c, id, layer: 0 for calls that wait for none, else one more than the
    deepest call waited for; -1 in a cycle or behind one. Ids that aren't calls of the conversation aren't waited for."""
    waits = calls.select("c", "id", F.explode("after").alias("on")).distinct()
    known = calls.select("c", F.col("id").alias("on")).distinct()
    waits = keep(waits.join(known, ["c", "on"]), "chat-waits")
    free = calls.select("c", "id").distinct().join(waits.select("c", "id"), ["c", "id"], "left_anti").withColumn("layer", F.lit(0))
    if not waits.limit(1).count():
        return free
    # a chain of calls that wait for one call each is shortened by pointer doubling, to the call at its end and the way there
    single = waits.groupBy("c", "id").agg(F.count("*").alias("n"), F.first("on").alias("on")).filter("n = 1")
    jumps = keep(single.select("c", "id", "on", F.lit(1).alias("way")), "chat-jumps")
    ids, most = jumps.select("c", F.col("id").alias("on")), jumps.count()
    open_ = lambda j: j.join(ids, ["c", "on"], "left_semi")
    reach = 1
    while reach <= most and open_(jumps).limit(1).count():  # what is open after that runs into a cycle
        further = jumps.select("c", F.col("id").alias("on"), F.col("on").alias("next"), F.col("way").alias("more"))
        jumps = keep(jumps.join(further, ["c", "on"], "left").select("c", "id", F.coalesce("next", "on").alias("on"), (F.col("way") + F.coalesce("more", F.lit(0))).alias("way")), "chat-jumps")
        reach *= 2
    jumps = keep(jumps.join(ids, ["c", "on"], "left_anti").select("c", "id", "on", "way"), "chat-jumps")
    ends = jumps.select("c", F.col("id").alias("on"), F.col("on").alias("end"), "way")
    several = waits.join(single.select("c", "id"), ["c", "id"], "left_anti").join(ends, ["c", "on"], "left")
    several = keep(several.select("c", "id", F.coalesce("end", "on").alias("on"), (1 + F.coalesce("way", F.lit(0))).alias("way")), "chat-several")
    done = keep(free, "chat-layer")
    while True:
        reached = several.join(done.select("c", F.col("id").alias("on"), "layer"), ["c", "on"], "left")
        ready = reached.groupBy("c", "id").agg(F.count_if(F.col("layer").isNull()).alias("open"), F.max(F.col("layer") + F.col("way")).alias("layer")).filter("open = 0").select("c", "id", "layer")
        new = keep(ready.join(done, ["c", "id"], "left_anti"), "chat-layer")
        if not new.limit(1).count():
            break
        done = keep(done.unionByName(new), "chat-layers")
    chained = jumps.join(done.select("c", F.col("id").alias("on"), "layer"), ["c", "on"]).select("c", "id", (F.col("layer") + F.col("way")).alias("layer"))
    done = keep(done.unionByName(chained), "chat-layers")
    rest = waits.select("c", "id").distinct().join(done, ["c", "id"], "left_anti").withColumn("layer", F.lit(-1))
    return done.unionByName(rest)


def linked_messages(messages: DataFrame, schemas: dict = SCHEMAS, conversation: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """A row for each message, a call message one for each call:

    conv_id, turn, place (of the call in its message), role, kind (message, call or result), call_id, linked (a call
    has a result after it, a result a call before it; null for messages), layer (calls: how deep they wait; results:
    their call's; messages 0; -1: in a cycle or without a call), errors (comma-joined; calls only) and json.

    A text that isn't such JSON is a message. Null text: content null. Several calls of one id in a conversation: a
    result belongs to the first by turn and place. Repeated rows stay. Null conversations: their messages never link.
    No rows: no rows. Other columns go.
    """
    m = messages.select(F.col(conversation).alias("c"), F.col(turn).alias("turn"), F.col(role).cast("string").alias("role"), F.col(text).cast("string").alias("text"))
    m = m.withColumn("j", F.when(F.col("role").isin("assistant", "tool") & F.ltrim("text").startswith("{"), F.try_parse_json("text")))
    asked = F.when(F.col("role") == "assistant", F.try_variant_get("j", "$.tool_calls", "array<variant>"))
    answer = F.when(F.col("role") == "tool", F.try_variant_get("j", "$.tool_call_id", "string"))
    m = m.withColumns({"asked": asked, "answer": answer})
    is_call, is_result = F.coalesce(F.size("asked") > 0, F.lit(False)), F.col("answer").isNotNull()

    plain = m.filter(~is_call & ~is_result).select(
        "c", "turn", F.lit(0).alias("place"), "role", F.lit("message").alias("kind"), F.lit(None).cast("string").alias("call_id"), F.lit(None).cast("boolean").alias("linked"), F.lit(0).alias("layer"), F.lit(None).cast("string").alias("errors"),
        F.concat(F.lit('{"content":'), _quoted(F.col("text")), F.lit(',"role":'), _quoted(F.col("role")), F.lit("}")).alias("json"),
    )
    linking = keep(m.filter(is_call | is_result).select("c", "turn", "role", "text", "answer"), "chat-linking")
    if not linking.limit(1).count():
        return plain.withColumnRenamed("c", conversation).withColumnRenamed("turn", turn)

    j = linking.withColumn("j", F.try_parse_json("text"))
    calls = j.filter("answer is null").select("c", "turn", "role", F.posexplode(F.try_variant_get("j", "$.tool_calls", "array<variant>")).alias("place", "v"))
    given = F.try_variant_get("v", "$.arguments", "variant")
    calls = calls.select(
        "c", "turn", "place", "role", F.try_variant_get("v", "$.id", "string").alias("id"), F.try_variant_get("v", "$.name", "string").alias("name"),
        F.when(F.schema_of_variant(given) == "STRING", F.try_parse_json(F.try_variant_get(given, "$", "string"))).otherwise(given).alias("arguments"),
        F.coalesce(F.try_variant_get("v", "$.after", "array<string>"), F.array().cast("array<string>")).alias("after"),
    )
    results = j.filter("answer is not null").select("c", "turn", "role", F.col("answer").alias("id"), F.coalesce(F.to_json(F.try_variant_get("j", "$.content", "variant")), F.lit("null")).alias("content"))

    first = calls.groupBy("c", "id").agg(F.min(F.struct("turn", "place")).alias("at"))
    layers = _layers(calls.select("c", "id", "after"))
    first = keep(first.join(layers, ["c", "id"], "left"), "chat-first")
    answered = results.join(first.select("c", "id", F.col("at.turn").alias("asked_at")), ["c", "id"]).filter("turn > asked_at").groupBy("c", "id").agg(F.lit(True).alias("has"))
    call_rows = calls.join(first, ["c", "id"], "left").join(answered, ["c", "id"], "left")
    is_first = (F.col("at.turn") == F.col("turn")) & (F.col("at.place") == F.col("place"))
    call_rows = call_rows.select(
        "c", "turn", "place", "role", F.lit("call").alias("kind"), F.col("id").alias("call_id"), F.coalesce(F.col("has") & is_first, F.lit(False)).alias("linked"), F.coalesce("layer", F.lit(-1)).alias("layer"),
        F.array_join(_errors(F.col("name"), F.col("arguments"), schemas), ",").alias("errors"),
        F.concat(F.lit('{"arguments":'), F.coalesce(F.to_json("arguments"), F.lit("null")), F.lit(',"id":'), _quoted(F.col("id")), F.lit(',"name":'), _quoted(F.col("name")), F.lit("}")).alias("json"),
    )
    result_rows = results.join(first, ["c", "id"], "left").select(
        "c", "turn", F.lit(0).alias("place"), "role", F.lit("result").alias("kind"), F.col("id").alias("call_id"), F.coalesce(F.col("turn") > F.col("at.turn"), F.lit(False)).alias("linked"), F.coalesce("layer", F.lit(-1)).alias("layer"), F.lit(None).cast("string").alias("errors"),
        F.concat(F.lit('{"content":'), F.col("content"), F.lit(',"role":"tool","tool_call_id":'), _quoted(F.col("id")), F.lit("}")).alias("json"),
    )
    every = plain.unionByName(call_rows).unionByName(result_rows)
    return every.withColumnRenamed("c", conversation).withColumnRenamed("turn", turn)


def exchanges(messages: DataFrame, conversation: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """Conversations whose messages are plain, as tool calls and results: conv_id, turn, role, text.

    A user's message of turn t is a call of the tool `ask`: its id is tN with N the turn, its arguments are text and turn,
    and it waits for the call of turn t - 2, the question before. An assistant's message of turn t is the result of the
    call of turn t - 1. Messages of other roles, and assistants' that hold calls themselves, stay as they are. Null text:
    a call without the argument, a result without content. Null turn: a call or result without identifier. Repeated rows
    stay, whose calls have one id. No rows: no rows. Other columns go.
    """
    t, said = F.col(turn).cast("long"), F.col(text).cast("string")
    name = lambda n: F.concat(F.lit("t"), n.cast("string"))
    call = F.struct(name(t).alias("id"), F.lit("ask").alias("name"), F.struct(said.alias("text"), t.alias("turn")).alias("arguments"), F.array(name(t - 2)).alias("after"))
    own = F.coalesce(F.ltrim(said).startswith("{") & F.try_variant_get(F.try_parse_json(said), "$.tool_calls", "array<variant>").isNotNull(), F.lit(False))
    asks, answers = F.col(role) == "user", (F.col(role) == "assistant") & ~own
    return messages.select(
        F.col(conversation).alias("conv_id"), F.col(turn).alias("turn"), F.when(asks, F.lit("assistant")).when(answers, F.lit("tool")).otherwise(F.col(role)).alias("role"),
        F.when(asks, F.to_json(F.struct(F.array(call).alias("tool_calls")))).when(answers, F.to_json(F.struct(name(t - 1).alias("tool_call_id"), said.alias("content")))).otherwise(said).alias("text"),
    )


def op8_chats(spark, sf_dir: str) -> DataFrame:
    """The driver's conversations are plain messages, so they are linked as exchanges of questions and answers."""
    return linked_messages(exchanges(spark.read.parquet(f"{sf_dir}/conversations.parquet")))


#: A question's layer is how many questions stand before it, two turns apart each.
SQL = """
WITH u AS (SELECT conv_id, turn, text, turn // 2 - row_number() OVER (PARTITION BY conv_id, turn % 2 ORDER BY turn) AS run FROM conversations WHERE role = 'user'),
c AS (SELECT conv_id, turn, text, (row_number() OVER (PARTITION BY conv_id, turn % 2, run ORDER BY turn) - 1)::integer AS layer FROM u),
a AS (SELECT conv_id, turn, text FROM conversations WHERE role = 'assistant'),
j AS (SELECT *, CASE WHEN text IS NULL THEN 'null' ELSE to_json(text)::varchar END AS said FROM conversations)
SELECT c.conv_id, c.turn, 0::integer AS place, 'assistant' AS role, 'call' AS kind, 't' || c.turn AS call_id, a.turn IS NOT NULL AS linked, c.layer,
       CASE WHEN c.text IS NULL THEN 'missing text' ELSE '' END AS errors,
       '{"arguments":{' || coalesce('"text":' || to_json(c.text)::varchar || ',', '') || '"turn":' || c.turn || '},"id":"t' || c.turn || '","name":"ask"}' AS json
FROM c LEFT JOIN a ON a.conv_id = c.conv_id AND a.turn = c.turn + 1
UNION ALL
SELECT j.conv_id, j.turn, 0, 'tool', 'result', 't' || (j.turn - 1), c.turn IS NOT NULL, coalesce(c.layer, -1), NULL,
       '{"content":' || said || ',"role":"tool","tool_call_id":"t' || (j.turn - 1) || '"}'
FROM j LEFT JOIN c ON c.conv_id = j.conv_id AND c.turn = j.turn - 1 WHERE role = 'assistant'
UNION ALL
SELECT conv_id, turn, 0, role, 'message', NULL, NULL, 0, NULL,
       '{"content":' || said || ',"role":' || CASE WHEN role IS NULL THEN 'null' ELSE to_json(role)::varchar END || '}'
FROM j WHERE role IS NULL OR role NOT IN ('user', 'assistant')
"""
