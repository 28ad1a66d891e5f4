import json

import duckdb

from veilshift.llm.chats import SQL, exchanges, linked_messages, op8_chats

COLUMNS = "conv_id bigint, turn bigint, role string, text string, layer string"


def call(*calls):
    return json.dumps({"tool_calls": list(calls)})


def test_links_layers_and_validation(spark):
    rows = [
        (1, 0, "user", 'hi "é"\n', ""),
        (1, 1, "assistant", call({"id": "a", "name": "search", "arguments": {"query": "x", "limit": 3}}, {"id": "b", "name": "lookup", "arguments": '{"strict": 1, "key": "k"}', "after": ["a"]}), ""),
        (1, 2, "tool", json.dumps({"tool_call_id": "a", "content": {"z": 1, "b": [1, {"y": None, "c": 2.50}]}}), ""),
        (1, 3, "assistant", call({"id": "c", "name": "fly", "arguments": {}, "after": ["b", "nowhere"]}, {"id": "d", "name": "calculate", "arguments": [], "after": ["e"]}, {"id": "e", "name": "calculate", "arguments": {"depth": 1}, "after": ["d"]}), ""),
        (1, 4, "tool", json.dumps({"tool_call_id": "zz", "content": None}), ""),
        (1, 0, "tool", json.dumps({"tool_call_id": "c", "content": "before its call"}), ""),
        (2, 0, "tool", json.dumps({"tool_call_id": "a", "content": 1}), ""),
        (2, 1, "assistant", "{not json", ""), (2, 2, "assistant", None, ""), (2, 2, "assistant", None, ""), (None, None, None, None, None), (3, 0, "user", "{} " * 50_000, ""),
    ]
    got = linked_messages(spark.createDataFrame(rows, COLUMNS)).collect()
    by = {(r.conv_id, r.turn, r.place, r.kind): r for r in got}
    assert len(got) == len(rows) + 3
    assert by[1, 0, 0, "message"].json == '{"content":"hi \\"é\\"\\n","role":"user"}'
    a, b, c, d, e = (by[1, t, p, "call"] for t, p in ((1, 0), (1, 1), (3, 0), (3, 1), (3, 2)))
    assert [x.layer for x in (a, b, c, d, e)] == [0, 1, 2, -1, -1]
    assert [x.linked for x in (a, b, c, d, e)] == [True, False, False, False, False]
    assert a.errors == "" and b.errors == "strict is no boolean" and c.errors == "unknown tool fly" and d.errors == "arguments are no object" and e.errors == "missing expression,unknown depth"
    assert a.json == '{"arguments":{"limit":3,"query":"x"},"id":"a","name":"search"}' and json.loads(b.json)["arguments"] == {"key": "k", "strict": 1}
    assert by[1, 2, 0, "result"].linked and by[1, 2, 0, "result"].json == '{"content":{"b":[1,{"c":2.5,"y":null}],"z":1},"role":"tool","tool_call_id":"a"}'
    assert not by[1, 4, 0, "result"].linked and not by[2, 0, 0, "result"].linked and not by[1, 0, 0, "result"].linked
    assert by[2, 1, 0, "message"].json == '{"content":"{not json","role":"assistant"}' and by[2, 2, 0, "message"].json == '{"content":null,"role":"assistant"}'


def test_repeated_ids_and_empty(spark):
    one = call({"id": "a", "name": "search", "arguments": {"query": "q"}})
    rows = [(1, 0, "assistant", one, ""), (1, 1, "assistant", one, ""), (1, 2, "tool", '{"tool_call_id":"a"}', "")]
    got = linked_messages(spark.createDataFrame(rows, COLUMNS)).orderBy("turn").collect()
    assert [r.linked for r in got] == [True, False, True] and got[2].json == '{"content":null,"role":"tool","tool_call_id":"a"}'
    assert linked_messages(spark.createDataFrame([], COLUMNS)).count() == 0


def test_long_chains_have_layers(spark):
    def made(name, after):
        return call({"id": name, "name": "search", "arguments": {"query": "q"}, "after": after})

    after = {"a0": []} | {f"a{i}": [f"a{i - 1}"] for i in range(1, 80)} | {"m": ["a79", "a3"], "n": ["m"], "o": ["n", "m", "a0"], "p": ["o"]}
    after |= {"x": ["z"], "y": ["x"], "z": ["y"], "w": ["x"], "v": ["w", "a0"], "self": ["self"]}
    rows = [(1, i, "assistant", made(k, v), "") for i, (k, v) in enumerate(after.items())]
    got = {r.call_id: r.layer for r in linked_messages(spark.createDataFrame(rows, COLUMNS)).collect()}
    assert got == {f"a{i}": i for i in range(80)} | {"m": 80, "n": 81, "o": 82, "p": 83} | dict.fromkeys(["x", "y", "z", "w", "v", "self"], -1)


def test_plain_conversations_are_exchanges(spark, tmp_path):
    rows = [
        (1, 0, "system", "be brief"), (1, 1, "user", "one?"), (1, 2, "assistant", "1"), (1, 3, "user", None), (1, 4, "assistant", None), (1, 5, "user", "three \"?\""),
        (1, 8, "assistant", "late"), (1, 9, "user", "again?"), (1, 11, "user", "and?"), (1, 12, "assistant", "no"), (2, 0, "user", ""), (2, 1, "user", "x" * 9000), (3, 0, "assistant", "first"), (4, 0, None, "lost"),
    ] + [(5, 2 * i + k, role, f"é {i}") for i in range(40) for k, role in enumerate(("user", "assistant"))]
    docs = spark.createDataFrame([(*r, "x") for r in rows], "conv_id bigint, turn bigint, role string, text string, layer string")
    got = {(r.conv_id, r.turn): r for r in linked_messages(exchanges(docs)).collect()}
    assert len(got) == len(rows)
    assert [got[1, t].layer for t in (1, 3, 5, 9, 11)] == [0, 1, 2, 0, 1] and got[5, 78].layer == got[5, 79].layer == 39
    assert [got[1, t].linked for t in (1, 2, 3, 4, 5, 8, 9, 11, 12)] == [True, True, True, True, False, False, False, True, True]
    assert got[1, 3].errors == "missing text" and got[1, 1].errors == "" and got[3, 0].layer == -1 and got[1, 0].kind == got[4, 0].kind == "message"
    docs.drop("layer").write.parquet(f"{tmp_path}/conversations.parquet")
    mine = sorted((tuple(r) for r in op8_chats(spark, str(tmp_path)).collect()), key=repr)
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM '{tmp_path}/conversations.parquet/*.parquet'")
    assert mine == sorted(con.execute(SQL).fetchall(), key=repr)
