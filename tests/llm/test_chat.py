import json
import random

import duckdb
import pytest

from lorespark.llm import chat, queries

SEARCH = lambda i, q, *deps, **k: {"id": i, "name": "search", "arguments": {"query": q, **k}, **({"depends_on": list(deps)} if deps else {})}
CALL = lambda *c, content=None: json.dumps({"tool_calls": list(c), **({"content": content} if content else {})})
RESULT = lambda i, c: json.dumps({"tool_call_id": i, "content": c})


def brute(rows, schemas):
    parts = [p for r in rows for p in chat.parse(*r, schemas)]
    out = []
    for p in parts:
        conv, turn, role, kind, idx, ident, name, _, valid, problem, text = p
        calls = sorted(q for q in parts if q[3] == "call" and q[0] == conv is not None and q[5] is not None)
        first = {}
        for q in calls:
            first.setdefault(q[5], q)
        results = sorted((q[1], q[10]) for q in parts if q[3] == "result" and q[0] == conv is not None and q[5] == ident)

        def level(i, seen=()):
            if i in seen:
                return None
            below = [level(d, (*seen, i)) for d in first[i][7] if d in first]
            return None if None in below else 1 + max(below, default=-1)

        mine, lev, at = first.get(ident), None, (turn, -1, 0, 0)
        if kind == "call":
            own = mine is not None and (mine[1], mine[4]) == (turn, idx)
            lev = level(ident) if own else None
            if ident is not None and conv is not None and not own:
                status = "duplicate"
            elif not valid:
                status = "invalid"
            elif conv is not None and lev is None:
                status = "cycle"
            else:
                status = "ok" if results else "no_result"
            at = (turn, 1 << 30 if lev is None else lev, idx, 0)
        elif kind == "result":
            if mine is None:
                status, at = "orphan", (turn, 1 << 30, idx, 1)
            else:
                status = "early" if turn <= mine[1] else "duplicate" if turn > results[0][0] else "ok"
                found = level(ident)
                at = (mine[1], 1 << 30 if found is None else found, mine[4], 1)
        else:
            status = "ok"
        out.append((conv, turn, role, kind, idx, ident, name, status, problem, lev, *at, text))
    return sorted(out, key=str)


def conversations():
    rows = [
        (1, 0, "user", "find é \"x\"\n"), (1, 1, "assistant", CALL(SEARCH("b", "two", "a"), SEARCH("a", "one", limit=3.0), SEARCH("c", "three", "b", "a"), content="let me")),
        (1, 2, "tool", RESULT("c", {"z": 1, "a": [1.0, None]})), (1, 3, "tool", RESULT("a", "r")), (1, 4, "tool", RESULT("b", "r")), (1, 5, "tool", RESULT("b", "again")), (1, 6, "assistant", "done"),
        (2, 0, "assistant", CALL(SEARCH("a", "x", "b"), SEARCH("b", "y", "a"), SEARCH("d", "z", "gone"))), (2, 1, "tool", RESULT("d", 1)), (2, 2, "tool", RESULT("q", 1)),
        (3, 0, "tool", RESULT("a", "early")), (3, 1, "assistant", CALL(SEARCH("a", ""), SEARCH("a", "twin"), {"name": "search"}, {"id": "n", "name": "nope", "arguments": {}}, 7)),
        (3, 2, "assistant", CALL({"id": "s", "name": "calculate", "arguments": "{\"expression\": \"1+1\"}"}, {"id": "t", "name": "calculate", "arguments": {"expression": 1, "more": 2}})),
        (3, 3, "assistant", "{broken"), (3, 4, "assistant", None), (3, 5, None, "x"), (4, None, "user", ""), (None, 0, "assistant", CALL(SEARCH("a", "x"))), (None, 1, "tool", RESULT("a", "x")),
        (5, 0, "assistant", "word " * 50_000), (5, 1, "tool", "not json"), (5, 2, "assistant", "{\"tool_calls\": []}"), (5, 3, "user", "same"), (5, 3, "user", "same"),
    ]
    rng = random.Random(3)
    for conv in range(10, 16):
        ids = [f"k{i}" for i in range(6)]
        for t, i in enumerate(rng.sample(ids, 6)):
            rows.append((conv, t, "assistant", CALL(SEARCH(i, "q", *rng.sample(ids, rng.randrange(3))))))
            rows.append((conv, t + rng.randrange(3), "tool", RESULT(rng.choice(ids), t)))
    return rows


def test_matches_brute_force(spark):
    rows = conversations()
    frame = spark.createDataFrame([(*r, "x") for r in rows], "conv_id long, turn long, role string, text string, status string").repartition(3)
    got = chat.link(spark, frame).collect()
    assert sorted(map(tuple, got), key=str) == brute(rows, chat.SCHEMAS)
    one = [json.loads(r.json) for r in sorted((r for r in got if r.conv_id == 1), key=lambda r: (r.at_turn, r.at_level, r.at_idx, r.at_part, r.turn))]
    assert [m.get("id") or m.get("tool_call_id") or m["role"] for m in one] == ["user", "assistant", "a", "a", "b", "b", "b", "c", "c", "assistant"]
    assert next(r.json for r in got if r.call_id == "c" and r.kind == "result") == '{"content":{"a":[1,null],"z":1},"role":"tool","tool_call_id":"c"}'


def test_hostile_messages_are_plain(spark):
    deep = '{"tool_calls":' + "[" * 100_000 + "]" * 100_000 + "}"
    texts = ['{"tool_calls": [], "x": 1e999}', '{"tool_calls": [], "x": -1e999}', '{"tool_calls": [], "x": NaN}', '{"tool_calls": [], "content": "\\ud800"}', '{"\\udc00": 1, "tool_calls": []}', deep, '{"tool_calls": [{"id": ' + "9" * 5000 + "}]}"]
    frame = spark.createDataFrame([(1, k, "assistant", t) for k, t in enumerate(texts)], "conv_id long, turn long, role string, text string")
    got = sorted(chat.link(spark, frame).collect(), key=lambda r: r.turn)
    assert [r.kind for r in got] == ["message"] * len(texts) and [json.loads(r.json)["content"] for r in got] == texts
    big = CALL({"id": "i", "name": "search", "arguments": {"query": "q", "limit": int("9" * 400)}}, {"id": "j", "name": "search", "arguments": {"query": "q", "limit": 1e300}}, {"id": "k", "name": "search", "arguments": '{"query": "q", "limit": 1e999}'})
    rows = [(2, 0, "assistant", big), (2, 1, "tool", RESULT("i", 1e300))]
    got = {(r.kind, r.call_id): r.problem for r in chat.link(spark, spark.createDataFrame(rows, frame.schema)).collect()}
    assert got == {("call", "i"): "$.limit: range", ("call", "j"): "$.limit: range", ("call", "k"): "no arguments", ("result", "i"): None}


@pytest.mark.parametrize("block", [200_000, 3000])
def test_long_chains_take_few_rounds(spark, monkeypatch, block):
    monkeypatch.setattr(chat, "BLOCK_CALLS", block)
    chain = [SEARCH(f"k{i}", "q", *([f"k{i - 1}"] if i else [])) for i in range(5000)]
    back = [SEARCH(f"k{i}", "q", *([f"k{i + 1}"] if i < 2000 else [])) for i in range(2001)]
    rows = [(1, 0, "assistant", CALL(*reversed(chain)))] + [(2, t, "assistant", CALL(c)) for t, c in enumerate(back)] + [(3, 0, "assistant", CALL(SEARCH("a", "q", "b"), SEARCH("b", "q", "a")))]
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = {(r.conv_id, r.call_id): r.level for r in chat.link(spark, frame).collect() if r.kind == "call"}
    assert got == {**{(1, f"k{i}"): i for i in range(5000)}, **{(2, f"k{i}"): 2000 - i for i in range(2001)}, (3, "a"): None, (3, "b"): None}


def test_query_equals_sql(spark, tmp_path):
    rows = [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.001/conversations.parquet").collect()]
    rows += [(7000 + c, t, "assistant" if t % 2 else "user", 'say "x"\t\\ é\n/' * (t % 4)) for c in range(12) for t in range(9)]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    found = queries.QUERIES["op3_chat_formatting"](spark, str(tmp_path))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM '{tmp_path}/conversations.parquet/*.parquet'")
    want = con.sql(queries.ORACLE_SQL["op3_chat_formatting"])
    assert want.columns == found.columns
    got = sorted(map(str, map(tuple, found.collect())))
    assert got == sorted(map(str, want.fetchall()))
    assert {r.status for r in found.collect()} == {"ok", "invalid", "cycle", "no_result", "duplicate", "early", "orphan"}


def test_plain_tables(spark):
    frame = spark.createDataFrame([(1, 0, "user", "hi")], "conv_id long, turn long, role string, text string")
    assert [r.json for r in chat.link(spark, frame).collect()] == ['{"content":"hi","role":"user"}']
    assert chat.link(spark, frame.limit(0)).collect() == []


def test_schemas():
    check = lambda v, s: chat.violation(v, s)
    assert check({"a": [1, "x"]}, {"properties": {"a": {"type": "array", "items": {"type": "integer"}}}}) == "$.a[1]: type"
    assert check(True, {"type": "integer"}) == "$: type" and check(2.0, {"type": "integer"}) is None and check(5, {"maximum": 4}) == "$: range"
    assert check("q", {"enum": ["a"]}) == "$: enum" and check(None, {"type": ["string", "null"]}) is None
