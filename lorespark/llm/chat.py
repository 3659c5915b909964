"""Tool-call linking in conversations.

Messages are rows of one turn.  An assistant's text may be a JSON object with
``tool_calls``, a list of ``id``, ``name``, ``arguments`` and optionally ``depends_on``;
a tool's text is a JSON object with ``tool_call_id`` and ``content``.  Calls and results
are hash-joined by conversation and identifier, calls are ordered after those they depend
on, arguments are checked against the tool's schema, and everything is written as
canonical JSON.  A conversation is never gathered in one place: the order is a sort key
in each row, and calls are ordered in blocks of a bounded number.
"""

from __future__ import annotations

import json
from collections import defaultdict
from collections.abc import Mapping

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lorespark.llm.common import Scratch, groups, shuffle_partitions, slices

#: Tools of the registered query: a JSON schema for each.
SCHEMAS: dict[str, dict] = {
    "search": {"type": "object", "properties": {"query": {"type": "string", "minLength": 1}, "limit": {"type": "integer", "minimum": 1, "maximum": 100}}, "required": ["query"], "additionalProperties": False},
    "calculate": {"type": "object", "properties": {"expression": {"type": "string"}}, "required": ["expression"], "additionalProperties": False},
}

PARSED = "conv_id long, turn long, role string, kind string, idx int, call_id string, name string, depends_on array<string>, valid boolean, problem string, json string"
_NAMES = [p.split()[0] for p in PARSED.split(", ")]
_KINDS = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int32(), pa.string(), pa.string(), pa.list_(pa.string()), pa.bool_(), pa.string(), pa.string()]

#: Dependencies that a block should hold; a conversation of more calls is cut into ranges of turns.
BLOCK_CALLS = 200_000

_TYPES = {"object": dict, "array": list, "string": str, "boolean": bool, "null": type(None)}


def canonical(value) -> str:
    """Keys in order, no spaces, whole floats as integers, no escapes beyond the needed."""

    def plain(x):
        if isinstance(x, dict):
            return {k: plain(v) for k, v in x.items()}
        if isinstance(x, list):
            return [plain(v) for v in x]
        return int(x) if isinstance(x, float) and x.is_integer() and abs(x) < 2**53 else x

    return json.dumps(plain(value), ensure_ascii=False, sort_keys=True, separators=(",", ":"), allow_nan=False)


def _is(value, kind: str) -> bool:
    if kind in ("integer", "number"):
        number = isinstance(value, (int, float)) and not isinstance(value, bool)
        return number and (kind == "number" or isinstance(value, int) or value.is_integer())
    return isinstance(value, _TYPES[kind])


def violation(value, schema: Mapping, at: str = "$") -> str | None:
    """First violation of the schema in the order of its keys, or null."""
    kinds = schema.get("type")
    if kinds is not None and not any(_is(value, k) for k in ([kinds] if isinstance(kinds, str) else kinds)):
        return f"{at}: type"
    if "enum" in schema and canonical(value) not in {canonical(v) for v in schema["enum"]}:
        return f"{at}: enum"
    if isinstance(value, str) and not schema.get("minLength", 0) <= len(value) <= schema.get("maxLength", len(value)):
        return f"{at}: length"
    if _is(value, "number") and not schema.get("minimum", value) <= value <= schema.get("maximum", value):
        return f"{at}: range"
    if isinstance(value, list) and "items" in schema:
        return next((v for k, x in enumerate(value) if (v := violation(x, schema["items"], f"{at}[{k}]"))), None)
    if isinstance(value, dict):
        missing = [k for k in schema.get("required", ()) if k not in value]
        if missing:
            return f"{at}.{missing[0]}: required"
        known = schema.get("properties", {})
        for k in sorted(value):
            if k in known:
                if found := violation(value[k], known[k], f"{at}.{k}"):
                    return found
            elif schema.get("additionalProperties") is False:
                return f"{at}.{k}: unknown"
    return None


def _finite(digits: str) -> float:
    value = float(digits)
    if value in (float("inf"), float("-inf")):
        raise ValueError("a number beyond those that can be written again")
    return value


def _no_number(name: str):
    raise ValueError(f"{name} is no JSON")


def _object(text: str | None) -> dict | None:
    """The JSON object that a text is; null for any other text, and for one that can't be written again."""
    if not text or not text.lstrip()[:1] == "{":
        return None
    try:
        value = json.loads(text, parse_constant=_no_number, parse_float=_finite)
        if not isinstance(value, dict):
            return None
        canonical(value).encode("utf-8")  # half of a pair of surrogates can't be, nor too deep a nesting
    except (ValueError, RecursionError):
        return None
    return value


def parse(conv, turn, role, text, schemas: Mapping[str, Mapping]) -> list[tuple]:
    """Rows of one message: itself, and each call or the result that it holds."""
    found = _object(text) if role in ("assistant", "tool") else None
    head = (conv, turn, role)
    if role == "tool" and found is not None and isinstance(found.get("tool_call_id"), str):
        body = {"content": found.get("content"), "role": "tool", "tool_call_id": found["tool_call_id"]}
        return [(*head, "result", 0, found["tool_call_id"], None, [], True, None, canonical(body))]
    calls = found.get("tool_calls") if found and role == "assistant" else None
    if not isinstance(calls, list):
        return [(*head, "message", 0, None, None, [], True, None, canonical({"content": text, "role": role}))]
    out = [(*head, "message", 0, None, None, [], True, None, canonical({"content": found.get("content"), "role": role}))] if found.get("content") is not None or not calls else []
    for k, call in enumerate(calls):
        call = call if isinstance(call, dict) else {}
        name, ident, given = call.get("name"), call.get("id"), call.get("arguments")
        if isinstance(given, str):
            given = _object(given)
        deps = [d for d in call.get("depends_on") or [] if isinstance(d, str)] if isinstance(call.get("depends_on") or [], list) else []
        if not isinstance(ident, str):
            problem = "no identifier"
        elif not isinstance(name, str) or name not in schemas:
            problem = "unknown tool"
        elif not isinstance(given, dict):
            problem = "no arguments"
        else:
            problem = violation(given, schemas[name])
        body = {"arguments": given, "id": ident if isinstance(ident, str) else None, "name": name if isinstance(name, str) else None, "type": "call"}
        out.append((*head, "call", k, body["id"], body["name"], sorted(set(deps)), problem is None, problem, canonical(body)))
    return out


def parsed(messages: DataFrame, schemas: Mapping[str, Mapping]) -> DataFrame:
    def run(batches):
        for batch in slices(batches, "text"):
            rows = [r for m in batch.to_pylist() for r in parse(m["conv_id"], m["turn"], m["role"], m["text"], schemas)]
            columns = list(zip(*rows)) or [()] * len(_KINDS)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, _KINDS)], _NAMES)

    chosen = messages.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), F.col("role").cast("string"), F.col("text").cast("string"))
    return chosen.mapInArrow(run, PARSED)


def settle(needs: dict[tuple, list[tuple]], known: dict[tuple, int]) -> dict[tuple, int]:
    """Levels of the calls in ``needs`` that follow from those in ``known``: one more than the highest they need."""
    left = {call: sum(n not in known for n in own) for call, own in needs.items()}
    level = {call: 1 + max((known[n] for n in own if n in known), default=-1) for call, own in needs.items()}
    waiting = defaultdict(list)
    for call, own in needs.items():
        for n in own:
            if n not in known:
                waiting[n].append(call)
    ready, out = [c for c, n in left.items() if not n], {}
    while ready:
        call = ready.pop()
        out[call] = level[call]
        for after in waiting.pop(call, ()):
            level[after] = max(level[after], out[call] + 1)
            left[after] -= 1
            if not left[after]:
                ready.append(after)
    return out


def _settle(batches):
    """One block after another: rows of a call and one it needs, with that one's level if it is known."""
    for _, parts in groups(batches, "block"):
        needs, known = defaultdict(list), {}
        for part in parts:
            for conv, call, need, level in zip(*(part.column(c).to_pylist() for c in ("conv_id", "call_id", "needs", "level"))):
                own = needs[conv, call]
                if need is not None:
                    own.append((conv, need))
                    if level is not None:
                        known[conv, need] = level
        found = settle(needs, known)
        yield pa.RecordBatch.from_arrays(
            [pa.array([c for c, _ in found], pa.int64()), pa.array([i for _, i in found], pa.string()), pa.array(list(found.values()), pa.int32())], ["conv_id", "call_id", "level"]
        )


def _levels(calls: DataFrame, scratch: Scratch) -> DataFrame:
    """Longest chain of dependencies below each call; null on a cycle.

    ``calls`` has one row for each conversation and identifier.  Dependencies on calls
    that aren't there don't count.  Whole conversations share blocks of a bounded number
    of dependencies; a longer one is cut into ranges of turns.  A round settles whatever
    follows inside each block, so chains of any length within a block take one round, and
    a longer conversation one for each block that its longest chain enters.
    """
    key = ["conv_id", "call_id"]
    there = calls.select("conv_id", F.col("call_id").alias("needs"))
    asked = calls.select("conv_id", "call_id", "turn", F.explode_outer("depends_on").alias("needs"))
    met = asked.join(there.withColumn("there", F.lit(True)), ["conv_id", "needs"], "left")
    # a need that isn't there leaves the bare row of its call
    edges = scratch.save(met.select("conv_id", "call_id", "turn", F.when(F.col("there"), F.col("needs")).alias("needs")).distinct(), "needs")
    sizes = edges.groupBy("conv_id").agg(F.count("*").alias("n"))
    total, most = sizes.agg(F.sum("n"), F.max("n")).first()
    short = edges.join(sizes.where(F.col("n") <= BLOCK_CALLS).select("conv_id"), "conv_id", "left_semi")
    wanted = max(shuffle_partitions(scratch.spark), 2 * (total or 0) // BLOCK_CALLS)
    blocks = short.select("*", F.pmod(F.xxhash64("conv_id"), F.lit(wanted)).cast("int").alias("block"))
    if (most or 0) > BLOCK_CALLS:
        long = edges.join(sizes.where(F.col("n") > BLOCK_CALLS).select("conv_id"), "conv_id", "left_semi")
        ranged = long.repartitionByRange(2 * total // BLOCK_CALLS + 1, "conv_id", "turn", "call_id").select("*", (F.spark_partition_id() + wanted).alias("block"))
        blocks = blocks.unionByName(ranged)
    blocks = scratch.save(blocks.drop("turn"), "blocks")
    done = None
    while True:
        state = blocks.withColumn("level", F.lit(None).cast("int"))
        if done is not None:
            state = blocks.join(done, key, "left_anti").join(done.withColumnRenamed("call_id", "needs"), ["conv_id", "needs"], "left")
        state = state.select("block", *key, "needs", "level").repartition(shuffle_partitions(scratch.spark), "block").sortWithinPartitions("block")
        after = scratch.save(state.mapInArrow(_settle, "conv_id long, call_id string, level int"), "levels")
        done = after if done is None else done.unionByName(after)
        if (most or 0) <= BLOCK_CALLS or after.isEmpty():
            return calls.select(*key).join(done, key, "left")


def link(spark: SparkSession, messages: DataFrame, schemas: Mapping[str, Mapping] = SCHEMAS) -> DataFrame:
    """Every message, call and result as canonical JSON, with what it is linked to and where it belongs.

    Columns: ``conv_id``, ``turn``, ``role``, ``kind`` (message, call, result), ``idx``
    (place in its message), ``call_id``, ``name``, ``status``, ``problem``, ``level``, ``json``, and the sort
    key of the formatted conversation ``at_turn``, ``at_level``, ``at_idx``, ``at_part``: a
    turn's text, then its calls in topological order, each followed by its results,
    whatever turn these came in.

    ``status`` of a call: ``ok``, ``invalid`` (see ``problem``), ``cycle``, ``duplicate``
    (an earlier call has its identifier) or ``no_result``; of a result: ``ok``,
    ``duplicate`` (the first one counts), ``early`` (before its call) or ``orphan``; of a
    message: ``ok``.  Texts that aren't such JSON are plain messages, and so are texts whose
    JSON can't be written again: numbers that aren't finite or have thousands of digits,
    halves of surrogate pairs, too deep a nesting.  Null texts have null content.  Rows
    without a conversation link to nothing.  Repeated rows and empty tables are allowed;
    further columns, whatever their names, are not read.
    """
    scratch = Scratch(spark, "chat")
    rows = scratch.save(parsed(messages, schemas), "parsed")
    key = ["conv_id", "call_id"]
    order = F.struct("turn", "idx", "json", "depends_on")
    calls = rows.where("kind = 'call' and call_id is not null and conv_id is not null")
    first = calls.groupBy(*key).agg(F.min(order).alias("c"), F.count("*").alias("calls"))
    results = rows.where("kind = 'result' and conv_id is not null").groupBy(*key).agg(F.min(F.struct("turn", "json")).alias("r"))
    if first.isEmpty():
        levels = first.select(*key, F.lit(0).alias("level"))
    else:
        levels = _levels(scratch.save(first.select(*key, F.col("c.turn").alias("turn"), F.col("c.depends_on").alias("depends_on")), "calls"), scratch)
    linked = first.join(results, key, "full").join(levels, key, "left")
    linked = linked.select(*key, F.col("c.turn").alias("call_turn"), F.col("c.idx").alias("call_idx"), F.col("r.turn").alias("result_turn"), F.col("c").isNotNull().alias("called"), F.col("r").isNotNull().alias("answered"), "level")
    plain = rows.where("kind = 'message'").select("*", F.lit("ok").alias("status"), F.lit(None).cast("int").alias("level"), F.col("turn").alias("at_turn"), F.lit(-1).alias("at_level"), F.lit(0).alias("at_idx"), F.lit(0).alias("at_part"))
    rest = rows.where("kind <> 'message'").join(linked, key, "left")
    is_call = F.col("kind") == "call"
    own = (F.col("turn").eqNullSafe(F.col("call_turn"))) & (F.col("idx") == F.col("call_idx"))
    call_status = (
        F.when(F.col("call_id").isNotNull() & F.col("conv_id").isNotNull() & ~own, "duplicate")
        .when(~F.col("valid"), "invalid")
        .when(F.col("conv_id").isNotNull() & F.col("level").isNull(), "cycle")
        .when(~F.coalesce("answered", F.lit(False)), "no_result")
        .otherwise("ok")
    )
    result_status = (
        F.when(~F.coalesce("called", F.lit(False)), "orphan").when(F.col("turn") <= F.col("call_turn"), "early").when(F.col("turn") > F.col("result_turn"), "duplicate").otherwise("ok")
    )
    home = ~is_call & F.coalesce("called", F.lit(False))
    placed = rest.select(
        *rows.columns,
        F.when(is_call, call_status).otherwise(result_status).alias("status"),
        F.when(is_call & own, F.col("level")).alias("level"),
        F.when(home, F.col("call_turn")).otherwise(F.col("turn")).alias("at_turn"),
        F.coalesce(F.when(home | own, F.col("level")), F.lit(1 << 30)).cast("int").alias("at_level"),
        F.when(home, F.col("call_idx")).otherwise(F.col("idx")).alias("at_idx"),
        F.when(is_call, 0).otherwise(1).alias("at_part"),
    )
    names = ["conv_id", "turn", "role", "kind", "idx", "call_id", "name", "status", "problem", "level", "at_turn", "at_level", "at_idx", "at_part", "json"]
    return plain.select(names).unionByName(placed.select(names))


def with_tools(messages: DataFrame) -> DataFrame:
    """Plain conversations as ones with tools: every assistant's turn calls two tools, and their results are messages.

    What is called, needed, invalid, early or never answered follows from ``conv_id`` and
    ``turn``, so that a table without tool calls exercises every status.  Turns are four
    times those of the input.
    """
    conv, turn, text = F.col("conv_id").cast("long"), F.col("turn").cast("long"), F.coalesce(F.col("text").cast("string"), F.lit(""))
    ident = lambda sign, t=turn: F.concat(F.lit(sign), t.cast("string"))
    json_of = lambda c: F.to_json(c, {"ignoreNullFields": "true"})
    search = F.struct(
        F.lit("search").alias("name"), ident("a").alias("id"),
        json_of(F.struct(text.alias("query"), ((conv * 31 + turn * 7) % 130).alias("limit"))).alias("arguments"),
        F.when(conv % 7 == 0, F.array(ident("a", turn - 2), ident("b"))).otherwise(F.array(ident("a", turn - 2))).alias("depends_on"),
    )
    given = F.when(turn % 4 == 3, json_of(F.struct(F.lit("x").alias("text")))).otherwise(json_of(F.struct(F.concat(turn.cast("string"), F.lit("+1")).alias("expression"))))
    calculate = F.struct(F.lit("calculate").alias("name"), ident("b").alias("id"), given.alias("arguments"), F.array(ident("a")).alias("depends_on"))
    again = F.struct(F.lit("search").alias("name"), ident("a").alias("id"), F.lit('{"query":"again"}').alias("arguments"), F.array().cast("array<string>").alias("depends_on"))
    calls = F.when(conv % 3 == 1, F.array(search, calculate, again)).otherwise(F.array(search, calculate))
    asked = json_of(F.struct(calls.alias("tool_calls"), text.alias("content")))
    answer = lambda i, content: json_of(F.struct(i.alias("tool_call_id"), content.alias("content")))
    row = lambda t, role, said: F.struct(t.alias("turn"), F.lit(role).alias("role"), said.alias("text"))
    first = answer(ident("a"), F.struct(F.length(text).alias("z"), F.array(F.lit(1.0)).alias("a")))
    assistant = F.array(
        row(4 * turn, "assistant", asked),
        F.when((conv + turn) % 5 != 0, row(4 * turn + 1, "tool", first)),
        row(F.when((conv + turn) % 11 == 0, 4 * turn - 1).otherwise(4 * turn + 2), "tool", answer(ident("b"), turn)),
    )
    plain = F.struct((4 * turn).alias("turn"), F.col("role").cast("string").alias("role"), F.col("text").cast("string").alias("text"))
    user = F.array(plain, F.when((F.col("role") == "user") & (turn % 6 == 0), row(4 * turn + 1, "tool", answer(ident("u"), text))))
    rows = F.filter(F.when(F.col("role") == "assistant", assistant).otherwise(user), lambda r: r.isNotNull())
    return messages.select(conv.alias("conv_id"), F.explode(rows).alias("r")).select("conv_id", "r.turn", "r.role", "r.text")


#: The links in ``with_tools`` of ``conversations`` by plain rules: levels are places in runs of assistants at every second turn.
SQL = """
WITH c AS (SELECT conv_id AS c, turn AS t, role, text AS x FROM conversations),
i AS (SELECT *, t - 2 * row_number() OVER (PARTITION BY c, t % 2 ORDER BY t) AS run FROM c WHERE role = 'assistant'),
a AS (SELECT c, t, x, CASE WHEN c % 7 <> 0 THEN row_number() OVER (PARTITION BY c, t % 2, run ORDER BY t) - 1 END AS lev, (c * 31 + t * 7) % 130 AS lim FROM i),
calls AS (
  SELECT c, t, 0 AS idx, 'a' || t AS id, 'search' AS name, lev,
         CASE WHEN lim NOT BETWEEN 1 AND 100 THEN '$.limit: range' WHEN x = '' THEN '$.query: length' END AS problem, (c + t) % 5 <> 0 AS answered,
         '{"arguments":{"limit":' || lim || ',"query":' || to_json(x)::VARCHAR || '},"id":"a' || t || '","name":"search","type":"call"}' AS json FROM a
  UNION ALL
  SELECT c, t, 1, 'b' || t, 'calculate', lev + 1, CASE WHEN t % 4 = 3 THEN '$.expression: required' END, true,
         '{"arguments":{' || CASE WHEN t % 4 = 3 THEN '"text":"x"' ELSE '"expression":"' || t || '+1"' END || '},"id":"b' || t || '","name":"calculate","type":"call"}' FROM a),
results AS (
  SELECT c, t, 4 * t + 1 AS turn, 'a' || t AS id, 'ok' AS status, 0 AS at_idx, lev,
         '{"content":{"a":[1],"z":' || len(x) || '},"role":"tool","tool_call_id":"a' || t || '"}' AS json FROM a WHERE (c + t) % 5 <> 0
  UNION ALL
  SELECT c, t, CASE WHEN (c + t) % 11 = 0 THEN 4 * t - 1 ELSE 4 * t + 2 END, 'b' || t, CASE WHEN (c + t) % 11 = 0 THEN 'early' ELSE 'ok' END, 1, lev + 1,
         '{"content":' || t || ',"role":"tool","tool_call_id":"b' || t || '"}' FROM a)
SELECT c AS conv_id, 4 * t AS turn, role, 'message' AS kind, 0::INTEGER AS idx, NULL::VARCHAR AS call_id, NULL::VARCHAR AS name, 'ok' AS status, NULL::VARCHAR AS problem,
       NULL::INTEGER AS level, 4 * t AS at_turn, -1::INTEGER AS at_level, 0::INTEGER AS at_idx, 0::INTEGER AS at_part,
       '{"content":' || coalesce(to_json(x)::VARCHAR, 'null') || ',"role":' || coalesce(to_json(role)::VARCHAR, 'null') || '}' AS json FROM c
UNION ALL
SELECT c, 4 * t, 'assistant', 'call', idx::INTEGER, id, name,
       CASE WHEN problem IS NOT NULL THEN 'invalid' WHEN lev IS NULL THEN 'cycle' WHEN NOT answered THEN 'no_result' ELSE 'ok' END, problem,
       lev::INTEGER, 4 * t, coalesce(lev, 1073741824)::INTEGER, idx::INTEGER, 0::INTEGER, json FROM calls
UNION ALL
SELECT c, 4 * t, 'assistant', 'call', 2::INTEGER, 'a' || t, 'search', 'duplicate', NULL, NULL, 4 * t, 1073741824::INTEGER, 2::INTEGER, 0::INTEGER,
       '{"arguments":{"query":"again"},"id":"a' || t || '","name":"search","type":"call"}' FROM a WHERE c % 3 = 1
UNION ALL
SELECT c, turn, 'tool', 'result', 0::INTEGER, id, NULL, status, NULL, NULL, 4 * t, coalesce(lev, 1073741824)::INTEGER, at_idx::INTEGER, 1::INTEGER, json FROM results
UNION ALL
SELECT c, 4 * t + 1, 'tool', 'result', 0::INTEGER, 'u' || t, NULL, 'orphan', NULL, NULL, 4 * t + 1, 1073741824::INTEGER, 0::INTEGER, 1::INTEGER,
       '{"content":' || to_json(x)::VARCHAR || ',"role":"tool","tool_call_id":"u' || t || '"}' FROM c WHERE role = 'user' AND t % 6 = 0
"""
