"""Tool-call linking for chat transcripts, with DataFrame functions only.

A turn whose text is a JSON object may carry tool calls ({"tool_calls": [{"id", "name", "arguments",
"depends_on"}]}) or a tool's result ({"tool_call_id", "content"}). Calls and results meet by a hash join on
(conversation, identifier). Arguments are checked against the schema of the tool: known tool, a JSON object,
required parameters present, no unknown parameters, types as declared. Calls are ordered topologically: a
call stands one level below the deepest call that it depends on, its result one step after it. Every row
is written as canonical JSON (keys in order, no spaces).

One row comes out for each plain message, call and result, so a turn gives as many as it holds: with calls and content
it is a message before its calls, and with calls and a result (whose content it then is) both. position orders a conversation (turn, level, step,
index), as a sort key, so a conversation of any length stays spread over the cluster.

Nulls: a null text is a message with null content; a null role or turn stays null; calls and results without an
identifier or conversation are not linked (status no_id). Of calls that repeat an identifier in a conversation the first (by
turn, index, and the row it came in) is the call and the others are duplicate_id; a result's repeats all link. Calls on a cycle,
or behind one, or dependent on an identifier that is no call get status unresolved. Texts of any length are taken whole;
one that isn't JSON is a message. Rows that repeat each come out. Other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import json
from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from procloom.llm import shared

#: Parameters of the tools that the query checks by: name -> (parameter -> (JSON type, required)).
SCHEMAS: dict[str, dict[str, tuple[str, bool]]] = {
    "search": {"query": ("string", True), "limit": ("integer", False)},
    "calculator": {"expression": ("string", True)},
    "weather": {"place": ("string", True), "days": ("integer", False)},
}
_CALL = "struct<id:string,name:string,arguments:string,depends_on:array<string>>"


def json_type(value: str) -> str:
    """SQL that names the JSON type of a variant."""
    kind = f"schema_of_variant({value})"
    return f"CASE WHEN {kind} LIKE 'OBJECT%' THEN 'object' WHEN {kind} LIKE 'ARRAY%' THEN 'array' WHEN {kind} = 'STRING' THEN 'string' WHEN {kind} = 'BOOLEAN' THEN 'boolean' WHEN {kind} = 'BIGINT' THEN 'integer' WHEN {kind} = 'VOID' THEN 'null' ELSE 'number' END"


def canonical(text: str) -> str:
    """SQL for a JSON text with keys in order and without spaces; null if it isn't JSON."""
    return f"to_json(try_parse_json({text}))"


#: Calls of a conversation up to which one row orders them.
FEW_CALLS = 256
_DONE = "struct<call_id:string,level:int,at:bigint>"


def in_order(calls: DataFrame) -> DataFrame:
    """conv_id, call_id, level, at of the calls (conv_id, call_id, turn, index, needs) that a pass in the order of turns resolves, for conversations of at most FEW_CALLS."""
    few = calls.groupBy("conv_id").agg(F.count("*").alias("n")).where(F.col("n") <= FEW_CALLS).select("conv_id")
    few = shared.spill(few, "few")  # apart from the join, so that a conversation with many calls isn't one task's
    rows = calls.join(few, "conv_id").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "index", "call_id", "needs"))).alias("calls"))
    # a call goes on the list of done ones if all that it needs is on it
    met = "filter(acc, x -> array_contains(c.needs, x.call_id))"
    step = f"""(acc, c) -> if(size({met}) = size(c.needs), concat(acc, array(named_struct('call_id', c.call_id,
        'level', coalesce(array_max(transform({met}, x -> x.level)) + 1, 0), 'at', greatest(c.turn, array_max(transform({met}, x -> x.at)))))), acc)"""
    return rows.select("conv_id", F.explode(F.expr(f"aggregate(calls, cast(array() as array<{_DONE}>), {step})")).alias("d")).select("conv_id", "d.*")


def levels(calls: DataFrame) -> DataFrame:
    """conv_id, call_id, level, at of the calls (conv_id, call_id, turn, index, needs) whose dependencies resolve. at is the latest turn of a call and all that it depends on: its place in the transcript.

    A call usually needs earlier ones, so one pass over a conversation of few calls resolves it. For the rest, chains of calls with one need each are
    first drawn together by pointer doubling, in as many rounds as the logarithm of their length; then the calls with several needs are taken level by level."""
    key = ["conv_id", "call_id"]
    done = shared.spill(in_order(calls), "ordered")
    left = shared.spill(calls.join(done.select(key), key, "left_anti"), "left")
    if left.isEmpty():
        return done
    n = F.size("needs")
    done = shared.spill(done.unionByName(left.where(n == 0).select(*key, F.lit(0).alias("level"), F.col("turn").cast("long").alias("at"))), "done")
    # chains: to is where a call's chain of single needs leads, after steps, and at the latest turn on the way
    chain = shared.spill(left.where(n == 1).select(*key, F.get("needs", 0).alias("to"), F.lit(1).alias("steps"), F.col("turn").cast("long").alias("at")), "chain")
    for _ in range(chain.count().bit_length() + 1):  # a cycle would never end
        ahead = chain.select("conv_id", F.col("call_id").alias("to"), F.col("to").alias("over"), F.col("steps").alias("more"), F.col("at").alias("then"))
        jump = chain.join(ahead, ["conv_id", "to"], "left").select(*key, F.coalesce("over", "to").alias("to"), (F.col("steps") + F.coalesce("more", F.lit(0))).alias("steps"), F.greatest("at", "then").alias("at"), F.col("over").isNotNull().alias("jumped"))
        jump = shared.spill(jump, "chain")
        chain = jump.drop("jumped")
        if jump.where("jumped").isEmpty():
            break
    many = left.where(n > 1).select(*key, "turn", n.alias("n"), F.explode("needs").alias("on"))
    ends = chain.select("conv_id", F.col("call_id").alias("on"), "to", "steps", F.col("at").alias("then"))
    waiting = many.join(ends, ["conv_id", "on"], "left").select(*key, "turn", "n", F.coalesce("to", "on").alias("to"), F.coalesce("steps", F.lit(0)).alias("steps"), "then")
    waiting = shared.spill(waiting, "waiting")
    told = lambda: done.select("conv_id", F.col("call_id").alias("to"), "level", F.col("at").alias("before"))
    while not waiting.isEmpty():
        met = waiting.join(told(), ["conv_id", "to"]).groupBy(*key, "turn", "n").agg(F.count("*").alias("met"), F.max(F.col("level") + F.col("steps")).alias("deepest"), F.max(F.greatest("then", "before")).alias("after"))
        ready = shared.spill(met.where("met = n").select(*key, (F.col("deepest") + 1).alias("level"), F.greatest("turn", "after").alias("at")), "level")
        if ready.isEmpty():
            break
        done = shared.spill(done.unionByName(ready), "done")
        waiting = shared.spill(waiting.join(ready.select(key), key, "left_anti"), "waiting")
    along = chain.join(told(), ["conv_id", "to"]).select(*key, (F.col("level") + F.col("steps")).alias("level"), F.greatest("at", "before").alias("at"))
    return done.unionByName(along)


def link(turns: DataFrame, schemas: Mapping[str, Mapping[str, tuple[str, bool]]] = SCHEMAS) -> DataFrame:
    """conv_id, turn, role, kind, call_id, name, status, n_results, level, position, body of each message, call and result in turns (conv_id, turn, role, text)."""
    with shared.scratch():
        spark = turns.sparkSession
        spec = json.dumps({n: [{"param": p, "type": t, "required": r} for p, (t, r) in ps.items()] for n, ps in schemas.items()})
        tools = spark.range(1).select(F.explode(F.from_json(F.lit(spec), "map<string,array<struct<param:string,type:string,required:boolean>>>")).alias("name", "params"))
        parsed = turns.select("conv_id", "turn", "role", "text", F.monotonically_increasing_id().alias("row"), F.when(F.ltrim("text").startswith("{"), F.from_json("text", f"tool_calls array<{_CALL}>, tool_call_id string, content string")).alias("j"))
        parsed = shared.spill(parsed.select("*", F.coalesce(F.size("j.tool_calls") > 0, F.lit(False)).alias("calls"), F.col("j.tool_call_id").isNotNull().alias("result")), "turns", outlast=1)

        calls = parsed.where("calls").select("conv_id", "turn", "role", "row", F.posexplode("j.tool_calls").alias("index", "c")).select("conv_id", "turn", "role", "row", "index", "c.*")
        # what has no identifier or conversation links with nothing, and is kept out of the joins
        named = F.col("id").isNotNull() & F.col("conv_id").isNotNull()
        first = shared.spill(calls.where(named).groupBy("conv_id", "id").agg(F.min(F.struct("turn", "index", "row")).alias("first")), "first")
        loose = calls.where(~named).withColumn("own", F.lit(False))
        calls = calls.where(named).join(first, ["conv_id", "id"]).withColumn("own", F.struct("turn", "index", "row").eqNullSafe(F.col("first"))).drop("first")
        calls = calls.unionByName(loose).join(F.broadcast(tools), "name", "left")  # as many rows as schemas
        calls = calls.withColumn("v", F.expr("try_parse_json(arguments)"))
        calls = calls.withColumn("object", F.expr("coalesce(schema_of_variant(v) LIKE 'OBJECT%', false)"))
        calls = calls.withColumn("keys", F.when(F.col("object"), F.coalesce(F.json_object_keys("arguments"), F.array().cast("array<string>"))).otherwise(F.array().cast("array<string>")))
        calls = calls.withColumn("kinds", F.when(F.col("object"), F.expr(f"transform_values(from_json(arguments, 'map<string,variant>'), (k, x) -> {json_type('x')})")))
        lacks = F.exists("params", lambda p: p["required"] & ~F.array_contains("keys", p["param"]))
        extra = F.exists("keys", lambda k: ~F.exists("params", lambda p: p["param"] == k))
        wrong = F.exists("params", lambda p: F.coalesce((F.element_at("kinds", p["param"]) != p["type"]) & ~((p["type"] == "number") & (F.element_at("kinds", p["param"]) == "integer")), F.lit(False)))
        status = (
            F.when(F.col("id").isNull() | F.col("conv_id").isNull(), "no_id").when(~F.col("own"), "duplicate_id").when(F.col("params").isNull(), "unknown_tool").when(~F.col("object"), "bad_arguments")
            .when(lacks, "missing_parameter").when(extra, "unknown_parameter").when(wrong, "wrong_type").otherwise("valid")
        )
        calls = shared.spill(calls.select("conv_id", "turn", "role", "index", F.col("id").alias("call_id"), "name", "arguments", "depends_on", "own", status.alias("status")), "checked", outlast=1)
        own = shared.spill(calls.where("own").select("conv_id", "call_id", "turn", "index", "name", F.coalesce(F.array_distinct("depends_on"), F.array().cast("array<string>")).alias("needs")), "own")
        level = levels(own)
        results = parsed.where("result").select("conv_id", "turn", "role", F.col("j.tool_call_id").alias("call_id"), F.col("j.content").alias("content"))
        answered = shared.spill(results.where("conv_id is not null").groupBy("conv_id", "call_id").agg(F.count("*").alias("answers")), "answered")
        # one row a call, written apart from the joins, in which the rows of an identifier that repeats can then be split over tasks
        heads = own.select("conv_id", "call_id", F.col("name").alias("call_name"), F.col("turn").alias("call_turn"), F.col("index").alias("call_index")).join(level, ["conv_id", "call_id"], "left").join(answered, ["conv_id", "call_id"], "left")
        heads = shared.spill(heads, "heads", outlast=1)
        alone = lambda df, key: df.where(F.col(key).isNull() | F.col("conv_id").isNull())
        linked = lambda df: df.where(F.col("call_id").isNotNull() & F.col("conv_id").isNotNull()).join(heads, ["conv_id", "call_id"], "left").unionByName(alone(df, "call_id"), allowMissingColumns=True)
        zero = F.lit(0).cast("long")
        spot = lambda turn, level, step, index: F.struct(turn.cast("long").alias("turn"), level.cast("int").alias("level"), step.cast("int").alias("step"), index.cast("int").alias("index")).alias("position")
        call_rows = linked(calls).select(
            "conv_id", "turn", "role", F.lit("call").alias("kind"), "call_id", "name",
            F.when((F.col("status") == "valid") & F.col("level").isNull(), "unresolved").otherwise(F.col("status")).alias("status"),
            F.when(F.col("own"), F.coalesce("answers", zero)).otherwise(zero).alias("n_results"), "level",
            spot(F.coalesce("at", "turn"), F.coalesce("level", zero), F.lit(0), F.col("index")),
            F.expr(f"to_json(named_struct('arguments', coalesce({canonical('arguments')}, arguments), 'id', call_id, 'name', name, 'role', role), map('ignoreNullFields', 'false'))").alias("body"),
        )
        result_rows = linked(results).select(
            "conv_id", "turn", "role", F.lit("result").alias("kind"), "call_id", F.col("call_name").alias("name"), F.when(F.col("call_turn").isNull(), "orphan").when(F.col("turn") < F.col("call_turn"), "early").otherwise("linked").alias("status"), zero.alias("n_results"), "level",
            spot(F.greatest("turn", "at"), F.coalesce("level", zero), F.lit(1), F.coalesce("call_index", zero)),
            F.expr(f"to_json(named_struct('content', coalesce({canonical('content')}, content), 'role', role, 'tool_call_id', call_id), map('ignoreNullFields', 'false'))").alias("body"),
        )
        said = parsed.where("not result and (not calls or j.content is not null)")
        plain = said.select(
            "conv_id", "turn", "role", F.lit("message").alias("kind"), F.lit(None).cast("string").alias("call_id"), F.lit(None).cast("string").alias("name"), F.lit("plain").alias("status"), zero.alias("n_results"), F.lit(0).alias("level"),
            spot(F.col("turn"), F.lit(0), F.lit(0), F.when(F.col("calls"), -1).otherwise(0)),
            F.expr("to_json(named_struct('content', if(calls, j.content, text), 'role', role), map('ignoreNullFields', 'false'))").alias("body"),
        )
        return plain.unionByName(call_rows).unionByName(result_rows)
