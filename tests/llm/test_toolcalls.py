from __future__ import annotations

import json
import random

from procloom.llm import queries, toolcalls

from ..oracle import connect, rows, sql_rows
from . import nasty

SCHEMA = "conv_id long, turn long, role string, text string, kind string, status string"
SF = "/root/testdata/sf0.01"


def call(i, name="search", args='{"query":"x"}', after=()):
    return {"id": i, "name": name, "arguments": args, "depends_on": list(after)}


def turns(spark, made):
    return spark.createDataFrame([(c, t, r, x, "k", "s") for c, t, r, x in made], SCHEMA)


def linked(spark, made):
    return toolcalls.link(turns(spark, made)).collect()


def test_query_gives_the_rows_of_its_sql(spark):
    columns, wanted = sql_rows(connect(SF), queries.SQL["op5_tool_calls"])
    df = queries.op5_tool_calls(spark, SF)
    assert sorted(df.columns) == columns and rows(df) == wanted


def test_statuses(spark):
    args = {
        "valid": '{"limit": 3, "query": "x"}', "missing_parameter": '{"limit": 3}', "unknown_parameter": '{"query": "x", "z": 1}', "wrong_type": '{"query": "x", "limit": "3"}', "bad_arguments": "[1]",
    }
    calls = [call(s, args=a) for s, a in args.items()] + [call("unknown_tool", name="fly"), call(None), call("valid"), call("nul", args='{"query": null}'), call("bad", args="{")]
    found = linked(spark, [(1, 1, "assistant", json.dumps({"tool_calls": calls}))])
    status = [r["status"] for r in sorted(found, key=lambda r: r["position"]["index"])]
    assert status == ["valid", "missing_parameter", "unknown_parameter", "wrong_type", "bad_arguments", "unknown_tool", "no_id", "duplicate_id", "wrong_type", "bad_arguments"]
    first = next(r for r in found if r["call_id"] == "valid" and r["status"] == "valid")
    assert first["body"] == '{"arguments":{"limit":3,"query":"x"},"id":"valid","name":"search","role":"assistant"}'.replace('{"limit":3,"query":"x"}', json.dumps('{"limit":3,"query":"x"}'))


def levels_by_hand(deps):
    level, changed = {i: 0 for i, d in deps.items() if not d}, True
    while changed:
        changed = False
        for i, d in deps.items():
            if i not in level and all(x in level for x in d):
                level[i], changed = 1 + max(level[x] for x in d), True
    return level


def test_topological_levels_and_results(spark):
    rng = random.Random(2)
    made, wanted = [], {}
    for c in range(12):
        ids = [f"c{k}" for k in range(8)]
        deps = {i: rng.sample([x for x in [*ids, "ghost"] if x != i], rng.choice([0, 0, 1, 2])) for i in ids}
        made.append((c, 1, "assistant", json.dumps({"tool_calls": [call(i, after=deps[i]) for i in ids]})))
        made += [(c, 2 + k, "tool", json.dumps({"tool_call_id": i, "content": "{}"})) for k, i in enumerate(rng.sample([*ids, "stray"], 4))]
        made.append((c, 0, "user", "hello"))
        for i, n in levels_by_hand(deps).items():
            wanted[c, i] = n
    found = linked(spark, made)
    assert len(found) == 12 * (8 + 4 + 1)
    calls = [r for r in found if r["kind"] == "call"]
    assert {(r["conv_id"], r["call_id"]): r["level"] for r in calls if r["level"] is not None} == wanted
    assert all((r["status"] == "valid") == ((r["conv_id"], r["call_id"]) in wanted) for r in calls)
    answered = {}
    for c, _, _, x in made:
        if x.startswith('{"tool_call_id"'):
            i = json.loads(x)["tool_call_id"]
            answered[c, i] = answered.get((c, i), 0) + 1
    assert all(r["n_results"] == answered.get((r["conv_id"], r["call_id"]), 0) for r in calls)
    assert all((r["status"] == "orphan") == (r["call_id"] == "stray") for r in found if r["kind"] == "result")


def test_nulls_ties_and_no_rows(spark):
    one = json.dumps({"tool_calls": [call("a")]})
    made = [(None, None, None, None), (1, 1, "user", ""), (1, 1, "user", ""), (1, 2, "assistant", one), (1, 2, "assistant", one), (1, 1, "tool", '{"tool_call_id": "a", "content": null}'), (1, 3, "user", "{not json"), (1, 4, "user", "x" * 100_000), (1, None, "tool", '{"tool_call_id": "a"}')]
    found = linked(spark, made)
    assert len(found) == len(made)
    assert sorted(r["status"] for r in found if r["kind"] == "call") == ["duplicate_id", "valid"]
    assert toolcalls.link(turns(spark, [])).count() == 0


def test_turns_that_hold_several_things_lose_none(spark):
    both = json.dumps({"content": "I look it up", "tool_calls": [call("a"), call("b")]})
    chained = json.dumps({"tool_call_id": "a", "content": "found", "tool_calls": [call("c")]})
    found = sorted(linked(spark, [(1, 1, "assistant", both), (1, 2, "tool", chained), (1, 3, "assistant", json.dumps({"content": None, "tool_calls": [call("d")]}))]), key=lambda r: r["position"])
    assert [(r["turn"], r["kind"], r["call_id"], r["status"], r["n_results"]) for r in found if r["kind"] != "result"] == [(1, "message", None, "plain", 0), (1, "call", "a", "valid", 1), (1, "call", "b", "valid", 0), (2, "call", "c", "valid", 0), (3, "call", "d", "valid", 0)]
    assert [(r["turn"], r["call_id"], r["status"], json.loads(r["body"])["content"]) for r in found if r["kind"] == "result"] == [(2, "a", "linked", "found")]
    assert found[0]["body"] == '{"content":"I look it up","role":"assistant"}'


def test_long_chains_and_many_calls(spark, monkeypatch):
    rng = random.Random(5)
    monkeypatch.setattr(toolcalls, "FEW_CALLS", 6)
    made, wanted = [], {}
    for c, n in enumerate([5, 40, 60, 30]):
        ids = [f"c{k}" for k in range(n)]
        deps = {i: [ids[k - 1]] if k else [] for k, i in enumerate(ids)}  # a chain
        for _ in range(n // 6):
            k = rng.randrange(1, n)
            deps[ids[k]] = rng.sample(ids[:k], min(k, rng.choice([0, 2, 3])))
        if c == 3:
            deps["c10"] = ["c20"]  # a cycle, and what is behind it
            deps["c25"] = ["ghost"]
        order = rng.sample(ids, n) if c == 2 else ids
        made += [(c, t, "assistant", json.dumps({"tool_calls": [call(i, after=deps[i])]})) for t, i in enumerate(order)]
        wanted |= {(c, i): k for i, k in levels_by_hand(deps).items()}
    found = {(r["conv_id"], r["call_id"]): (r["level"], r["status"], r["position"]["turn"], r["turn"]) for r in linked(spark, made)}
    assert {k: v[0] for k, v in found.items() if v[0] is not None} == wanted
    assert all((v[1] == "valid") == (k in wanted) and v[2] >= v[3] for k, v in found.items())
    deps = {(c, i): json.loads(x)["tool_calls"][0]["depends_on"] for c, _, _, x in made for i in [json.loads(x)["tool_calls"][0]["id"]]}
    assert all(found[k][2] == max([found[k][3], *(found[k[0], d][2] for d in deps[k])]) for k in wanted)


def test_plain_nasty_texts_are_messages(spark):
    df = nasty.docs(spark).withColumnsRenamed({"doc_id": "conv_id", "id": "turn", "lang": "role"})
    found = toolcalls.link(df).collect()
    assert len(found) == df.count() and all(r["kind"] == "message" for r in found)
