from __future__ import annotations

import json
import random

import pytest
from pyspark.sql import functions as F

from procloom.operators import schemas


def kind(v):
    for name, t in (("boolean", bool), ("object", dict), ("array", list), ("string", str), ("number", (int, float))):
        if isinstance(v, t):
            return name
    return "null"


def brute(root, s, v, at="", depth=8):
    """(pointer, keyword) of all breaches."""
    if s is True:
        return []
    if s is False:
        return [(at, "false")]
    out, k = [], kind(v)
    if "$ref" in s:
        target = root
        for step in s["$ref"][2:].split("/"):
            target = target[step]
        out += [(at, "DEPTH")] if depth <= 0 else brute(root, target, v, at, depth - 1)
    if "type" in s:
        names = [s["type"]] if isinstance(s["type"], str) else s["type"]
        if not (k in names or "integer" in names and k == "number" and v == int(v)):
            out.append((at, "type"))
    for name, fits in (("enum", lambda x: v in x and (k != "boolean" or any(y is v for y in x))), ("const", lambda x: v == x and kind(x) == k)):
        if name in s and not fits(s[name]):
            out.append((at, name))
    if k == "number":
        out += [(at, n) for n, bad in (("minimum", lambda m: v < m), ("maximum", lambda m: v > m), ("exclusiveMinimum", lambda m: v <= m)) if n in s and bad(s[n])]
    size = {"string": ("minLength", "maxLength"), "array": ("minItems", "maxItems"), "object": ("minProperties", "maxProperties")}.get(k)
    if size:
        out += [(at, n) for n, bad in zip(size, (lambda m: len(v) < m, lambda m: len(v) > m)) if n in s and bad(s[n])]
    if k == "array":
        if s.get("uniqueItems") and len({json.dumps(x, sort_keys=True) for x in v}) < len(v):
            out.append((at, "uniqueItems"))
        for i, x in enumerate(v if "items" in s else []):
            out += brute(root, s["items"], x, f"{at}/{i}", depth)
    if k == "object":
        out += [(f"{at}/{n}", "required") for n in s.get("required", []) if n not in v]
        for n, x in v.items():
            if n in s.get("properties", {}):
                out += brute(root, s["properties"][n], x, f"{at}/{n}", depth)
            elif s.get("additionalProperties") is False:
                out.append((f"{at}/{n}", "additionalProperties"))
            elif "additionalProperties" in s:
                out += brute(root, s["additionalProperties"], x, f"{at}/{n}", depth)
    fits = lambda x: not brute(root, x, v, at, depth)
    if "oneOf" in s and sum(map(fits, s["oneOf"])) != 1:
        out.append((at, "oneOf"))
    if "anyOf" in s and not any(map(fits, s["anyOf"])):
        out.append((at, "anyOf"))
    if "not" in s and fits(s["not"]):
        out.append((at, "not"))
    for x in s.get("allOf", []):
        out += brute(root, x, v, at, depth)
    return out


def value(rng, depth=3):
    simple = [None, True, False, 0, 1, -3, 2.5, "", "a", "bcd", "é漢"]
    if depth == 0 or rng.random() < 0.4:
        return rng.choice(simple)
    if rng.random() < 0.5:
        return [value(rng, depth - 1) for _ in range(rng.randint(0, 3))]
    return {k: value(rng, depth - 1) for k in rng.sample(["a", "b", "c", "next"], rng.randint(0, 3))}


SCHEMAS = [
    {"type": "object", "required": ["a"], "properties": {"a": {"type": ["integer", "null"]}, "b": {"items": {"type": "number", "minimum": 1}, "maxItems": 1}}, "additionalProperties": False},
    {"oneOf": [{"type": "string", "minLength": 2}, {"type": "array", "uniqueItems": True}, {"type": "number"}, {"type": "integer"}]},
    {"$ref": "#/$defs/n", "$defs": {"n": {"type": "object", "properties": {"next": {"$ref": "#/$defs/n"}, "c": {"enum": ["a", 1, None]}}, "additionalProperties": {"not": {"type": "boolean"}}}}},
    {"anyOf": [{"type": "object", "minProperties": 2}, {"const": "a"}, {"items": {"type": "array"}}], "allOf": [{"maxProperties": 2}, {"not": {"const": 2.5}}], "exclusiveMinimum": 0},
]


@pytest.mark.parametrize("schema", SCHEMAS)
def test_breaches_equal_those_of_plain_recursion(spark, schema):
    rng = random.Random(7)
    values = [value(rng) for _ in range(150)]
    df = spark.createDataFrame([(k, json.dumps(v, ensure_ascii=False)) for k, v in enumerate(values)], "id long, text string")
    for r in df.select("id", schemas.breaches(schema, F.col("text"), 3).alias("e")).collect():
        assert sorted(map(tuple, r["e"])) == sorted(brute(schema, schema, values[r["id"]], depth=3)), values[r["id"]]


def test_texts_that_are_no_json_and_recursion_beyond_its_depth(spark):
    deep = {"next": {"next": {"next": {"next": {}}}}}
    df = spark.createDataFrame([(1, "{"), (2, None), (3, json.dumps(deep)), (4, "null")], "id long, text string")
    found = {r["id"]: [tuple(e) for e in r["e"]] for r in df.select("id", schemas.breaches(SCHEMAS[2], F.col("text"), 3).alias("e")).collect()}
    assert found[1] == found[2] == [("", "JSON")] and found[3] == [("/next/next/next", "DEPTH")] and found[4] == [("", "type")]
    assert schemas.deepest(df.where("id = 3"), "text") == 5
    with pytest.raises(ValueError):
        schemas.breaches({"format": "x"}, F.col("text"))
