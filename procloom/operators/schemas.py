"""JSON Schemas compiled into one column: a schema and a VARIANT give the list of all breaches, each with a JSON pointer and the keyword that is breached.

Objects, arrays, references, alternatives and recursion become nested expressions, so rows are checked where they are read, without Python and without a shuffle. A schema that
refers to itself is unrolled to a depth; data that is deeper is a breach (DEPTH), never accepted unseen.
"""

from __future__ import annotations

import json
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_ERROR = "array<struct<pointer: string, keyword: string>>"
#: Keywords that say something about values; others that are in a schema, but for annotations, raise.
_ANNOTATIONS = {"$schema", "$id", "$defs", "definitions", "title", "description", "default", "examples", "$comment"}
_KNOWN = {
    "type", "enum", "const", "minimum", "maximum", "exclusiveMinimum", "exclusiveMaximum", "multipleOf", "minLength", "maxLength", "pattern", "required", "properties", "additionalProperties",
    "items", "minItems", "maxItems", "uniqueItems", "oneOf", "anyOf", "allOf", "not", "$ref", "minProperties", "maxProperties",
}


def _none() -> Column:
    return F.array().cast(_ERROR)


def _if(bad: Column, pointer: Column, keyword: str) -> Column:
    return F.when(F.coalesce(bad, F.lit(False)), F.array(F.struct(pointer.alias("pointer"), F.lit(keyword).alias("keyword")))).otherwise(_none())


def _bound(value: Column, use) -> Column:  # noqa: ANN001
    """use(value) with value evaluated once."""
    return F.get(F.transform(F.array(value), use), 0)


def kind(value: Column) -> Column:
    """JSON type of a VARIANT: object, array, string, boolean, null, or number."""
    name = F.schema_of_variant(value)
    out = F.when(name.startswith("OBJECT"), "object").when(name.startswith("ARRAY"), "array").when(name == "STRING", "string").when(name == "BOOLEAN", "boolean")
    return out.when(value.isNull() | F.is_variant_null(value) | (name == "VOID"), "null").otherwise("number")


class Compiler:
    def __init__(self, schema: dict, depth: int) -> None:
        self.root, self.depth = schema, depth

    def resolve(self, ref: str) -> dict | bool:
        if not ref.startswith("#"):
            raise ValueError(f"{ref}: only references within a schema are known")
        at: object = self.root
        for step in filter(None, ref[1:].split("/")):
            at = at[step.replace("~1", "/").replace("~0", "~")]
        return at

    def errors(self, schema: dict | bool, value: Column, pointer: Column, depth: int) -> Column:
        """The breaches of a value (not null as a column) at a pointer."""
        if schema is True or schema == {}:
            return _none()
        if schema is False:
            return _if(F.lit(True), pointer, "false")
        unknown = set(schema) - _KNOWN - _ANNOTATIONS
        if unknown:
            raise ValueError(f"keywords that aren't known: {sorted(unknown)}")
        return _bound(F.struct(value.alias("v"), kind(value).alias("k")), lambda x: self._keywords(schema, x["v"], x["k"], pointer, depth))

    def _keywords(self, s: dict, v: Column, k: Column, pointer: Column, depth: int) -> Column:
        out = []
        number = lambda: F.when(k == "number", F.try_variant_get(v, "$", "double"))
        text = lambda: F.when(k == "string", F.try_variant_get(v, "$", "string"))
        items = lambda: F.when(k == "array", F.try_variant_get(v, "$", "array<variant>"))
        fields = lambda: F.when(k == "object", F.try_variant_get(v, "$", "map<string, variant>"))
        add = lambda bad, keyword: out.append(_if(bad, pointer, keyword))
        if "$ref" in s:
            if depth <= 0:
                add(F.lit(True), "DEPTH")
            else:
                out.append(self.errors(self.resolve(s["$ref"]), v, pointer, depth - 1))
        if "type" in s:
            names = [s["type"]] if isinstance(s["type"], str) else s["type"]
            fits = k.isin(*names)
            if "integer" in names and "number" not in names:
                fits = fits | F.coalesce(number() == F.floor(number()), F.lit(False))
            add(~fits, "type")
        same = lambda values: F.to_json(v).isin(*[json.dumps(x, sort_keys=True, separators=(",", ":"), ensure_ascii=False) for x in values])
        if "enum" in s:
            add(~same(s["enum"]), "enum")
        if "const" in s:
            add(~same([s["const"]]), "const")
        for keyword, bad in (("minimum", lambda n, m: n < m), ("maximum", lambda n, m: n > m), ("exclusiveMinimum", lambda n, m: n <= m), ("exclusiveMaximum", lambda n, m: n >= m), ("multipleOf", lambda n, m: n / m != F.floor(n / m))):
            if keyword in s:
                add(bad(number(), F.lit(float(s[keyword]))), keyword)
        for keyword, size, bad in (
            ("minLength", lambda: F.length(text()), int.__lt__), ("maxLength", lambda: F.length(text()), int.__gt__), ("minItems", lambda: F.size(items()), int.__lt__), ("maxItems", lambda: F.size(items()), int.__gt__),
            ("minProperties", lambda: F.size(fields()), int.__lt__), ("maxProperties", lambda: F.size(fields()), int.__gt__),
        ):
            if keyword in s:
                n = size()
                of = k == ("string" if "Length" in keyword else "array" if "Items" in keyword else "object")
                add(of & (n < s[keyword] if bad is int.__lt__ else n > s[keyword]), keyword)
        if "pattern" in s:
            add(~text().rlike(s["pattern"]), "pattern")
        if s.get("uniqueItems"):
            add(F.size(F.array_distinct(F.transform(items(), lambda x: F.to_json(x)))) < F.size(items()), "uniqueItems")
        if "items" in s:
            each = F.transform(items(), lambda x, i: self.errors(s["items"], x, F.concat(pointer, F.lit("/"), i.cast("string")), depth))
            out.append(F.coalesce(F.flatten(each), _none()))
        if "required" in s:
            lost = F.filter(F.array(*map(F.lit, s["required"])), lambda n: ~F.array_contains(F.map_keys(fields()), n)) if s["required"] else F.array().cast("array<string>")
            out.append(F.coalesce(F.transform(lost, lambda n: F.struct(F.concat(pointer, F.lit("/"), n).alias("pointer"), F.lit("required").alias("keyword"))), _none()))
        named = s.get("properties", {})
        for name, inner in named.items():
            at = F.concat(pointer, F.lit("/" + name.replace("~", "~0").replace("/", "~1")))
            out.append(self._property(fields(), name, inner, at, depth))
        if "additionalProperties" in s and s["additionalProperties"] is not True:
            rest = F.map_entries(F.map_filter(fields(), lambda n, _: ~n.isin(*named) if named else F.lit(True)))
            step = lambda n: F.concat(pointer, F.lit("/"), F.replace(F.replace(n, F.lit("~"), F.lit("~0")), F.lit("/"), F.lit("~1")))
            if s["additionalProperties"] is False:
                each = F.transform(rest, lambda e: F.struct(step(e["key"]).alias("pointer"), F.lit("additionalProperties").alias("keyword")))
            else:
                each = F.flatten(F.transform(rest, lambda e: self.errors(s["additionalProperties"], e["value"], step(e["key"]), depth)))
            out.append(F.coalesce(each, _none()))
        fits = lambda inner: F.size(self.errors(inner, v, pointer, depth)) == 0
        if "oneOf" in s:
            add(reduce(Column.__add__, [fits(x).cast("int") for x in s["oneOf"]]) != 1, "oneOf")
        if "anyOf" in s:
            add(~reduce(Column.__or__, [fits(x) for x in s["anyOf"]]), "anyOf")
        if "not" in s:
            add(fits(s["not"]), "not")
        out += [self.errors(x, v, pointer, depth) for x in s.get("allOf", [])]
        return F.concat(*out) if out else _none()

    def _property(self, fields: Column, name: str, inner: dict | bool, at: Column, depth: int) -> Column:
        """Breaches of one property, if it is there; a JSON null is there."""
        return _bound(fields, lambda m: F.when(F.coalesce(F.array_contains(F.map_keys(m), name), F.lit(False)), self.errors(inner, F.try_element_at(m, F.lit(name)), at, depth)).otherwise(_none()))


def deepest(texts: DataFrame, column: str) -> int:
    """How deep the JSON texts of a column nest at most, by their brackets outside strings."""
    bare = F.regexp_replace(F.col(column), r'"(?:[^"\\]|\\.)*"', "")
    marks = F.split(F.regexp_replace(bare, r"[^\[\]{}]", ""), "")
    steps = F.transform(marks, lambda c: F.when(c.isin("[", "{"), 1).when(c.isin("]", "}"), -1).otherwise(0))
    start = F.struct(F.lit(0).alias("now"), F.lit(0).alias("most"))
    depth = F.aggregate(steps, start, lambda a, x: F.struct((a["now"] + x).alias("now"), F.greatest(a["most"], a["now"] + x).alias("most")), lambda a: a["most"])
    return texts.agg(F.max(depth)).first()[0] or 0


def breaches(schema: dict, text: Column, depth: int = 8) -> Column:
    """All breaches of a JSON text, as array of (pointer, keyword); a text that is none breaches JSON at the root. References are followed depth deep."""
    value = F.try_parse_json(text)
    root = F.lit("")
    return _bound(value, lambda v: F.when(v.isNull(), _if(F.lit(True), root, "JSON")).otherwise(Compiler(schema, depth).errors(schema, v, root, depth)))
