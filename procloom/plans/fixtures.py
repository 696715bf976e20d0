"""Small inline tables: one definition gives a Spark DataFrame and the SQL text of the same rows."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

_DUCK = {"string": "VARCHAR", "int": "INTEGER", "bigint": "BIGINT", "double": "DOUBLE", "boolean": "BOOLEAN"}


def _fields(text: str, mark: str) -> list[tuple[str, str]]:
    """(name, type) of a list of columns or struct fields; commas inside <> don't part them."""
    out, depth, start = [], 0, 0
    for k, c in enumerate(text + ","):
        depth += (c == "<") - (c == ">")
        if c == "," and not depth:
            name, _, kind = text[start:k].strip().partition(mark)
            out.append((name.strip(), kind.strip()))
            start = k + 1
    return out


def _inner(kind: str) -> str:
    return kind[kind.index("<") + 1 : -1]


def _duck_type(kind: str) -> str:
    if kind.startswith("array"):
        return f"{_duck_type(_inner(kind))}[]"
    if kind.startswith("struct"):
        return f"STRUCT({', '.join(f'{n} {_duck_type(t)}' for n, t in _fields(_inner(kind), ':'))})"
    return _DUCK[kind]


def _literal(v: object, kind: str) -> str:
    if v is None:
        return "NULL"
    if kind.startswith("array"):
        return f"[{', '.join(_literal(x, _inner(kind)) for x in v)}]"
    if kind.startswith("struct"):
        return "{" + ", ".join(f"'{n}': {_literal(x, t)}" for (n, t), x in zip(_fields(_inner(kind), ":"), v)) + "}"
    if kind == "string":
        text = str(v).replace("'", "''")
        return "'" + "' || chr(10) || '".join(text.split("\n")) + "'" if "\n" in text else f"'{text}'"
    return str(v).lower() if isinstance(v, bool) else str(v)


@dataclass(frozen=True)
class Fixture:
    schema: str
    rows: Sequence[tuple]

    def df(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame(list(self.rows), self.schema)

    @property
    def sql(self) -> str:
        """A parenthesised query with the rows."""
        fields = _fields(self.schema, " ")
        rows = ", ".join("(" + ", ".join(f"CAST({_literal(v, t)} AS {_duck_type(t)})" for v, (_, t) in zip(r, fields)) + ")" for r in self.rows)
        return f"(SELECT * FROM (VALUES {rows}) AS v({', '.join(n for n, _ in fields)}))"
