"""Inputs of the queries on facts and on Markdown: rows with the corner cases, and many more that given tables are shaped into."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from procloom.plans import models as M
from procloom.plans.registry import table

#: Columns of facts of events, as SQL that both engines take.
_K = "CAST(regexp_extract(props, '[0-9]+') AS INT)"
_FACT = f"""
    CAST(100 + floor(event_id / 1000) AS INT) AS frag_idx, CAST(event_id % 1000 AS INT) AS pos, concat('b', CAST(user_id % 7 AS STRING)) AS batch_id, concat('e', CAST(event_id AS STRING)) AS fact_id,
    CASE event_type WHEN 'view' THEN 'ACTIVITY' WHEN 'signup' THEN 'ROLE' WHEN 'purchase' THEN 'FLOW'
        WHEN 'click' THEN CASE event_id % 5 WHEN 0 THEN 'INPUT' WHEN 1 THEN 'OUTPUT' WHEN 2 THEN 'TOOL' WHEN 3 THEN 'SLA' ELSE 'CONFIRMATION_CONDITION' END
        ELSE CASE event_id % 3 WHEN 0 THEN 'END_EVENT' WHEN 1 THEN 'CONDITION' ELSE 'GATEWAY' END END AS kind,
    concat(' U.', CAST(user_id AS STRING)) AS process_key,
    CASE event_type WHEN 'view' THEN concat('a', CAST(k % 10 AS STRING)) WHEN 'signup' THEN concat('a', CAST(k % 10 AS STRING)) WHEN 'click' THEN concat('a', CAST(k % 12 AS STRING))
        WHEN 'error' THEN CASE event_id % 3 WHEN 0 THEN concat('e', CAST(k % 3 AS STRING)) WHEN 2 THEN concat('g', CAST(k % 4 AS STRING)) END END AS subject_key,
    CASE event_type WHEN 'view' THEN CASE WHEN k < 50 THEN CASE event_id % 3 WHEN 0 THEN 'Check' WHEN 1 THEN 'Check form' ELSE ' Check form again ' END ELSE concat('Do ', CAST(k AS STRING)) END
        WHEN 'signup' THEN concat('Role ', CAST(k % 5 AS STRING)) WHEN 'purchase' THEN concat('flow ', CAST(event_id AS STRING))
        WHEN 'click' THEN CASE event_id % 5 WHEN 3 THEN concat(CAST(k AS STRING), CASE WHEN k % 2 = 0 THEN '天' ELSE ' 个工作日' END) WHEN 4 THEN concat('x、 y', CAST(k AS STRING)) ELSE concat('thing ', CAST(k AS STRING)) END
        ELSE CASE event_id % 3 WHEN 0 THEN concat('Done', CAST(k % 3 AS STRING), CASE WHEN k % 2 = 0 THEN '（结束）' ELSE '' END) WHEN 1 THEN concat('if ', CAST(k AS STRING)) ELSE concat('choose ', CAST(k AS STRING)) END END AS label,
    CASE WHEN event_type = 'view' THEN concat('Role ', CAST(k % 7 AS STRING)) END AS role,
    CASE WHEN event_type = 'purchase' OR (event_type = 'error' AND event_id % 3 = 1) THEN concat('a', CAST(k % 10 AS STRING)) END AS source_key,
    CASE WHEN event_type = 'purchase' OR (event_type = 'error' AND event_id % 3 = 1 AND k % 2 = 0) THEN CASE WHEN event_id % 2 = 0 THEN concat('a', CAST((k + 1) % 10 AS STRING)) ELSE concat('e', CAST(k % 3 AS STRING)) END END AS target_key,
    CASE WHEN event_id % 17 = 0 THEN 'CONFLICT' WHEN event_id % 5 = 0 THEN 'INFERRED' ELSE 'EXPLICIT' END AS certainty"""
_REFS = "concat('B-', CAST(CAST(100 + floor(event_id / 1000) AS INT) AS STRING), CAST(event_id % 1000 AS STRING))"
FACTS_SQL = f"(SELECT * FROM {M.FACTS.sql} UNION ALL SELECT {_FACT}, [{_REFS}] AS evidence_refs FROM (SELECT *, {_K} AS k FROM events))"


def facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Facts of one process a user, with those of the models."""
    own = table(spark, sf_dir, "events").withColumn("k", F.expr(_K.replace("'[0-9]+'", "'[0-9]+', 0")))
    return M.FACTS.df(spark).unionByName(own.selectExpr(*_split(_FACT), f"array({_REFS}) AS evidence_refs"))


def _split(columns: str) -> list[str]:
    """The columns of a list, cut at commas outside parentheses."""
    out, depth, start = [], 0, 0
    for k, c in enumerate(columns + ","):
        depth += (c == "(") - (c == ")")
        if c == "," and not depth:
            out.append(columns[start:k].strip())
            start = k + 1
    return out


#: A manual for each customer, as lines that both engines put together; {n}, {k} and {name} are the nation's key, the customer's and their name.
_LINES = [
    "---", "owner: {name}", "level: L4", "---", "# CM-{n} 采购（{name}）", "intro of {name}", "", "## 一、CM-{n}.1 请购 {name}（草案） L5", "line one of {k}", "| 活动 | 角色 |", "| --- | :-: |", "| 提交 {k} | 申请人 |", "| 批准 | {name} |", "### CM-{n}.1 控制流",
    "| 来源 | 目标 |", "|---|---|", "| 提交 | 批准 |", "### CM-{n}.1 结束事件", "完成（结束）{k}", "## CM-{n}.2 付款 L5", "SOP for payment, see the 流程图", "#### skipped", "deep {k}", "## CM-1.1 of {name}", "| Code | Level |", "| CM-{n}.2 | l{n} |", "",
]


def _customer_text(line: str) -> list[str]:
    """The pieces of a line: texts, and names of columns."""
    return [p for p in re.split(r"(\{\w+\})", line) if p]


_SQL_COLUMN = {"{n}": "c_nationkey::VARCHAR", "{k}": "c_custkey::VARCHAR", "{name}": "c_name"}
#: A manual leaves out its first lines, its last, or none, by the customer's key.
_CUT = ((0, len(_LINES)), (4, len(_LINES)), (0, 18), (7, 17))


def _sql_text(lo: int, hi: int) -> str:
    return " || chr(10) || ".join("(" + " || ".join(_SQL_COLUMN.get(p) or "'" + p + "'" for p in _customer_text(line) or [""]) + ")" for line in _LINES[lo:hi])


MARKDOWN_SQL = f"(SELECT * FROM {M.MARKDOWN.sql} UNION ALL SELECT 'c' || c_custkey AS doc, CASE c_custkey % 4 " + " ".join(f"WHEN {i} THEN {_sql_text(*cut)}" for i, cut in enumerate(_CUT)) + " END AS text FROM customer)"


def manuals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc, text of a manual for each customer, with those of the models."""
    column = {"{n}": F.col("c_nationkey").cast("string"), "{k}": F.col("c_custkey").cast("string"), "{name}": F.col("c_name")}

    def text(lo: int, hi: int) -> Column:
        return F.concat_ws("\n", *[F.concat(*[column[p] if p in column else F.lit(p) for p in _customer_text(line) or [""]]) for line in _LINES[lo:hi]])

    whole = F.lit(None).cast("string")
    for i, cut in enumerate(_CUT):
        whole = F.when(F.col("c_custkey") % 4 == i, text(*cut)).otherwise(whole)
    own = table(spark, sf_dir, "customer").select(F.concat(F.lit("c"), F.col("c_custkey").cast("string")).alias("doc"), whole.alias("text"))
    return M.MARKDOWN.df(spark).unionByName(own)


#: Process models of users, as queries that both engines take; {events} is the table, and list(...), pair(a, b) and parts(...) differ by engine.
_STEPS = """SELECT concat('u', CAST(user_id AS STRING)) AS g, event_id, event_type AS t, CAST(regexp_extract(props, '[0-9]+') AS INT) AS k, user_id,
    lead(event_id) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS next, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM {events}"""
_NODE = "('N' || CAST({c} AS STRING))"
_TYPE = """CASE t WHEN 'view' THEN 'MAIN_TASK' WHEN 'click' THEN 'CONFIRMATION_TASK' WHEN 'error' THEN CASE event_id % 3 WHEN 0 THEN 'XOR_GATEWAY' WHEN 1 THEN 'AND_GATEWAY' ELSE 'OR_GATEWAY' END
    WHEN 'signup' THEN CASE WHEN event_id % 2 = 0 THEN 'INTERMEDIATE_LINK_THROW' ELSE 'INTERMEDIATE_LINK_CATCH' END
    ELSE CASE event_id % 5 WHEN 0 THEN 'START_EVENT' WHEN 1 THEN 'END_EVENT' ELSE 'MAIN_TASK' END END"""
_NAME = "CASE WHEN t = 'signup' THEN concat('L', CAST(k % 20 AS STRING)) WHEN t = 'purchase' AND event_id % 5 < 2 THEN CASE WHEN k % 4 = 0 THEN '' ELSE concat('End & ', CAST(k AS STRING)) END ELSE concat('T', CAST(k AS STRING)) END"
_ME = _NODE.format(c="event_id")
_MODELS = {
    "NODES": f"SELECT g, {_ME} AS node, {_TYPE} AS node_type, {_NAME} AS name, concat('l', CAST(k % 4 AS STRING)) AS lane, CAST(n AS INT) AS pos FROM s",
    "FLOWS": f"""SELECT g, concat('F', CAST(event_id AS STRING)) AS edge, {_ME} AS src, {_NODE.format(c='next')} AS dst, CASE k % 3 WHEN 0 THEN '' WHEN 1 THEN concat('k < ', CAST(k AS STRING)) END AS label FROM s WHERE next IS NOT NULL AND k % 10 > 0
        UNION ALL SELECT g, concat('G', CAST(event_id AS STRING)), {_ME}, {_NODE.format(c='event_id + 1')}, CASE WHEN k % 2 = 0 THEN 'else' END FROM s WHERE t = 'error'""",
    "LANES": "SELECT DISTINCT g, concat('l', CAST(k % 3 AS STRING)) AS lane, concat('Lane ', CAST(k % 3 AS STRING)) AS name, concat('r', CAST(k % 3 AS STRING)) AS role, k % 3 AS pos FROM s",
    "BINDINGS": f"SELECT g, concat('A', CAST(k AS STRING)) AS activity, {_ME} AS main_task, CASE WHEN event_id % 2 = 0 THEN {_NODE.format(c='next')} END AS confirmation_task, CAST(n AS INT) AS pos FROM s WHERE t = 'view'",
    "ACTIVITIES": f"""SELECT g, activity, name, CASE m % 3 WHEN 0 THEN 'STANDARD' WHEN 1 THEN 'DECISION_ACTIVITY' ELSE 'REVIEW_MEETING' END AS activity_type, CASE WHEN m % 2 = 0 THEN 'RASCI' ELSE 'OARP' END AS model, {_NODE.format(c='m')} AS main_task,
        CASE WHEN k % 5 = 0 THEN parts(pair(concat('emp_', CAST(k AS STRING)), 'R')) ELSE parts(pair(concat('r', CAST(k % 3 AS STRING)), CASE WHEN m % 2 = 0 THEN 'R' ELSE 'O' END), pair(concat('r', CAST((k + 1) % 3 AS STRING)), 'A')) END AS roles,
        CASE WHEN k % 4 = 0 THEN concat('r', CAST((k + 1) % 3 AS STRING)) END AS confirm_role, k % 2 = 0 AS co_completes, k % 3 > 0 AS bears, CASE WHEN k % 7 > 0 THEN k % 7 < 5 END AS no_meeting
        FROM (SELECT g, concat('A', CAST(k AS STRING)) AS activity, concat('T', CAST(k AS STRING)) AS name, k, min(event_id) AS m FROM s WHERE t = 'view' GROUP BY g, k) AS v""",
    "CARDS": f"""SELECT g, concat('User ', g) AS name, concat('L', CAST(user_id % 3 + 3 AS STRING)) AS level, user_id % 3 > 0 AS is_leaf, user_id % 2 = 0 AS parent_declared, event({_NODE.format(c='a')}, 'Begin') AS start,
        parts(event({_NODE.format(c='z')}, concat('End & ', CAST(zk AS STRING))), event('nowhere', 'Gone')) AS end_results
        FROM (SELECT g, user_id, min(event_id) AS a, max(CASE WHEN t = 'purchase' AND event_id % 5 = 1 THEN event_id END) AS z, max(CASE WHEN t = 'purchase' AND event_id % 5 = 1 THEN k END) AS zk FROM s GROUP BY g, user_id) AS v WHERE z IS NOT NULL""",
}


def _in_engine(sql: str, pair: str, event: str, parts: str) -> str:
    """sql with the three forms of one engine; each takes two names for its arguments or any number."""
    out, k = "", 0
    while k < len(sql):
        form = next((f for f in ("pair(", "event(", "parts(") if sql.startswith(f, k) and not sql[k - 1].isalnum()), None)
        if not form:
            out, k = out + sql[k], k + 1
            continue
        end, depth = k + len(form), 1
        while depth:
            depth += (sql[end] == "(") - (sql[end] == ")")
            end += 1
        inner = [_in_engine(x, pair, event, parts) for x in _split(sql[k + len(form) : end - 1])]
        out += parts.format(", ".join(inner)) if form == "parts(" else (pair if form == "pair(" else event).format(*inner)
        k = end
    return out


def model_sql(name: str) -> str:
    """Rows of a model's part for DuckDB: those of the fixture, and those of all users."""
    body = _in_engine(_MODELS[name], "{{'role': {}, 'code': {}}}", "{{'event_id': {}, 'name': {}}}", "[{}]")
    return f"(SELECT * FROM {getattr(M, name).sql} UNION ALL BY NAME SELECT * FROM (WITH s AS ({_STEPS.format(events='events')}) {body}) AS v)"


def model(name: str, spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same for Spark."""
    body = _in_engine(_MODELS[name], "named_struct('role', {}, 'code', {})", "named_struct('event_id', {}, 'name', {})", "array({})")
    steps = _STEPS.format(events="{events}").replace("'[0-9]+')", "'[0-9]+', 0)")
    s = spark.sql(steps, events=table(spark, sf_dir, "events"))
    fixture = getattr(M, name).df(spark)
    own = spark.sql(re.sub(r"\bFROM s\b", "FROM {s}", body), s=s)
    return fixture.unionByName(own.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in fixture.schema]))
