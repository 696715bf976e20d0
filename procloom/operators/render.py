"""Text results: conditions, BPMN XML, agendas of open questions, packages and reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from procloom.functions import columns as C

#: Operators of structured conditions and the signs that stand for them.
OPERATORS = {"GREATER_THAN_OR_EQUAL": ">=", "LESS_THAN_OR_EQUAL": "<=", "EQUALS": "==", "NOT_EQUALS": "!=", "GREATER_THAN": ">", "LESS_THAN": "<", "CONTAINS": "contains"}
#: Categories of questions and the words that put a question there; the first that fits counts.
CATEGORIES = {"流程边界": ["边界", "开始", "结束"], "角色与泳道": ["角色", "泳道", "组织"], "活动与判断": ["活动", "审批", "判断"], "输入输出": ["输入", "输出", "文档"], "规则与异常": ["规则", "条件", "例外"]}
OTHER = "其他"
#: Tags that node types are written as.
TAGS = {"START_EVENT": "startEvent", "END_EVENT": "endEvent", "MAIN_TASK": "userTask", "CONFIRMATION_TASK": "userTask", "XOR_GATEWAY": "exclusiveGateway", "OR_GATEWAY": "inclusiveGateway", "AND_GATEWAY": "parallelGateway"}


def condition_text(source: Column, operator: Column, value: Column) -> Column:
    """Text of a structured condition; the XML writer escapes it."""
    out = F.concat(source, F.lit(' == "'), value, F.lit('"'))
    for name, sign in OPERATORS.items():
        out = F.when(operator == name, F.concat(source, F.lit(f' {sign} "'), value, F.lit('"'))).otherwise(out)
    return F.when(operator == "IS_TRUE", F.concat(source, F.lit(" == true"))).when(operator == "IS_FALSE", F.concat(source, F.lit(" == false"))).otherwise(out)


def parse_condition(text: Column) -> Column:
    """struct(source_output, operator, value) of a condition's text; a text of another form is all value."""
    text = F.trim(C.xml_unescape(text))
    form = r'^(\S+)\s*(==|!=|>=|<=|>|<|contains)\s*"?([^"]*)"?$'
    source, sign, value = (F.regexp_extract(text, form, k) for k in (1, 2, 3))
    name = F.lit("EQUALS")
    for n, s in OPERATORS.items():
        name = F.when(sign == s, n).otherwise(name)
    unary = F.when((sign == "==") & (value == "true"), "IS_TRUE").when((sign == "==") & (value == "false"), "IS_FALSE")
    fits = text.rlike(form)
    return F.struct(F.when(fits, source).alias("source_output"), F.when(fits, F.coalesce(unary, name)).alias("operator"), F.when(~fits, text).when(unary.isNull(), value).alias("value"))


def question_category(text: Column) -> Column:
    low = F.lower(text)
    out = F.lit(OTHER)
    for name, words in reversed(CATEGORIES.items()):
        out = F.when(F.exists(F.array(*map(F.lit, words)), lambda w: F.contains(low, w)), name).otherwise(out)
    return out


def agenda(questions: DataFrame) -> DataFrame:
    """package_id, markdown: open questions (package_id, question_id, text, status) listed by category. A package holds the questions of one process."""
    named = questions.where("status = 'OPEN'").withColumn("category", question_category(F.col("text")))
    order = F.array_position(F.array(*map(F.lit, [*CATEGORIES, OTHER])), F.col("category"))
    item = F.concat(F.lit("- ["), F.col("question_id"), F.lit("] "), F.col("text"))
    by = named.groupBy("package_id", "category").agg(F.min(order).alias("k"), F.array_join(F.array_sort(F.collect_list(item)), "\n").alias("items"))
    part = F.struct("k", F.concat(F.lit("## "), F.col("category"), F.lit("\n"), F.col("items")).alias("t"))
    return by.groupBy("package_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(part)), lambda p: p["t"]), "\n\n").alias("markdown"))


def revision_diff(old: DataFrame, new: DataFrame) -> DataFrame:
    """package_id, question_id, change (ADDED, REMOVED, CHANGED or SAME) between two revisions (package_id, question_id, text, status, answer) of packages."""
    value = lambda p: F.struct(*[F.col(f"{p}.{c}") for c in ("text", "status", "answer")])
    both = old.alias("o").join(new.alias("n"), (F.col("o.package_id") == F.col("n.package_id")) & (F.col("o.question_id") == F.col("n.question_id")), "full_outer")
    change = F.when(F.col("o.question_id").isNull(), "ADDED").when(F.col("n.question_id").isNull(), "REMOVED").when(~value("o").eqNullSafe(value("n")), "CHANGED").otherwise("SAME")
    return both.select(*[F.coalesce(f"o.{c}", f"n.{c}").alias(c) for c in ("package_id", "question_id")], change.alias("change"))


def bpmn_xml(cards: DataFrame, lanes: DataFrame, nodes: DataFrame, flows: DataFrame) -> DataFrame:
    """g, xml: the process model of each card (g, name) with lanes (g, lane, name, pos), nodes (g, node, node_type, name, lane, pos) and flows (g, edge, src, dst, label). One process's parts make one text."""
    esc = lambda c: C.xml_escape(F.coalesce(c, F.lit("")))
    tag = F.lit("intermediateCatchEvent")
    for kind, t in TAGS.items():
        tag = F.when(F.col("node_type") == kind, t).otherwise(tag)
    tag = F.when(F.col("node_type").endswith("_THROW"), "intermediateThrowEvent").otherwise(tag)
    joined = lambda df, by, at, text, name: df.groupBy(*by).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(at, text.alias("t")))), lambda x: x["t"]), "\n").alias(name))
    held = joined(nodes, ["g", "lane"], F.struct("pos", "node"), F.concat(F.lit("        <bpmn:flowNodeRef>"), F.col("node"), F.lit("</bpmn:flowNodeRef>")), "refs")
    lane = F.concat(F.lit('      <bpmn:lane id="'), F.col("lane"), F.lit('" name="'), esc(F.col("name")), F.lit('">\n'), F.coalesce(F.concat("refs", F.lit("\n")), F.lit("")), F.lit("      </bpmn:lane>"))
    lane_text = joined(lanes.join(held, ["g", "lane"], "left"), ["g"], F.struct("pos", "lane"), lane, "lanes")
    node_text = joined(nodes, ["g"], F.struct("pos", "node"), F.concat(F.lit("    <bpmn:"), tag, F.lit(' id="'), F.col("node"), F.lit('" name="'), esc(F.col("name")), F.lit('" />')), "nodes")
    head = F.concat(F.lit('    <bpmn:sequenceFlow id="'), F.col("edge"), F.lit('" sourceRef="'), F.col("src"), F.lit('" targetRef="'), F.col("dst"), F.lit('"'))
    told = F.when(F.coalesce("label", F.lit("")) == "", F.concat(head, F.lit(" />"))).otherwise(F.concat(head, F.lit("><bpmn:conditionExpression>"), esc(F.col("label")), F.lit("</bpmn:conditionExpression></bpmn:sequenceFlow>")))
    flow_text = joined(flows, ["g"], F.col("edge"), told, "flows")
    whole = cards.join(lane_text, "g", "left").join(node_text, "g", "left").join(flow_text, "g", "left")
    lane_set = F.when(F.col("lanes").isNotNull(), F.concat(F.lit('    <bpmn:laneSet id="LaneSet_1">\n'), F.col("lanes"), F.lit("\n    </bpmn:laneSet>")))
    xml = F.concat_ws(
        "\n", F.lit('<?xml version="1.0" encoding="UTF-8"?>'), F.lit('<bpmn:definitions xmlns:bpmn="http://www.omg.org/spec/BPMN/20100524/MODEL">'),
        F.concat(F.lit('  <bpmn:process id="Process_'), F.col("g"), F.lit('" name="'), esc(F.col("name")), F.lit('" isExecutable="false">')), lane_set, F.col("nodes"), F.col("flows"), F.lit("  </bpmn:process>"), F.lit("</bpmn:definitions>"),
    )
    return whole.select("g", xml.alias("xml"))


def package_payload(html: Column) -> Column:
    """JSON text of the package that an HTML page carries in base64; null without one."""
    found = F.regexp_extract(F.coalesce(html, F.lit("")), r'id="package-payload"[^>]*>([A-Za-z0-9+/=\s]+)<', 1)
    return F.when(found != "", F.decode(F.unbase64(C.strip_space(found)), "UTF-8"))


def package_html(payload: Column) -> Column:
    return F.concat(F.lit('<!doctype html><html><body><script type="application/octet-stream" id="package-payload">'), F.base64(F.encode(payload, "UTF-8")), F.lit("</script></body></html>"))


def canonical_json(text: Column) -> Column:
    """JSON with keys in order and without spaces; null for other texts."""
    return F.to_json(F.try_parse_json(text))


def merge_report(facts: DataFrame) -> DataFrame:
    """kind, n_facts, n_conflicts, mapped: facts by kind; kinds that no draft has a place for are counted and not lost."""
    mapped = ["PROCESS_NAME", "PROCESS_LEVEL", "ACTIVITY", "ROLE", "INPUT", "OUTPUT", "TOOL", "REFERENCE", "SLA", "FLOW", "CONDITION", "GATEWAY", "START_EVENT", "END_EVENT", "CONFIRMATION_CONDITION", "COMPLETION_CRITERIA", "ORG_UNIT"]
    return facts.groupBy("kind").agg(F.count("*").alias("n_facts"), F.count_if(F.col("certainty") == "CONFLICT").alias("n_conflicts")).withColumn("mapped", F.col("kind").isin(*mapped))
