"""Deterministic review rules. Each gives rows (rule_id, g, target) for what breaks it; many processes are checked at once."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from procloom import workers
from procloom.functions import columns as C
from procloom.operators import graph, names

#: Node types that must have a flow; gateways are checked otherwise.
CHECKED_TYPES = [
    "MAIN_TASK", "CONFIRMATION_TASK", "START_EVENT", "END_EVENT",
    "INTERMEDIATE_MESSAGE_CATCH", "INTERMEDIATE_MESSAGE_THROW",
    "INTERMEDIATE_TIMER_CATCH", "INTERMEDIATE_LINK_CATCH", "INTERMEDIATE_LINK_THROW",
]


def finding(df: DataFrame, rule: str, target: str = "target") -> DataFrame:
    return df.select(F.lit(rule).alias("rule_id"), F.col("g"), F.col(target).alias("target"))


def union(*found: DataFrame) -> DataFrame:
    out = found[0]
    for df in found[1:]:
        out = out.unionByName(df)
    return out


def architecture_rules(nodes: DataFrame) -> DataFrame:
    """Several values in a dimension of an L4, orphans, technical names of L6, SOPs without L6. nodes: g, node, type, name, parent_id, departments, systems, timeframes, locations, l6_references."""
    several = F.exists(F.array("departments", "systems", "timeframes", "locations"), lambda v: F.size(v) > 1)
    known = nodes.select("g", F.col("node").alias("parent_id"))
    orphan = nodes.where("type <> 'L3'").join(known, ["g", "parent_id"], "left_anti")
    return union(
        finding(nodes.where((F.col("type") == "L4") & several), "FA-L4-001", "node"),
        finding(orphan, "FA-HIER-001", "node"),
        finding(nodes.where((F.col("type") == "L6") & C.looks_technical(F.col("name"))), "FA-L6-004", "node"),
        finding(nodes.where((F.col("type") == "SOP") & (F.coalesce(F.size("l6_references"), F.lit(0)) <= 0)), "FA-SOP-004", "node"),
    )


def bpmn_rules(nodes: DataFrame, flows: DataFrame) -> DataFrame:
    """Isolated nodes, AND splits in a process without an AND join and the other way round, and splits with unconditioned flows. nodes: g, node, node_type; flows: g, edge, src, dst, label."""
    edges = flows.select("g", "src", "dst")
    alone = graph.isolated(nodes.where(F.col("node_type").isin(*CHECKED_TYPES)), edges)
    both = graph.degrees(nodes, edges).join(nodes.select("g", "node", "node_type"), ["g", "node"])
    ands = both.where("node_type = 'AND_GATEWAY'").withColumn("split", F.col("n_out") > 1).withColumn("join", F.col("n_in") > 1)
    every = Window.partitionBy("g")
    # another gateway has to be the counterpart
    ands = ands.withColumn("joins", F.sum(F.col("join").cast("int")).over(every) - F.col("join").cast("int")).withColumn("splits", F.sum(F.col("split").cast("int")).over(every) - F.col("split").cast("int"))
    unpaired = ands.where("(split and joins = 0) or (join and splits = 0)")
    return union(finding(alone, "FA-BPMN-007", "node"), finding(unpaired, "FA-BPMN-004", "node"), finding(unconditioned(nodes, flows), "FA-BPMN-005", "node"))


def unconditioned(nodes: DataFrame, flows: DataFrame) -> DataFrame:
    """XOR and OR gateways with several flows out of which one has no condition."""
    out = flows.groupBy("g", F.col("src").alias("node")).agg(F.count("*").alias("n"), F.bool_and(F.coalesce(F.trim("label") != "", F.lit(False))).alias("all_told"))
    return nodes.where("node_type in ('XOR_GATEWAY', 'OR_GATEWAY')").join(out, ["g", "node"]).where("n > 1 and not all_told")


def name_matches(left: DataFrame, right: DataFrame) -> DataFrame:
    """g, node, element of each node of left (g, node, name) that matches an element of right (g, element, name, pos) by name; the first element in order counts.

    Names are composed first, so that one letter is written in one way. Only names of one process meet: the join is on g, whose size a diagram bounds."""
    workers.ship(left.sparkSession)
    a = left.select("g", "node", names.compose(F.col("name")).alias("name")).select("g", "node", C.normal_name(F.col("name")).alias("a"))
    b = right.select("g", "element", "pos", names.compose(F.col("name")).alias("name")).select("g", "element", "pos", C.normal_name(F.col("name")).alias("b"))
    pairs = a.join(b, "g").where(C.names_match(F.col("a"), F.col("b")))
    return pairs.groupBy("g", "node").agg(F.min_by("element", F.struct("pos", "element")).alias("element"))


def consistency_rules(architecture: DataFrame, elements: DataFrame) -> DataFrame:
    """Nodes of an architecture (g, node, type, name, parent_id) missing in the diagram, elements (g, element, type, name, pos) missing in the architecture.

    An L4 counts only if the diagram has sub-processes or pools, an L5 only if its parent exists."""
    deep = elements.where("type in ('SUB_PROCESS', 'POOL')").select("g").distinct()
    l4 = architecture.where("type = 'L4'").join(deep, "g", "left_semi")
    parents = architecture.select("g", F.col("node").alias("parent_id"))
    l5 = architecture.where("type = 'L5'").join(parents, ["g", "parent_id"], "left_semi")
    wanted = l4.unionByName(l5)
    named = elements.where("type in ('TASK', 'SUB_PROCESS', 'POOL')")
    found = name_matches(wanted.select("g", "node", "name"), named)
    missing = wanted.join(found, ["g", "node"], "left_anti")
    extra = named.where("type = 'TASK'").join(found.select("g", "element"), ["g", "element"], "left_anti")
    return union(finding(missing.where("type = 'L4'"), "FA-CONS-001", "node"), finding(missing.where("type = 'L5'"), "FA-CONS-002", "node"), finding(extra, "FA-CONS-008", "element"))


def lane_role_conflicts(architecture: DataFrame, elements: DataFrame, lanes: DataFrame) -> DataFrame:
    """Lanes (g, lane, name) whose name is none of the roles of the matched nodes (g, node, name, roles) that stand in them (elements: g, element, name, pos, lane)."""
    found = name_matches(architecture.select("g", "node", "name"), elements)
    told = found.join(elements.select("g", "element", "lane"), ["g", "element"]).join(architecture.select("g", "node", "roles"), ["g", "node"]).join(lanes.select("g", "lane", F.col("name").alias("lane_name")), ["g", "lane"])
    fits = F.exists("roles", lambda r: C.names_match(C.normal_name(r), C.normal_name(F.col("lane_name"))))
    return finding(told.where((F.size("roles") > 0) & ~fits).select("g", "lane").distinct(), "FA-CONS-003", "lane")


# --- Activities and their diagrams: activities (g, activity, activity_type, model, main_task, roles, confirmation), bindings (g, activity, main_task, confirmation_task), nodes, lanes (g, lane, role)


def accountable() -> F.Column:
    """The first role that is responsible (R) or owner (O), by the model of the activity."""
    code = F.when(F.col("model") == "RASCI", "R").when(F.col("model") == "OARP", "O")
    return F.get(F.filter("roles", lambda r: r["code"] == code), F.lit(0))["role"]


def first_binding(bindings: DataFrame) -> DataFrame:
    return bindings.groupBy("g", "activity").agg(F.min_by(F.struct("main_task", "confirmation_task"), "pos").alias("b"), F.count("*").alias("n_bindings"), F.countDistinct("main_task").alias("n_main")).select("g", "activity", "b.*", "n_bindings", "n_main")


def first_lane(lanes: DataFrame) -> DataFrame:
    return lanes.groupBy("g", "role").agg(F.min_by("lane", "pos").alias("role_lane"))


def activity_findings(activities: DataFrame, bindings: DataFrame, nodes: DataFrame, flows: DataFrame, lanes: DataFrame) -> DataFrame:
    """Rules on how activities stand in the diagram: FA-ACT-BPMN-001 to 006 and 009, one finding for each rule and activity or gateway."""
    bound = first_binding(bindings).withColumnRenamed("main_task", "bound_task")
    kinds = nodes.select("g", F.col("node").alias("bound_task"), F.col("node_type").alias("task_type"), F.col("lane").alias("task_lane"), F.col("name").alias("task_name"))
    confirming = nodes.select("g", F.col("node").alias("confirmation_task"), F.col("node_type").alias("confirm_type"), F.col("lane").alias("confirm_at"))
    role_lane = first_lane(lanes)
    told = activities.join(bound, ["g", "activity"], "left").join(kinds, ["g", "bound_task"], "left").join(confirming, ["g", "confirmation_task"], "left").withColumn("role", accountable())
    told = told.join(role_lane, ["g", "role"], "left").join(role_lane.select("g", F.col("role").alias("confirm_role"), F.col("role_lane").alias("confirm_lane")), ["g", "confirm_role"], "left")
    direct = flows.select("g", F.col("src").alias("bound_task"), F.col("dst").alias("confirmation_task")).distinct().withColumn("direct", F.lit(True))
    told = told.join(direct, ["g", "bound_task", "confirmation_task"], "left")
    has = F.col("confirm_role").isNotNull()
    personal = F.exists("roles", lambda r: C.personal_role(r["role"]))
    one = (F.coalesce("n_bindings", F.lit(0)) != 1) | F.col("task_type").isNull() | (F.col("task_type") != "MAIN_TASK") | (F.col("bound_task") != F.col("main_task")) | (F.coalesce("task_name", F.lit("")) != F.col("name"))
    wrong_lane = F.col("task_type").isNotNull() & F.col("role").isNotNull() & ~F.col("task_lane").eqNullSafe(F.col("role_lane"))
    formal = F.col("activity_type").isin("REVIEW_MEETING", "DECISION_ACTIVITY")
    bad = (
        ~F.coalesce("co_completes", F.lit(False)) | ~F.coalesce("bears", F.lit(False)) | ~F.coalesce("no_meeting", F.lit(False)) | F.col("confirm_lane").isNull() | (F.col("confirm_role") == F.coalesce("role", F.lit("")))
        | F.col("confirmation_task").isNull() | F.coalesce(F.col("confirm_type") != "CONFIRMATION_TASK", F.lit(True)) | ~F.col("confirm_at").eqNullSafe(F.col("confirm_lane")) | F.col("confirm_at").eqNullSafe(F.col("task_lane")) | F.col("direct").isNull()
    )
    several = F.coalesce("n_main", F.lit(0)) > 1
    return union(
        finding(told.where(personal), "FA-ACT-BPMN-001", "activity"), finding(told.where(one), "FA-ACT-BPMN-002", "activity"), finding(told.where(wrong_lane), "FA-ACT-BPMN-003", "activity"),
        finding(told.where(has & bad & ~formal), "FA-ACT-BPMN-004", "activity"), finding(told.where(formal & (has | F.col("confirmation_task").isNotNull())), "FA-ACT-BPMN-005", "activity"),
        finding(unconditioned(nodes, flows), "FA-ACT-BPMN-006", "node"), finding(told.where(several), "FA-ACT-BPMN-009", "activity"),
    )


def structure_findings(activities: DataFrame, bindings: DataFrame, nodes: DataFrame, flows: DataFrame) -> DataFrame:
    """The parts of FA-ACT-BPMN-002, 004 and 009 that start from the diagram, each target once.

    002: main tasks that no binding of a known activity names. 004: activities without a declared confirmation whose binding has a confirmation task, and confirmation
    tasks in no binding, as the activity whose main task alone leads to them, or by themselves. 009: activities with several confirmation tasks, bound or behind
    their main tasks, and activities whose main and confirmation task are two branches of one AND gateway."""
    edges = flows.select("g", "src", "dst").distinct()
    kind = lambda t, name: nodes.where(F.col("node_type") == t).select("g", F.col("node").alias(name))
    known = activities.select("g", "activity")
    mains = bindings.where("main_task is not null").select("g", "activity", "main_task").distinct()
    own = mains.join(known, ["g", "activity"], "left_semi").select("g", F.col("main_task").alias("target"))
    unnamed = kind("MAIN_TASK", "target").join(own, ["g", "target"], "left_anti")
    formal = F.col("activity_type").isin("REVIEW_MEETING", "DECISION_ACTIVITY")
    bound = bindings.where("confirmation_task is not null").select("g", "activity", "confirmation_task").distinct()
    undeclared = activities.where(F.col("confirm_role").isNull() & ~formal).join(first_binding(bindings).where("confirmation_task is not null").select("g", "activity"), ["g", "activity"], "left_semi").select("g", F.col("activity").alias("target"))
    behind = mains.join(edges.withColumnRenamed("src", "main_task"), ["g", "main_task"]).join(kind("CONFIRMATION_TASK", "dst"), ["g", "dst"]).select("g", "activity", F.col("dst").alias("confirmation_task"))
    left = kind("CONFIRMATION_TASK", "confirmation_task").join(bound, ["g", "confirmation_task"], "left_anti")
    led = left.join(behind, ["g", "confirmation_task"], "left").groupBy("g", "confirmation_task").agg(F.countDistinct("activity").alias("n"), F.min("activity").alias("activity"))
    single = led.where("n = 1").join(known, ["g", "activity"], "left_semi").select("g", F.col("activity").alias("target"))
    alone = led.where("n <> 1").select("g", F.col("confirmation_task").alias("target"))
    confirming = bound.unionByName(behind).distinct()
    several = confirming.groupBy("g", F.col("activity").alias("target")).agg(F.count("*").alias("n")).where("n > 1").select("g", "target")
    branches = edges.join(kind("AND_GATEWAY", "src"), ["g", "src"])
    parallel = mains.join(confirming, ["g", "activity"]).join(branches.select("g", "src", F.col("dst").alias("main_task")), ["g", "main_task"]).join(branches.select("g", "src", F.col("dst").alias("confirmation_task")), ["g", "src", "confirmation_task"]).select("g", F.col("activity").alias("target"))
    return union(
        finding(unnamed, "FA-ACT-BPMN-002"), finding(undeclared.unionByName(single).unionByName(alone).distinct(), "FA-ACT-BPMN-004"), finding(several.unionByName(parallel).distinct(), "FA-ACT-BPMN-009"),
    )


#: Kinds of elements of the older diagram model that must have a flow, and what a review of activities needs.
OLD_TYPES = ["TASK", "SUB_PROCESS", "EVENT"]
REVIEW_INPUTS = ["process_card", "activities", "diagram_model"]


def isolated_elements(elements: DataFrame, flows: DataFrame) -> DataFrame:
    """FA-BPMN-007 for the older diagram model: elements (g, element, type) that no flow (g, src, dst) touches."""
    wanted = elements.where(F.col("type").isin(*OLD_TYPES)).select("g", F.col("element").alias("node"))
    return finding(graph.isolated(wanted, flows.select("g", "src", "dst")), "FA-BPMN-007", "node")


def visual_status(flows: DataFrame) -> DataFrame:
    """g, n_flows, status of diagrams by their flows (g, points): crossings are only judged from two flows with geometry on."""
    told = flows.groupBy("g").agg(F.count_if(F.coalesce(F.size("points"), F.lit(0)) >= 2).alias("n_flows"))
    return told.withColumn("status", F.when(F.col("n_flows") < 2, "INSUFFICIENT_EVIDENCE").otherwise("SUCCEEDED"))


def stage_status(inputs: DataFrame) -> DataFrame:
    """run_id, status, missing of runs (run_id, and whether each of REVIEW_INPUTS is there): NEEDS_INPUT if any is missing."""
    missing = F.filter(F.array(*[F.when(~F.coalesce(F.col(c), F.lit(False)), F.lit(c)) for c in REVIEW_INPUTS]), lambda x: x.isNotNull())
    return inputs.select("run_id", F.when(F.size(missing) > 0, "NEEDS_INPUT").otherwise("SUCCEEDED").alias("status"), missing.alias("missing"))


def end_events(cards: DataFrame, nodes: DataFrame) -> DataFrame:
    """FA-ACT-BPMN-007: g, target, problem of end events (nodes) against declared results (cards: g, end_results array of event_id, name)."""
    ends = nodes.where("node_type = 'END_EVENT'").select("g", F.col("node").alias("target"), F.coalesce("name", F.lit("")).alias("name"))
    declared = cards.select("g", F.explode("end_results").alias("e")).select("g", F.col("e.event_id").alias("target"), F.col("e.name").alias("declared"))
    both = ends.join(declared, ["g", "target"], "full_outer")
    problem = F.when(F.col("name").isNull(), "MISSING").when(F.trim("name") == "", "EMPTY_NAME").when(F.col("declared").isNull(), "UNDECLARED").when(F.col("name") != F.col("declared"), "MISMATCH")
    return both.withColumn("problem", problem).where("problem is not null").select("g", "target", "problem")


def link_pairs(nodes: DataFrame, flows: DataFrame) -> DataFrame:
    """FA-ACT-BPMN-008: g, name, problem of link events that throw and catch: both must be there, once the catch, and flows must enter throws and leave catches."""
    links = nodes.where("node_type in ('INTERMEDIATE_LINK_THROW', 'INTERMEDIATE_LINK_CATCH')")
    degree = graph.degrees(links, flows.select("g", "src", "dst"))
    told = links.join(degree.select("g", "node", "n_in", "n_out"), ["g", "node"]).withColumn("throws", F.col("node_type") == "INTERMEDIATE_LINK_THROW")
    turned = F.when(F.col("throws"), (F.col("n_out") > 0) | (F.col("n_in") == 0)).otherwise((F.col("n_in") > 0) | (F.col("n_out") == 0))
    by = told.groupBy("g", F.coalesce(F.trim("name"), F.lit("")).alias("name")).agg(F.count_if("throws").alias("n_throw"), F.count_if(~F.col("throws")).alias("n_catch"), F.bool_or(turned).alias("turned"))
    problem = F.when(F.col("n_throw") == 0, "NO_THROW").when(F.col("n_catch") == 0, "NO_CATCH").when(F.col("n_catch") > 1, "MANY_CATCHES").when(F.col("turned"), "DIRECTION")
    return by.withColumn("problem", problem).where("problem is not null").select("g", "name", "problem")


def draft_gates(cards: DataFrame, activities: DataFrame, bindings: DataFrame, nodes: DataFrame, flows: DataFrame, lanes: DataFrame) -> DataFrame:
    """Gates that a draft must pass: rule_id, g, target, one row for each breach. A process without rows is valid."""
    leaf = F.col("is_leaf") & F.col("level").isin("L4", "L5")
    gate: Callable[[DataFrame, str, str], DataFrame] = lambda df, code, target: finding(df, f"FA-DRAFT-{code}", target)
    self = cards.withColumn("self", F.col("g"))
    inner = self.where(~leaf)
    drawn = nodes.select("g").unionByName(flows.select("g")).unionByName(bindings.select("g")).distinct()
    repeated = lambda c: lanes.groupBy("g", F.col(c).alias("target")).agg(F.count("*").alias("n")).where("n > 1")
    model = F.when(F.col("activity_type") == "STANDARD", "RASCI").when(F.col("activity_type").isin("REVIEW_MEETING", "DECISION_ACTIVITY"), "OARP")
    code = F.when(F.col("model") == "RASCI", "R").when(F.col("model") == "OARP", "O")
    accountables = F.size(F.filter("roles", lambda r: r["code"] == code))
    twice = activities.select("g", "activity", F.explode("roles").alias("r")).groupBy("g", "activity", "r.role").agg(F.countDistinct("r.code").alias("n")).where("n > 1").select("g", "activity")
    bound = first_binding(bindings).withColumnRenamed("main_task", "bound_task")
    node = lambda key, prefix: nodes.select("g", F.col("node").alias(key), F.col("node_type").alias(f"{prefix}_type"), F.col("lane").alias(f"{prefix}_lane"))
    told = activities.join(bound, ["g", "activity"], "left").join(node("bound_task", "task"), ["g", "bound_task"], "left").join(node("confirmation_task", "confirm"), ["g", "confirmation_task"], "left").withColumn("role", accountable())
    role_lane = first_lane(lanes)
    told = told.join(role_lane, ["g", "role"], "left").join(role_lane.select("g", F.col("role").alias("confirm_role"), F.col("role_lane").alias("confirm_role_lane")), ["g", "confirm_role"], "left")
    has, given = F.col("confirm_role").isNotNull(), F.col("confirmation_task").isNotNull()
    formal = F.col("activity_type").isin("REVIEW_MEETING", "DECISION_ACTIVITY")
    complete = F.col("co_completes") & F.col("bears") & F.col("no_meeting")
    known = activities.select("g", "activity")
    backward = bindings.join(node("main_task", "task"), ["g", "main_task"], "left")
    mains = nodes.where("node_type = 'MAIN_TASK'").select("g", "node").join(bindings.groupBy("g", F.col("main_task").alias("node")).agg(F.count("*").alias("n")), ["g", "node"], "left").na.fill(0, ["n"])
    starts = nodes.where("node_type = 'START_EVENT'").groupBy("g").agg(F.count("*").alias("n_start"), F.min(F.struct("node", "name")).alias("s"))
    leaves = self.where(leaf).join(starts, "g", "left").na.fill(0, ["n_start"])
    ends = nodes.where("node_type = 'END_EVENT'").groupBy("g").agg(F.array_sort(F.collect_list(F.struct(F.col("node").alias("event_id"), "name"))).alias("ends"))
    ended = self.where(leaf).join(ends, "g", "left")
    confirmed = told.where(has & given & F.col("confirm_type").isNotNull())
    return union(
        gate(self.where("parent_declared = false"), "CARD-001", "self"),
        gate(inner.join(activities.select("g").distinct(), "g", "left_semi"), "LEAF-001", "self"), gate(inner.join(drawn, "g", "left_semi"), "LEAF-001", "self"),
        gate(repeated("lane"), "LANE-003", "target"), gate(repeated("role"), "LANE-003", "target"),
        gate(activities.where(F.col("model") != model), "MODEL-001", "activity"),
        gate(activities.where(accountables != 1), "ROLE-001", "activity"), gate(twice, "ROLE-002", "activity"),
        gate(told.where("n_bindings is null or n_bindings > 1"), "BIND-001", "activity"),
        gate(told.where("bound_task <> main_task"), "BIND-002", "activity"), gate(told.where("task_type <> 'MAIN_TASK'"), "BIND-002", "bound_task"),
        gate(bindings.join(known, ["g", "activity"], "left_anti"), "BIND-002", "activity"), gate(backward.where("task_type is null or task_type <> 'MAIN_TASK'"), "BIND-002", "main_task"),
        gate(told.where(has & ~F.coalesce(complete, F.lit(False))), "CONFIRM-001", "activity"), gate(told.where((has & ~given) | (~has & given)), "CONFIRM-002", "activity"),
        gate(told.where(has & given & F.coalesce(F.col("confirm_type") != "CONFIRMATION_TASK", F.lit(True))), "CONFIRM-002", "confirmation_task"), gate(told.where(formal & (has | given)), "CONFIRM-003", "activity"),
        gate(told.where(F.col("role").isNotNull() & F.col("task_type").isNotNull() & ~F.col("task_lane").eqNullSafe(F.col("role_lane"))), "LANE-001", "activity"),
        gate(confirmed.where("confirm_role_lane is null or confirm_lane <> confirm_role_lane"), "LANE-002", "activity"), gate(confirmed.where("confirm_role_lane is not null and task_lane = confirm_lane"), "LANE-002", "activity"),
        gate(bound.where("n_main > 1"), "PARALLEL-001", "activity"), gate(mains.where("n = 0"), "BINDING-001", "node"), gate(mains.where("n > 1"), "BINDING-002", "node"),
        gate(leaves.where("n_start <> 1"), "CARD-002", "self"), gate(leaves.where((F.col("n_start") == 1) & ~(F.col("start.event_id").eqNullSafe(F.col("s.node")) & F.col("start.name").eqNullSafe(F.col("s.name")))), "CARD-004", "self"),
        gate(ended.where("ends is null"), "CARD-003", "self"), gate(ended.where(F.col("ends").isNotNull() & ~F.array_sort("end_results").eqNullSafe(F.col("ends"))), "CARD-005", "self"),
    )
