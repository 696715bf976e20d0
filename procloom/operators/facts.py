"""Merging of extracted facts into processes: grouping, deduplication, activity aggregates, lanes and flows.

Where an input order decides, the order is (frag_idx, pos) of the facts, which every function takes as columns.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from procloom.functions import columns as C

#: Kinds of facts with one instance for each subject.
SINGLE_KINDS = ("ACTIVITY", "PROCESS_NAME", "PROCESS_LEVEL")
#: Kinds that describe an activity, and the field that each fills.
SIBLING_FIELDS = {"INPUT": "inputs", "OUTPUT": "outputs", "TOOL": "tools", "REFERENCE": "references", "COMPLETION_CRITERIA": "completion_criteria"}


def process_groups(facts: DataFrame) -> DataFrame:
    """process, display_code, n_facts, n_conflicts of each process."""
    return facts.groupBy(C.machine_key(F.col("process_key")).alias("process")).agg(
        F.min(F.trim("process_key")).alias("display_code"), F.count("*").alias("n_facts"), F.count_if(F.col("certainty") == "CONFLICT").alias("n_conflicts")
    )


def representative_label(labels: Column) -> Column:
    """struct(label, conflict) of an array of distinct labels: the longest if each begins with the one before it by length, else the least, in conflict."""
    by_length = F.array_sort(labels, lambda a, b: F.when(F.length(a) != F.length(b), F.length(a) - F.length(b)).when(a < b, -1).when(a > b, 1).otherwise(0))
    n = F.size(labels)
    pairs = F.zip_with(F.slice(by_length, 1, F.greatest(n - 1, F.lit(0))), F.slice(by_length, 2, F.greatest(n - 1, F.lit(0))), lambda a, b: b.startswith(a))
    chain = F.forall(pairs, lambda x: x)
    return (
        F.when(n == 0, F.struct(F.lit("").alias("label"), F.lit(False).alias("conflict")))
        .when(chain, F.struct(F.element_at(by_length, -1).alias("label"), F.lit(False).alias("conflict")))
        .otherwise(F.struct(F.array_min(labels).alias("label"), F.lit(True).alias("conflict")))
    )


_KEY = ["kind", "process", "subject_key", "single", "label_key"]


def _keyed(facts: DataFrame) -> DataFrame:
    """Kinds of one instance are keyed by their subject, others by their label, too. The process key is the machine key, so spellings of one code meet."""
    single = F.col("kind").isin(*SINGLE_KINDS) & F.col("subject_key").isNotNull()
    return facts.withColumn("process", C.machine_key(F.col("process_key"))).withColumn("single", single).withColumn("label_key", F.when(single, F.lit(None)).otherwise(F.col("label")))


def fact_evidence(facts: DataFrame) -> DataFrame:
    """kind, process, subject_key, single, label_key, ref: what the instances of each merged fact refer to, a row each, for facts of any number of instances."""
    return _keyed(facts).select(*_KEY, F.explode("evidence_refs").alias("ref")).distinct()


def dedup_facts(facts: DataFrame, refs: bool = True) -> DataFrame:
    """One row a fact: kind, process, subject_key, label, fact_id, batch_id, evidence_refs, n_merged, conflict. Without refs, evidence_refs is empty (see fact_evidence)."""
    keyed, key = _keyed(facts), _KEY
    if not refs:
        keyed = keyed.withColumn("evidence_refs", F.array().cast("array<string>"))
    # first by label, so that what meets for a fact grows with its labels and not with its instances
    by_label = keyed.groupBy(*key, F.trim(F.coalesce("label", F.lit(""))).alias("clean")).agg(
        F.min(F.struct("batch_id", "fact_id", "label")).alias("first"), F.count("*").alias("n"), F.array_distinct(F.flatten(F.collect_set(F.coalesce("evidence_refs", F.array().cast("array<string>"))))).alias("refs")
    )
    groups = by_label.groupBy(*key).agg(
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("refs")))).alias("evidence_refs"), F.array_sort(F.collect_list(F.struct("first.batch_id", "first.fact_id", "first.label", "clean"))).alias("many"), F.sum("n").alias("n_merged")
    )
    labels = F.filter(F.transform("many", lambda m: m["clean"]), lambda t: t != "")
    groups = groups.withColumn("best", representative_label(labels))
    holders = F.filter("many", lambda m: m["clean"] == F.col("best.label"))
    chosen = F.when(F.col("single") & (F.col("n_merged") > 1) & (F.size(holders) > 0), F.get(holders, F.lit(0))).otherwise(F.get("many", F.lit(0)))
    merged = F.col("single") & (F.col("n_merged") > 1)
    return groups.withColumn("rep", chosen).select(
        "kind", "process", "subject_key", F.when(merged, F.col("best.label")).otherwise(F.col("rep.label")).alias("label"),
        F.col("rep.fact_id").alias("fact_id"), F.col("rep.batch_id").alias("batch_id"), "evidence_refs", "n_merged", (merged & F.col("best.conflict")).alias("conflict"),
    )


def _ordered_distinct(value: Column, keep: Column) -> Column:
    items = F.array_sort(F.collect_list(F.when(keep, F.struct("frag_idx", "pos", value.alias("v")))))
    return F.array_distinct(F.transform(items, lambda x: x["v"]))


def activity_aggregates(facts: DataFrame) -> DataFrame:
    """process, subject_key, name, role, inputs, outputs, tools, references, completion_criteria, sla of each activity, from the sibling facts with its subject.

    The last role counts; lists keep first appearances; the first duration that can be read is the SLA. Facts in conflict are left out."""
    keyed = facts.where("certainty <> 'CONFLICT'").withColumn("process", C.machine_key(F.col("process_key")))
    activities = keyed.where("kind = 'ACTIVITY' and subject_key is not null").groupBy("process", "subject_key").agg(
        F.max_by(F.struct("label", "role"), F.struct("frag_idx", "pos")).alias("own")
    )
    kind = F.col("kind")
    sla = C.parse_sla(F.col("label"))
    order = F.struct("frag_idx", "pos")
    siblings = keyed.where(kind.isin("ROLE", "SLA", "CONFIRMATION_CONDITION", *SIBLING_FIELDS)).groupBy("process", "subject_key").agg(
        F.max_by("label", F.when(kind == "ROLE", order)).alias("role_fact"),
        F.min_by(sla, F.when((kind == "SLA") & sla.isNotNull(), order)).alias("sla"),
        *[_ordered_distinct(F.col("label"), kind == k).alias(f) for k, f in SIBLING_FIELDS.items() if k != "COMPLETION_CRITERIA"],
        F.array_sort(F.collect_list(F.when(kind.isin("COMPLETION_CRITERIA", "CONFIRMATION_CONDITION"), F.struct("frag_idx", "pos", "kind", "label")))).alias("criteria"),
    )
    parts = F.flatten(F.transform("criteria", lambda c: F.when(c["kind"] == "COMPLETION_CRITERIA", F.array(c["label"])).otherwise(F.filter(F.transform(F.split(c["label"], "[、,，]"), lambda v: F.trim(v)), lambda t: t != ""))))
    none = F.array().cast("array<string>")
    joined = activities.join(siblings, ["process", "subject_key"], "left")
    return joined.select(
        "process", "subject_key", F.col("own.label").alias("name"), F.coalesce("role_fact", "own.role").alias("role"),
        *[F.coalesce(f, none).alias(f) for k, f in SIBLING_FIELDS.items() if k != "COMPLETION_CRITERIA"],
        F.coalesce(F.array_distinct(parts), none).alias("completion_criteria"), F.col("sla.value").alias("sla_value"), F.col("sla.unit").alias("sla_unit"),
    )


def process_io(facts: DataFrame) -> DataFrame:
    """process, kind, label, first of INPUT and OUTPUT facts that belong to no activity."""
    keyed = facts.where("certainty <> 'CONFLICT'").withColumn("process", C.machine_key(F.col("process_key")))
    activities = keyed.where("kind = 'ACTIVITY' and subject_key is not null").select("process", "subject_key").distinct()
    own = keyed.where("kind in ('INPUT', 'OUTPUT')").join(activities, ["process", "subject_key"], "left_anti")
    return own.groupBy("process", "kind", "label").agg(F.count("*").alias("n"))


def lanes(facts: DataFrame) -> DataFrame:
    """process, lane_id, name, pos: one lane for each role name but for white space; the first spelling counts."""
    roles = facts.where("kind = 'ROLE' and certainty <> 'CONFLICT'").withColumn("process", C.machine_key(F.col("process_key")))
    first = roles.groupBy("process", C.strip_space(F.col("label")).alias("norm")).agg(F.min(F.struct("frag_idx", "pos", "label")).alias("first"))
    return first.select("process", "norm", C.prefixed_id("Lane", F.col("first.label"), 8).alias("lane_id"), F.col("first.label").alias("name"), F.struct("first.frag_idx", "first.pos").alias("pos"))


def role_lanes(facts: DataFrame) -> DataFrame:
    """process, task_id, role, lane_id, question of each activity: its role's lane, else the first lane with a question, else Lane-unassigned with another."""
    known = lanes(facts)
    activities = dedup_facts(facts.where("certainty <> 'CONFLICT'")).where("kind = 'ACTIVITY'").select("process", "subject_key", "fact_id")
    activities = activities.join(activity_aggregates(facts).select("process", "subject_key", "role"), ["process", "subject_key"], "left").withColumn("norm", C.strip_space(F.col("role")))
    first = known.groupBy("process").agg(F.min_by("lane_id", "pos").alias("first_lane"))
    joined = activities.join(known.select("process", "norm", "lane_id"), ["process", "norm"], "left").join(first, "process", "left")
    short = C.short_hash(F.col("fact_id"), 8)
    question = F.when(F.col("lane_id").isNotNull(), None).when(F.col("first_lane").isNotNull(), F.concat(F.lit("Q-role-"), short)).otherwise(F.concat(F.lit("Q-nolane-"), short))
    return joined.select("process", F.concat(F.lit("Task-"), short).alias("task_id"), "role", F.coalesce("lane_id", "first_lane", F.lit("Lane-unassigned")).alias("lane_id"), question.alias("question_id"))


def flow_nodes(facts: DataFrame) -> DataFrame:
    """process, subject_key, node_id: tasks, gateways and ends that flows can name."""
    kinds = F.create_map(*[F.lit(x) for kv in {"ACTIVITY": "Task-", "GATEWAY": "Gateway-", "END_EVENT": "End-"}.items() for x in kv])
    own = dedup_facts(facts.where("certainty <> 'CONFLICT'")).where("kind in ('ACTIVITY', 'GATEWAY', 'END_EVENT') and subject_key is not null")
    return own.select("process", "subject_key", F.concat(kinds[F.col("kind")], C.short_hash(F.col("fact_id"), 8)).alias("node_id"))


def resolve_flows(facts: DataFrame) -> DataFrame:
    """process, flow_id, source_ref, target_ref, condition of FLOW facts whose ends are known: the first for each pair of nodes, with the first condition that fits."""
    keyed = facts.where("certainty <> 'CONFLICT'").withColumn("process", C.machine_key(F.col("process_key"))).withColumn("at", F.struct("frag_idx", "pos"))
    flows = keyed.where("kind = 'FLOW' and source_key is not null and target_key is not null").select("process", "fact_id", "source_key", "target_key", "at")
    ends = flow_nodes(facts)
    of = lambda side: ends.select("process", F.col("subject_key").alias(f"{side}_key"), F.col("node_id").alias(f"{side}_ref"))
    found = flows.join(of("source"), ["process", "source_key"]).join(of("target"), ["process", "target_key"])
    first = found.groupBy("process", "source_ref", "target_ref").agg(F.min_by(F.struct("fact_id", "source_key", "target_key"), "at").alias("f")).select("process", "source_ref", "target_ref", "f.*")
    conditions = keyed.where("kind = 'CONDITION' and source_key is not null").select("process", "source_key", F.col("target_key").alias("only"), F.col("label").alias("condition"), "at")
    fit = first.join(conditions, ["process", "source_key"]).where("only is null or only = target_key").groupBy("process", "source_ref", "target_ref").agg(F.min_by("condition", "at").alias("condition"))
    return first.join(fit, ["process", "source_ref", "target_ref"], "left").select("process", C.prefixed_id("Flow", F.col("fact_id"), 8).alias("flow_id"), "source_ref", "target_ref", "condition")


def linear_flows(elements: DataFrame) -> DataFrame:
    """process, source_ref, target_ref: where a process has no flows, its tasks (process, pos, node_id) in order, from Start to End."""
    order = Window.partitionBy("process").orderBy("pos")
    steps = elements.select("process", F.col("node_id").alias("source_ref"), F.coalesce(F.lead("node_id").over(order), F.lit("End")).alias("target_ref"))
    starts = elements.groupBy("process").agg(F.min_by("node_id", "pos").alias("target_ref")).select("process", F.lit("Start").alias("source_ref"), "target_ref")
    return starts.unionByName(steps)


def terminal_orgs(orgs: DataFrame) -> DataFrame:
    """name of each organisation that is nobody's parent. orgs: name, parent."""
    parents = orgs.where("parent is not null").select(F.col("parent").alias("name")).distinct()
    return orgs.select("name").distinct().join(parents, "name", "left_anti")


def align_events(facts: DataFrame, kind: str, word: str) -> DataFrame:
    """process, label_key, label, fact_id, evidence_refs: events of one kind merged by their label without its suffix; the first counts."""
    keyed = facts.where((F.col("kind") == kind) & (F.col("certainty") != "CONFLICT")).withColumn("process", C.machine_key(F.col("process_key")))
    out = keyed.groupBy("process", C.event_label(F.col("label"), word).alias("label_key")).agg(
        F.min_by(F.struct("label", "fact_id"), F.struct("frag_idx", "pos")).alias("f"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("evidence_refs")))).alias("evidence_refs")
    )
    return out.select("process", "label_key", "f.label", "f.fact_id", "evidence_refs")


def aligned_endpoints(facts: DataFrame, flows: DataFrame) -> DataFrame:
    """g, flow, src, dst, rewritten of flows (g, flow, src, dst: fact ids), whose ends at start and end events that are one by their label are the first of them. facts: g, frag_idx, pos, kind, fact_id, label."""
    key = F.when(F.col("kind") == "START_EVENT", C.event_label(F.col("label"), "开始")).when(F.col("kind") == "END_EVENT", C.event_label(F.col("label"), "结束"))
    events = facts.withColumn("key", key).where("key is not null")
    first = events.groupBy("g", "kind", "key").agg(F.min_by("fact_id", F.struct("frag_idx", "pos")).alias("own"))
    one = events.join(first, ["g", "kind", "key"]).select("g", "fact_id", "own")
    at = lambda c: one.select("g", F.col("fact_id").alias(c), F.col("own").alias(f"{c}_own"))
    told = flows.join(at("src"), ["g", "src"], "left").join(at("dst"), ["g", "dst"], "left")
    moved = lambda c: F.coalesce(F.col(f"{c}_own") != F.col(c), F.lit(False))
    return told.select("g", "flow", F.coalesce("src_own", "src").alias("src"), F.coalesce("dst_own", "dst").alias("dst"), (moved("src") | moved("dst")).alias("rewritten"))


def focus_uncertainties(uncertainties: DataFrame, facts: DataFrame, focus: str) -> DataFrame:
    """frag_idx, pos, kind, text, relevant: whether an uncertainty concerns the focus process.

    Related facts are looked up in its own fragment: none known keeps it, any in focus keeps it. Without related facts, codes in its text decide."""
    target = C.machine_key(F.lit(focus))
    related = uncertainties.select("frag_idx", "pos", F.explode("related_fact_ids").alias("fact_id"))
    known = facts.select("frag_idx", "fact_id", (C.machine_key(F.col("process_key")) == target).alias("own"))
    told = related.join(known, ["frag_idx", "fact_id"]).groupBy("frag_idx", "pos").agg(F.bool_or("own").alias("own"))
    codes = C.referenced_codes(F.col("text"))
    none = F.coalesce(F.size("related_fact_ids"), F.lit(0)) == 0
    by_text = (F.size(codes) == 0) | F.exists(codes, lambda c: C.machine_key(c) == target)
    return uncertainties.join(told, ["frag_idx", "pos"], "left").select("frag_idx", "pos", "kind", "text", F.when(none, by_text).otherwise(F.coalesce("own", F.lit(True))).alias("relevant"))


def coverage_drops(items: DataFrame) -> DataFrame:
    """group_id, item_id, dropped: an item goes if the topics of items whose topics are a proper part of its own cover them all. items: group_id, item_id, topics."""
    a, b = items.alias("a"), items.select("group_id", F.col("item_id").alias("other"), F.col("topics").alias("part")).alias("b")
    # parts share a topic with the whole, so the join is on topics and not on all pairs
    on = a.select("group_id", "item_id", "topics", F.explode(F.array_distinct("topics")).alias("topic")).join(b.select("group_id", "other", "part", F.explode(F.array_distinct("part")).alias("topic")), ["group_id", "topic"])
    proper = on.where((F.col("item_id") != F.col("other")) & (F.size("part") < F.size("topics")) & (F.size(F.array_except("part", "topics")) == 0))
    union = proper.groupBy("group_id", "item_id").agg(F.array_distinct(F.flatten(F.collect_set("part"))).alias("covered"))
    gone = items.join(union, ["group_id", "item_id"], "left")
    return gone.select("group_id", "item_id", F.coalesce(F.size(F.array_except("topics", "covered")) == 0, F.lit(False)).alias("dropped"))


def ordered(facts: DataFrame) -> DataFrame:
    """facts (grp, kind, process_key, subject_key, label, fact_id) with place: a stable order by these, whatever order they came in."""
    keys = [F.coalesce(c, F.lit("")) for c in ("kind", "process_key", "subject_key", "label", "fact_id")]
    return facts.withColumn("place", F.row_number().over(Window.partitionBy("grp").orderBy(*keys)))


#: Levels that a process card may have, and those of leaves.
CARD_LEVELS, LEAF_LEVELS = ["L1", "L2", "L3", "L4", "L5"], ["L4", "L5"]
CARD_KINDS = ["PROCESS_NAME", "PROCESS_LEVEL", "PROCESS_OWNER", "PROCESS_PURPOSE"]


def card_fields(facts: DataFrame) -> DataFrame:
    """g, kind, value, certainty, is_leaf, question of each process (facts: g, pos, kind, label, certainty) and kind that a card needs.

    An explicit fact counts first, else the first; a value that isn't explicit, or is missing, raises a question. A level outside L1 to L5 doesn't count; without one, L4 is the working value."""
    wanted = facts.select("g").distinct().withColumn("kind", F.explode(F.array(*map(F.lit, CARD_KINDS))))
    certainty = F.coalesce("certainty", F.lit("EXPLICIT"))
    usable = facts.where((F.col("kind") != "PROCESS_LEVEL") | F.col("label").isin(*CARD_LEVELS))
    chosen = usable.groupBy("g", "kind").agg(F.min_by(F.struct("label", certainty.alias("certainty")), F.struct(certainty != "EXPLICIT", "pos")).alias("c"))
    told = wanted.join(chosen, ["g", "kind"], "left")
    level = F.col("kind") == "PROCESS_LEVEL"
    sure = F.coalesce("c.certainty", F.lit("MISSING"))
    return told.select(
        "g", "kind", F.when(level, F.coalesce("c.label", F.lit("L4"))).otherwise(F.col("c.label")).alias("value"), sure.alias("certainty"),
        F.when(level, F.coalesce(F.col("c.label").isin(*LEAF_LEVELS), F.lit(False))).alias("is_leaf"), (sure != "EXPLICIT").alias("question"),
    )


def aggregate_siblings(facts: DataFrame) -> DataFrame:
    """The facts (g, pos, kind, subject_key, label, evidence_refs) of a catalogue with inputs, outputs, responsibilities, completion_criteria, sla and merged evidence_refs
    of activities and roles. Facts that tell of an activity (inputs, outputs, durations, conditions) or a role (responsibilities) go into the last one with their subject; the
    last duration counts, and lists keep all entries in order. Facts of a subject that isn't there stay."""
    kind = F.col("kind")
    side = F.when(kind == "RESPONSIBILITY", "ROLE").when(kind.isin("INPUT", "OUTPUT", "SLA", "CONFIRMATION_CONDITION"), "ACTIVITY")
    targets = facts.where(kind.isin("ACTIVITY", "ROLE")).groupBy("g", "subject_key", kind.alias("side")).agg(F.max("pos").alias("target"))
    told = facts.withColumn("side", side).join(targets, ["g", "subject_key", "side"], "left")
    gone = told.where("target is not null")
    each = lambda k: F.transform(F.filter("said", lambda x: x["kind"] == k), lambda x: x["label"])
    none = F.array().cast("array<string>")
    slas = F.filter("said", lambda x: x["kind"] == "SLA")
    by = gone.groupBy("g", F.col("target").alias("pos")).agg(F.array_sort(F.collect_list(F.struct("pos", "kind", "label", F.coalesce("evidence_refs", none).alias("refs")))).alias("said"))  # facts on one activity
    rest = told.where("target is null").select("g", "pos", "kind", "subject_key", "label", "evidence_refs").join(by, ["g", "pos"], "left").withColumn("said", F.coalesce("said", F.expr("filter(array(struct(0L AS pos, '' AS kind, '' AS label, array('') AS refs)), x -> false)")))
    own = lambda side, value: F.when(kind == side, value)
    criteria = F.flatten(F.transform(each("CONFIRMATION_CONDITION"), lambda t: F.filter(F.transform(F.split(t, "[、,，]"), lambda v: F.trim(v)), lambda v: v != "")))
    return rest.select(
        "g", "pos", "kind", "subject_key", "label", own("ACTIVITY", each("INPUT")).alias("inputs"), own("ACTIVITY", each("OUTPUT")).alias("outputs"), own("ROLE", each("RESPONSIBILITY")).alias("responsibilities"),
        own("ACTIVITY", criteria).alias("completion_criteria"), own("ACTIVITY", C.parse_sla(F.try_element_at(slas, F.lit(-1))["label"])["value"]).alias("sla_value"),
        F.array_distinct(F.concat(F.coalesce("evidence_refs", none), F.flatten(F.transform("said", lambda x: x["refs"])))).alias("evidence_refs"),
    )
