"""Alignment of a batch's fragments: the facts of its card, its activities and its control flow as one flow of joins, all batches at once.

Process keys are those of the card. Ends of flows that name an activity by a key of the card take the activity's own key, by its label without white space and
case. What is said of activities goes into them; an activity that only repeats the label of an end event goes into that event. End events of a fragment that are one
by their label are merged, and take the key of the control flow; start events are merged over all fragments, and flows follow them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from procloom.functions import columns as C
from procloom.operators import facts as FA
from procloom.tables import spill

CARD, CATALOG, FLOW = "PROCESS_CARD", "ACTIVITY_CATALOG", "CONTROL_FLOW"


def plain(label: Column) -> Column:
    """A label without white space and case."""
    return F.lower(C.strip_space(label))


def _merged(refs: str = "evidence_refs") -> Column:
    """References of a few facts in order of pos, each once."""
    rows = F.array_sort(F.collect_list(F.struct("pos", F.coalesce(refs, F.array().cast("array<string>")).alias("r"))))
    return F.array_distinct(F.flatten(F.transform(rows, lambda x: x["r"])))


def problems(facts: DataFrame) -> DataFrame:
    """g, problem of batches that can't be aligned: fragments of two versions, or no card."""
    told = facts.groupBy("g").agg(F.countDistinct("batch_sha256").alias("n"), F.bool_or(F.col("task_kind") == CARD).alias("card"))
    return told.select("g", F.when(F.col("n") > 1, "MIXED_BATCH").when(~F.col("card"), "NO_PROCESS_CARD").alias("problem")).where("problem is not null")


def key_mapping(facts: DataFrame) -> DataFrame:
    """g, key, own: the activity's subject key that a key of the card stands for; keys of events and gateways stand for themselves."""
    named = facts.where((F.col("task_kind") == CARD) & F.col("kind").isin("INPUT", "OUTPUT") & (F.coalesce("activity", F.lit("")) != ""))
    named = named.groupBy("g", F.col("subject_key").alias("key")).agg(F.max_by("activity", "pos").alias("name"))
    fixed = facts.where((F.col("task_kind") == FLOW) & (F.col("kind").isin("START_EVENT", "END_EVENT") | F.col("kind").startswith("GATEWAY"))).select("g", F.col("subject_key").alias("key")).distinct()
    acts = facts.where((F.col("task_kind") == CATALOG) & (F.col("kind") == "ACTIVITY")).groupBy("g", plain(F.col("label")).alias("name")).agg(F.min_by("subject_key", "pos").alias("own"))
    return named.join(fixed, ["g", "key"], "left_anti").withColumn("name", plain(F.col("name"))).join(acts, ["g", "name"]).select("g", "key", "own")


def _rewritten(facts: DataFrame, mapping: DataFrame, where: Column) -> DataFrame:
    """facts whose src and dst are replaced by mapping (g, key, own) where that holds."""
    for side in ("src", "dst"):
        facts = facts.join(mapping.select("g", F.col("key").alias(side), F.col("own").alias("_own")), ["g", side], "left").withColumn(side, F.when(where, F.coalesce("_own", side)).otherwise(F.col(side))).drop("_own")
    return facts


def align(facts: DataFrame) -> DataFrame:
    """g, task_kind, pos, kind, process_key, subject_key, label, src, dst, inputs, outputs, responsibilities, completion_criteria, sla_value, evidence_refs of the facts
    that are left, of facts (g, batch_sha256, task_kind, pos (unique in g, by fragment and place), kind, process_key, subject_key, label, activity, src, dst, tools, evidence_refs)."""
    good = spill(facts.join(problems(facts), "g", "left_anti"), "facts")
    name = F.min_by("process_key", F.struct(F.col("kind") != "PROCESS_NAME", "pos"))
    key = good.where(F.col("task_kind") == CARD).groupBy("g").agg(name.alias("process_key"))
    is_flow = (F.col("task_kind") == FLOW) & (F.col("kind") == "FLOW")
    told = _rewritten(good, key_mapping(good), is_flow)

    lists = FA.aggregate_siblings(told.where(F.col("task_kind") == CATALOG)).drop("kind", "subject_key", "label")
    rest = told.where(F.col("task_kind") == CATALOG).drop("evidence_refs").join(lists, ["g", "pos"])
    other = told.where(F.col("task_kind") != CATALOG)
    for f in lists.schema.fields:
        if f.name not in other.columns:
            other = other.withColumn(f.name, F.lit(None).cast(f.dataType))
    told = spill(rest.unionByName(other), "siblings")

    end = C.event_label(F.col("label"), "结束")
    ends = told.where((F.col("task_kind") == FLOW) & (F.col("kind") == "END_EVENT")).groupBy("g", plain(end).alias("same")).agg(F.min("pos").alias("into"))
    bare = F.col("sla_value").isNull()
    for c in ("inputs", "outputs", "completion_criteria", "tools"):
        bare = bare & (F.coalesce(F.size(c), F.lit(0)) <= 0)
    alias = told.where((F.col("task_kind") == CATALOG) & (F.col("kind") == "ACTIVITY") & bare).withColumn("same", plain(end)).join(ends, ["g", "same"])
    alias = spill(alias.select("g", "pos", "into", "evidence_refs"), "aliases")
    more = alias.groupBy("g", F.col("into").alias("pos")).agg(_merged().alias("_more"))
    told = told.join(alias.select("g", "pos"), ["g", "pos"], "left_anti").join(more, ["g", "pos"], "left")
    none = F.array().cast("array<string>")
    told = told.withColumn("evidence_refs", F.array_distinct(F.concat(F.coalesce("evidence_refs", none), F.coalesce("_more", none)))).drop("_more")

    kind = F.col("kind")
    event = F.when(kind == "END_EVENT", end).when(kind == "START_EVENT", C.event_label(F.col("label"), "开始"))
    told = spill(told.withColumn("_event", event).withColumn("label", F.when(kind == "END_EVENT", F.regexp_replace("label", r"（结束）$|\(结束\)$", "")).otherwise(F.col("label"))), "events")
    events = told.where("_event is not null")
    own = events.where((kind == "END_EVENT") & (F.col("task_kind") == FLOW)).groupBy("g", "_event").agg(F.max_by("subject_key", "pos").alias("_key"))
    first_end = events.where(kind == "END_EVENT").groupBy("g", "task_kind", "_event").agg(F.min("pos").alias("pos"), _merged().alias("_refs"))
    flow_key = F.min_by("subject_key", F.when(F.col("task_kind") == FLOW, F.col("pos")))
    starts = events.where(kind == "START_EVENT")
    one = starts.groupBy("g", "_event").agg(F.count("*").alias("_n"), F.coalesce(flow_key, F.min("subject_key")).alias("_key"), _merged().alias("_refs"))
    starts = starts.join(one, ["g", "_event"])
    kept_start = starts.groupBy("g", "_event", "_key", "_refs").agg(F.coalesce(F.min(F.when(F.col("subject_key") == F.col("_key"), F.col("pos"))), F.min("pos")).alias("pos"))
    moved = starts.join(kept_start.select("g", F.col("pos").alias("_first"), "_event"), ["g", "_event"]).where("pos <> _first and subject_key <> _key")
    moved = spill(moved.groupBy("g", F.col("subject_key").alias("key")).agg(F.max_by("_key", "pos").alias("own")), "moved")

    plain_facts = told.where("_event is null")
    end_facts = told.where(kind == "END_EVENT").join(first_end.select("g", "pos", "_refs"), ["g", "pos"]).join(own, ["g", "_event"], "left")
    end_facts = end_facts.withColumn("subject_key", F.when(F.col("task_kind") == CARD, F.coalesce("_key", "subject_key")).otherwise(F.col("subject_key"))).withColumn("evidence_refs", F.col("_refs"))
    start_facts = told.where(kind == "START_EVENT").join(kept_start.select("g", "pos", "_key", "_refs"), ["g", "pos"]).withColumn("subject_key", F.col("_key")).withColumn("evidence_refs", F.col("_refs"))
    out = plain_facts.unionByName(end_facts.select(plain_facts.columns)).unionByName(start_facts.select(plain_facts.columns))
    out = _rewritten(out, moved, F.lit(True)).drop("process_key").join(key, "g")
    return out.select("g", "task_kind", "pos", "kind", "process_key", "subject_key", "label", "src", "dst", "inputs", "outputs", "responsibilities", "completion_criteria", "sla_value", "evidence_refs")
