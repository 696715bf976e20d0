"""Findings of a review: collection, policy for pictures, gates, verdict and report sections."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SUCCESS = ("SUCCEEDED", "SUCCEEDED_WITH_WARNINGS")
SEVERITIES = ("BLOCKER", "CRITICAL", "MAJOR", "MINOR", "INFO")
#: Stages that a route must have completed.
_ARCHITECTURE = ["extract-architecture", "review-l4", "review-l5", "review-l6", "review-sop", "review-hierarchy"]
_DIAGRAM = ["extract-diagram", "review-bpmn", "review-visual"]
REQUIRED_STAGES = {"INTEGRATED": [*_ARCHITECTURE, *_DIAGRAM, "review-consistency"], "ARCHITECTURE_ONLY": _ARCHITECTURE, "DIAGRAM_ONLY": _DIAGRAM}
#: Rule prefixes of the review families.
PREFIXES = {"L4": "FA-L4-", "L5": "FA-L5-", "L6": "FA-L6-", "SOP": "FA-SOP-", "HIERARCHY": "FA-HIER-", "BPMN": "FA-BPMN-", "VISUAL": "FA-VIS-", "CONSISTENCY": "FA-CONS-", "ACTIVITY_BPMN": "FA-ACT-BPMN-"}


def fingerprint(rule: Column, artifact: Column, target: Column, observation: Column) -> Column:
    return F.sha2(F.concat_ws("\0", *[F.coalesce(c, F.lit("")) for c in (rule, artifact, target, observation)]), 256)


def stable_fingerprint(rule: Column, artifacts: Column, targets: Column, locators: Column) -> Column:
    """Identity of a finding that doesn't change with its wording."""
    return F.sha2(F.to_json(F.struct(rule.alias("rule_id"), F.array_sort(artifacts).alias("artifact_refs"), F.array_sort(targets).alias("target_refs"), locators.alias("evidence")), {"ignoreNullFields": "false"}), 256)


def collect(findings: DataFrame) -> DataFrame:
    """The findings (run_id, pos, status, fingerprint, n_evidence, ...) of stages that succeeded, one for each fingerprint: that with most evidence, of equals the first. Without a fingerprint all stay."""
    own = findings.where(F.col("status").isin(*SUCCESS))
    columns = F.struct(*own.columns)
    some = own.where("fingerprint <> ''").groupBy("run_id", "fingerprint").agg(F.min_by(columns, F.struct(-F.col("n_evidence"), "pos")).alias("f")).select("f.*")
    return some.unionByName(own.where("coalesce(fingerprint, '') = ''"))


def visual_policy(findings: DataFrame) -> DataFrame:
    """findings (parse_mode, confidence, locator_type, ...) as pictures allow: capped confidence, image regions for elements, confirmation below 0.8, changes made."""
    visual = F.col("parse_mode") == "VISUAL_ONLY"
    capped = visual & (F.col("confidence") > 0.6)
    moved = visual & (F.col("locator_type") == "BPMN_ELEMENT")
    told = findings.withColumns({"changed": capped.cast("int") + moved.cast("int"), "confidence": F.when(capped, 0.6).otherwise(F.col("confidence")), "locator_type": F.when(moved, "IMAGE_REGION").otherwise(F.col("locator_type"))})
    return told.withColumn("confirm", F.coalesce(F.col("confidence") < 0.8, F.lit(False)))


def gate_issues(stages: DataFrame) -> DataFrame:
    """run_id, issue, stage_id of stages (run_id, route, stage_id, status, degradation, n_evidence): required stages that didn't succeed, degraded ones, and successes without evidence."""
    spark = stages.sparkSession
    required = spark.createDataFrame([(r, s) for r, ss in REQUIRED_STAGES.items() for s in ss], "route string, stage_id string")
    good = F.col("status").isin(*SUCCESS)
    runs = stages.select("run_id", "route").distinct()
    missing = runs.join(F.broadcast(required), "route").join(stages.where(good).select("run_id", "stage_id"), ["run_id", "stage_id"], "left_anti")
    issue = lambda df, name: df.select("run_id", F.lit(name).alias("issue"), "stage_id")
    return issue(missing, "MISSING").unionByName(issue(stages.where("degradation <> ''"), "DEGRADED")).unionByName(issue(stages.where(good & (F.col("n_evidence") == 0)), "NO_EVIDENCE"))


def verdicts(stages: DataFrame, findings: DataFrame) -> DataFrame:
    """run_id, counts by severity, n_confirm and verdict of each run; findings: run_id, severity, confirm."""
    issues = gate_issues(stages).groupBy("run_id").agg(F.count("*").alias("n_issues"))
    counts = findings.groupBy("run_id").agg(*[F.count_if(F.col("severity") == s).alias(f"n_{s.lower()}") for s in SEVERITIES], F.count_if("confirm").alias("n_confirm"))
    told = stages.select("run_id").distinct().join(issues, "run_id", "left").join(counts, "run_id", "left").na.fill(0)
    verdict = F.when(F.col("n_issues") > 0, "INSUFFICIENT_EVIDENCE").when(F.col("n_blocker") + F.col("n_critical") > 0, "FAIL").when(F.col("n_major") + F.col("n_minor") > 0, "CONDITIONAL_PASS").otherwise("PASS")
    return told.withColumn("verdict", verdict)


def section(rule: Column) -> Column:
    """The report section that a rule's findings stand in."""
    out = F.lit("OTHER")
    for name, prefix in PREFIXES.items():
        out = F.when(rule.startswith(prefix), name).otherwise(out)
    return out


def ordered(findings: DataFrame) -> DataFrame:
    """findings (run_id, rule_id, targets, ...) with place: their order in their run by rule and first target; of equals as pos has them."""
    return findings.withColumn("place", F.row_number().over(Window.partitionBy("run_id").orderBy("rule_id", F.get("targets", F.lit(0)), "pos")))


def report_sections(findings: DataFrame) -> DataFrame:
    """run_id, section, severity, n, n_confirm of findings (run_id, rule_id, severity, confirm)."""
    return findings.groupBy("run_id", section(F.col("rule_id")).alias("section"), "severity").agg(F.count("*").alias("n"), F.count_if("confirm").alias("n_confirm"))
