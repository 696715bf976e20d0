from __future__ import annotations

import unicodedata

from pyspark.sql import functions as F

from procloom.operators import budget, names, state


def test_rule_packet_tells_what_is_missing(spark):
    wanted = spark.createDataFrame([("a",), ("b",)], "rule_id string")
    sections = spark.createDataFrame([("a", "x" * 40)], "rule_id string, content string")
    found = {r["rule_id"]: r for r in budget.rule_packet(wanted, sections, 10).collect()}
    assert (found["a"]["found"], found["a"]["tokens"], found["b"]["found"], found["b"]["status"]) == (True, 10, False, "BUDGET_ATTENTION")


def test_stage_tasks(spark):
    df = spark.createDataFrame([("RUNNABLE", "BUDGET_OK"), ("BLOCKED", "BUDGET_OK"), ("RUNNABLE", "BUDGET_SPLIT_REQUIRED")], "status string, budget_status string")
    assert [r["runnable"] for r in budget.stage_tasks(df).collect()] == [True, False, False]


def test_a_result_over_the_limit_stands_alone(spark):
    rows = [("g", 1, "a", 50), ("g", 2, "b", 130), ("g", 3, "c", 110), ("g", 4, "d", 40), ("g", 5, "e", 60)]
    found = budget.aggregation_tasks(spark.createDataFrame(rows, "grp string, ord long, result_id string, tokens long"), 100).orderBy("task_no").collect()
    assert [(r["tokens"], r["status"]) for r in found] == [(50, "RUNNABLE"), (130, "BLOCKED"), (110, "RUNNABLE"), (100, "RUNNABLE")]


def test_names_are_composed(spark):
    raw = ["é", "한", None, ""]
    found = spark.createDataFrame([(t,) for t in raw], "t string").select(names.compose("t")).collect()
    assert [r[0] for r in found] == [unicodedata.normalize("NFC", t) if t is not None else None for t in raw]


def test_cache_states(spark):
    from hashlib import sha256

    good = sha256(b"a,b").hexdigest()
    batches = spark.createDataFrame([("b1", good, ["b", "a"]), ("b2", "wrong", ["a"])], "batch_id string, batch_sha256 string, content_hashes array<string>")
    queue = spark.createDataFrame([("t1", "b1", "ACCEPTED"), ("t2", "b1", "ACCEPTED"), ("t3", "b1", "PENDING"), ("t4", "b2", "ACCEPTED"), ("t5", "b1", "ACCEPTED"), ("t6", "b3", "ACCEPTED")], "task_id string, batch_id string, status string")
    fragments = spark.createDataFrame([("t1", "b1", good), ("t5", "b1", "old"), ("t4", "b2", "wrong")], "task_id string, batch_id string, batch_sha256 string")
    found = {r["task_id"]: (r["status"], r["reason"]) for r in state.cache_states(queue, batches, fragments).collect()}
    assert found == {"t1": ("CACHED", None), "t2": ("PENDING", "fragment_missing"), "t3": ("PENDING", None), "t4": ("PENDING", "hash_mismatch"), "t5": ("PENDING", "fragment_hash_mismatch"), "t6": ("PENDING", "batch_missing")}


def test_nothing_to_do(spark):
    empty = spark.createDataFrame([], "grp string, extension string, n_blocks long")
    assert budget.estimate_range(empty).count() == 0
    assert budget.context_budgets(spark.createDataFrame([], "grp string, role string, text string"), 10).count() == 0
    assert state.quickstart(spark.createDataFrame([], "request string, intent string, architecture_count int, diagram_count int, has_v2_draft boolean, output_dir string, user_choice string")).where(F.lit(True)).count() == 0
