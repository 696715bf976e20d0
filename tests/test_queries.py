"""Every query of the catalogue runs and gives the rows of its SQL."""

from __future__ import annotations

import subprocess
import sys
from pathlib import Path

import pytest

from procloom.plans import catalog

from .oracle import connect, rows, sql_rows

SF = "/root/testdata/sf0.001"
#: Where the rows are compared: texts are long enough to be cut there.
ROWS = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def duck():  # noqa: ANN201
    return connect(ROWS)


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query_gives_the_rows_of_its_sql(spark, duck, name):
    df = catalog.QUERIES[name](spark, ROWS)
    found = rows(df)
    if name in catalog.SQL:
        columns, wanted = sql_rows(duck, catalog.SQL[name])
        assert sorted(df.columns) == columns
        assert found == wanted



def test_entry_runs(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry_without_the_optional_subpackage(tmp_path):
    root = Path(__file__).resolve().parents[1]
    for p in root.rglob("*.py"):
        part = p.relative_to(root)
        if "llm" not in part.parts and part.name != "corpus_pipeline.py" and part.parts[0] != "tests":
            (tmp_path / part).parent.mkdir(parents=True, exist_ok=True)
            (tmp_path / part).write_bytes(p.read_bytes())
    code = "import __spark_entry__ as e; q = e.queries(); assert q and not any(n.startswith('op') or n == 'pipeline' for n in q); print(len(q))"
    done = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, capture_output=True, text=True)
    assert done.returncode == 0, done.stderr
    assert int(done.stdout) == len(catalog.QUERIES)


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_no_plan_joins_everything_with_everything(spark, name):
    plan = catalog.QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query_runs_on_ten_times_the_tables(spark, name):
    catalog.QUERIES[name](spark, "/root/testdata/sf0.1").write.format("noop").mode("overwrite").save()


def test_scans_read_only_the_columns_they_need(spark):
    plan = catalog.QUERIES["dangling_refs"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "o_totalprice" not in plan and "c_name" not in plan
    plan = catalog.QUERIES["token_estimate"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "source" not in plan and "ReadSchema: struct<doc_id:bigint,text:string>" in plan
