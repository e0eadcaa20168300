import re

import pytest
from pyspark.sql import functions as F

from postwright.functions import session
from postwright.operators import constraints, resumes
from postwright.plans import reports
from postwright.plans import roles as R
from postwright.sources import boards

RAW = "raw_job_id long, source string, source_id string, payload string"


def test_runs_leave_a_row_each(spark, tmp_path):
    target, runs = f"{tmp_path}/raw", f"{tmp_path}/runs"
    d = spark.createDataFrame([(1, "a", "x", "p"), (2, "a", "x", "q"), (3, "a", "y", "p")], RAW)
    boards.ingest_run(d, target, runs, "a")
    boards.ingest_run(d, target, runs, "a")
    bad = d.withColumn("payload", F.raise_error(F.lit("no such page")))
    with pytest.raises(Exception, match="no such page"):
        boards.ingest_run(bad.withColumn("source_id", F.lit("z")), target, runs, "a")
    boards.ingest_run(d.limit(0), target, runs, "a")
    got = spark.read.parquet(runs).orderBy("started_at").collect()
    assert [(r["status"], r["rows_fetched"], r["rows_inserted"]) for r in got] == [("success", 3, 2), ("success", 3, 0), ("failed", 0, 0), ("success", 0, 0)]
    assert "Traceback" in got[2]["error"] and "no such page" in got[2]["error"] and got[0]["error"] is None
    assert all(r["finished_at"] >= r["started_at"] for r in got) and len({r["run_id"] for r in got}) == 4
    assert spark.read.parquet(target).count() == 2


def test_redaction_at_any_depth(spark):
    schema = """id long, text string, m map<string, struct<text: string, n: int>>, s struct<text: string, k: int, deep: struct<raw_text: string, pages: array<struct<page: int, text: string>>>>,
      a array<array<struct<text: string, b: boolean>>>, only array<struct<text: string>>, plain array<string>, keyed map<string, string>"""
    row = (1, "x", {"text": ("x", 1), "k": ("x", 2)}, ("x", 3, ("x", [(1, "x"), (2, None), None])), [[("x", True)], None, []], [("x",)], ["x"], {"text": "x", "raw_text": "x", "z": "kept"})
    d = resumes.redacted(spark.createDataFrame([row, (2, None, None, None, None, None, None, None)], schema))
    got = {r["id"]: r.asDict(recursive=True) for r in d.collect()}
    assert got[1] == {"id": 1, "m": {"k": {"n": 2}}, "s": {"k": 3, "deep": {"pages": [{"page": 1}, {"page": 2}, None]}}, "a": [[{"b": True}], None, []], "plain": ["x"], "keyed": {"z": "kept"}}
    assert got[2] == {"id": 2, "m": None, "s": None, "a": None, "plain": None, "keyed": None}
    names = d.schema.json()
    assert '"text"' not in names and '"raw_text"' not in names


def test_constraints(spark):
    t = spark.createDataFrame([(1, 1, 5), (1, 2, -1), (2, None, None), (None, 9, 0), (None, 9, 0)], "k int, up int, v int")
    catalogue = [constraints.Check("t", "v", "v >= 0"), constraints.Unique("t", ("k",)), constraints.Foreign("t", "up", "t", "k"), constraints.Foreign("t", "k", "absent", "k")]
    got = {(r["table_name"], r["rule"]): r["n"] for r in constraints.violations({"t": t}, catalogue).collect()}
    assert got == {("t", "v"): 1, ("t", "unique_k"): 1, ("t", "foreign_up"): 2}
    assert all(r["n"] == 0 for r in constraints.violations({"t": t.limit(0)}, catalogue).collect())


@pytest.mark.parametrize("name", ["skill_demand", "frequency_report", "skill_gaps"])
def test_tasks_follow_the_rows(spark, sf_dir, monkeypatch, name):
    """Lines are dealt by job into tasks of so many rows, and adaptive execution doesn't join them up."""
    monkeypatch.setattr(session, "ROWS_A_TASK", 100)
    n = -(-R.job_skills(spark, sf_dir).count() // 100)
    plan = reports.QUERIES[name](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert re.search(rf"hashpartitioning\(job_id#\d+L, {n}\), REPARTITION_BY_NUM", plan)
