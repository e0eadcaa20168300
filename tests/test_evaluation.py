import json
import random

import duckdb
import pytest
from pyspark.sql import functions as F

from postwright.operators import evaluation, guards, ontology
from postwright.plans import texts
from tests.oracles import assert_same

JOBS = "job_id long, text string, skills array<string>, career_level string, experience_min_years double, remote_mode string, is_remote boolean"


@pytest.fixture(scope="module")
def index(spark):
    return ontology.alias_index(spark.createDataFrame([("Python", "language", ["py"], None), ("SQL", "language", [], None)], "canonical string, category string, aliases array<string>, parent string"))


def answer(**parts):
    return json.dumps(parts)


def test_answers(spark, index):
    skill = lambda name, evidence="Python and SQL", confidence=0.9, **more: {"name": name, "evidence": evidence, "confidence": confidence, **more}
    jobs = [(k, "Python and SQL, system prompt, senior, 3 years, remote", ["SQL"] if k == 2 else [], "mid" if k == 7 else "unknown", 5.0 if k == 9 else None, "hybrid" if k == 12 else None, False if k == 11 else None) for k in range(1, 30)]
    rows = [
        (1, answer(skills=[skill("py"), skill("Python"), skill("Cobol")]), None), (2, answer(skills=[skill("sql"), skill("py", "not there"), skill("py", confidence=0.2)]), None), (3, "nope", None), (4, None, None), (5, "{}", "timeout"),
        (6, answer(skills=[skill("py", note=1)]), None), (7, answer(career_level={"value": "Sr", "evidence": "senior", "confidence": 0.8}), None), (8, answer(career_level={"value": "Sr", "evidence": "senior", "confidence": 0.8}), None),
        (9, answer(experience_requirement={"minimum_years": 3, "confidence": 1, "evidence": "3 years"}), None), (10, answer(experience_requirement={"minimum_years": "3", "maximum_years": 2, "confidence": 1, "evidence": "3 years"}), None),
        (11, answer(work_mode={"value": "fully remote", "confidence": 1, "evidence": "remote"}), None), (12, answer(work_mode={"value": "remote", "confidence": 1, "evidence": "remote"}), None), (13, answer(work_mode={"value": "moon", "confidence": 1}), None),
        (14, answer(skills=[skill("py", "system prompt")]), None), (15, answer(skills=[skill("py", confidence=2)]), None), (16, answer(skills=[skill("py", confidence=None)]), None), (17, answer(skills=[{"name": 3, "evidence": "x", "confidence": 1}]), None),
        (18, answer(skills="py"), None), (19, "[1]", None), (20, answer(experience_requirement={"minimum_years": "many", "confidence": 1}), None), (21, answer(experience_requirement={"minimum_years": "unknown", "confidence": 1}), None), (99, answer(), None),
    ]
    d = evaluation.validated(spark.createDataFrame(rows, "job_id long, answer string, error string"), spark.createDataFrame(jobs, JOBS), index)
    got = {}
    for r in d.collect():
        got.setdefault(r["job_id"], []).append((r["field"], r["canonical"], r["verdict"], r["reason"]))
    bad = [("json", None, "rejected", "invalid_json_schema")]
    want = {
        1: [("skill", "Python", "accepted", None), ("skill", "Python", "rejected", "duplicate_skill"), ("skill", None, "unmapped", "unknown_ontology_skill")],
        2: [("skill", "SQL", "rejected", "already_deterministic"), ("skill", "Python", "rejected", "hallucinated_evidence"), ("skill", "Python", "rejected", "low_confidence")],
        3: bad, 4: bad, 5: [("call", None, "rejected", "timeout")], 6: bad, 7: [("career_level", None, "conflict", "deterministic_conflict")], 8: [("career_level", "senior", "accepted", None)],
        9: [("experience", None, "conflict", "deterministic_conflict")], 10: [("experience", None, "rejected", "contradictory_experience")], 11: [("work_mode", None, "conflict", "metadata_conflict")],
        12: [("work_mode", None, "conflict", "deterministic_conflict")], 14: [("response", None, "rejected", "prompt_injection")], 15: bad, 16: [("skill", "Python", "rejected", "low_confidence")], 17: bad, 18: bad, 19: bad, 20: bad,
    }
    assert {k: sorted(v, key=str) for k, v in got.items()} == {k: sorted(v, key=str) for k, v in want.items()}


@pytest.mark.parametrize("n", [1, 2, 7, 500])
def test_order_statistics(spark, n):
    rng = random.Random(n)
    rows = [(g, rng.choice([rng.random(), 0.5, None, -1e300, 7.0])) for g in ("a", "b", None) for _ in range(n)]
    d = evaluation.order_statistics(spark.createDataFrame(rows, "g string, v double"), "v", ["g"], {"p50": evaluation.nearest(0.5), "p95": evaluation.nearest(0.95), "least": F.lit(0), "most": F.col("total") - 1})
    got = {(r["g"], r["name"]): r["value"] for r in d.collect()}
    want = {}
    for g in ("a", "b", None):
        v = sorted(x for h, x in rows if h == g and x is not None)
        if v:
            want |= {(g, "p50"): v[round(0.5 * (len(v) - 1))], (g, "p95"): v[round(0.95 * (len(v) - 1))], (g, "least"): v[0], (g, "most"): v[-1]}
    assert got == want


def test_order_statistics_whatever_the_quantiles(spark, monkeypatch):
    # sketches of many values depend on the order in which they meet: here each reckoning gives other quantiles
    other = F.udf(lambda values: sorted(random.SystemRandom().sample(values, 5)), "array<double>")
    monkeypatch.setattr(F, "percentile_approx", lambda v, shares, accuracy: other(F.collect_set(v)))
    d = spark.range(3000).selectExpr("id % 3 AS g", "double(id) AS v")
    got = evaluation.order_statistics(d, "v", ["g"], {"p50": evaluation.nearest(0.5), "p95": evaluation.nearest(0.95)})
    assert {(r["g"], r["name"]): r["value"] for r in got.collect()} == {(g, name): 3.0 * k + g for g in range(3) for name, k in (("p50", 500), ("p95", 949))}


def test_sample_of_an_empty_table(spark):
    none = spark.createDataFrame([], "job_id long, source string, country string, title string, n_chars int")
    assert evaluation.sample(none, 10).count() == 0
    some = spark.createDataFrame([(k, ["adzuna", "remoteok", None][k % 3], ["nl", None, "fr"][k % 5 % 3], [None, "Data Engineer"][k % 2], k * 100) for k in range(40)], none.schema)
    assert evaluation.sample(some, 0).count() == 0 and evaluation.sample(some, 1000).count() == 40
    got = evaluation.sample(some, 20).groupBy("stratum").count().collect()
    assert sum(r["count"] for r in got) == 20


def test_costs_round_halves_up(spark):
    rows = [(485, 485), (25, 175), (2_483_465, 696_380), (123_456_789_012, 0)]
    d = spark.createDataFrame(rows, "p long, c long").select("p", "c", guards.token_cost(F.col("p"), F.col("c")).alias("cost"))
    assert {(r["p"], r["c"]): r["cost"] for r in d.collect()} == {(p, c): (p * 59 + c * 79 + 50) // 100 / 1e6 for p, c in rows}


def test_metrics_of_a_cost_between_two_digits(spark, tmp_path):
    # the costs of these documents end in a half of the last digit, which doubles take for less
    spark.range(4970).selectExpr("id AS doc_id", "'one text' AS text", "'src0' AS source").coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{tmp_path}/documents.parquet/*.parquet')")
    assert_same(texts.evaluation_metrics(spark, str(tmp_path)), con, texts.SQL["evaluation_metrics"])


def test_claims_leave_their_text_behind(spark, index):
    jobs = spark.createDataFrame([(k, "Python", [], "unknown", None, None, None) for k in range(5)], JOBS)
    answers = jobs.select("job_id", F.lit(answer(skills=[{"name": "py", "evidence": "Python", "confidence": 1}])).alias("answer"), F.lit(None).cast("string").alias("error"))
    plan = evaluation.validated(answers, jobs, index)._jdf.queryExecution().optimizedPlan().toString()
    above = plan[: plan.index("Generate posexplode")]
    assert "text#" not in above and "rightHint=(strategy=broadcast)" in above.replace("rightHint=(strategy=broadcast, ", "rightHint=(strategy=broadcast)")
