import random

import duckdb
import pytest
from pyspark.sql import functions as F

from postwright.operators import matching, ontology, questions
from postwright.plans import texts
from tests.oracles import assert_same

SKILLS = [("Machine Learning", "domain", ["ml"], None), ("Python", "language", ["python3"], None), ("Learning", "domain", [], None), ("C++", "language", [], None), ("Machine", "domain", [], None), ("Straße", "domain", [], None)]


@pytest.fixture(scope="module")
def index(spark):
    return ontology.alias_index(spark.createDataFrame(SKILLS, "canonical string, category string, aliases array<string>, parent string"))


CASES = {
    "what percent of jobs need machine learning and python?": (None, None, None, None, ["Machine Learning", "Python"]),
    "what is the weather like today?": (None, None, None, None, []),
    "how many jobs are in France?": ("fr", None, None, None, []),
    "jobs in the United Kingdom": ("gb", None, None, None, []),
    "salary in Germany": ("de", None, None, None, []),
    "no country mentioned here": (None, None, None, None, []),
    "how many senior roles are there?": (None, "senior", None, None, []),
    "junior data scientist jobs": (None, "junior", None, "data scientist", []),
    "full-time jobs in France": ("fr", None, "full_time", None, []),
    "part time roles": (None, None, "part_time", None, []),
    "freelance opportunities": (None, None, "contract", None, []),
    "top skills for Data Scientists?": (None, None, None, "data scientist", []),
    "average salary of Data Engineers?": (None, None, None, "data engineer", []),
    "can you explain how it works?": (None, None, None, None, []),
    "what is the average salary in Italy?": ("it", None, None, None, []),
    "what is the average salary for country=IT?": ("it", None, None, None, []),
    # a window that names a chosen skill again blocks nothing: its words may name others
    "machine learning, ml, machine": (None, None, None, None, ["Machine Learning", "Machine"]),
    "machine learning machine learning": (None, None, None, None, ["Machine Learning", "Machine", "Learning"]),
    "python C++ straße learning": (None, None, None, None, ["Python", "C++", "Straße"]),
    "": (None, None, None, None, []),
}


def test_entities(spark, index):
    rows = [(k, q) for k, q in enumerate(CASES)] + [(0, next(iter(CASES))), (None, "senior python"), (99, None)]
    d = spark.createDataFrame(rows, "id long, text string")
    got = questions.entities(d, index).collect()
    assert len(got) == len(rows)
    by = {}
    for r in got:
        value = (r["country"], r["seniority"], r["contract_type"], r["role_title"], r["skills"])
        assert by.setdefault(r["id"], value) == value and r["skill"] == (r["skills"][0] if r["skills"] else None)
    assert {q: by[k] for k, q in enumerate(CASES)} == CASES
    assert by[None] == (None, "senior", None, None, ["Python"]) and by[99] == (None, None, None, None, [])


def test_windows_are_joined_by_shuffle_beyond_the_broadcast(spark, index, monkeypatch):
    monkeypatch.setattr(questions, "BROADCAST_ALIASES", -1)
    d = spark.createDataFrame([(1, "machine learning and python")], "id long, text string")
    assert questions.entities(d, index).first()["skills"] == ["Machine Learning", "Python"]


@pytest.mark.parametrize("pool", [1, 3, 20])
def test_candidates_of_popular_skills(spark, pool):
    rng = random.Random(pool)
    jobs = [(j, s) for j in range(200) for s in {rng.choice([1, 1, 2, 2, 3, 10, 11, 12, 13, rng.randrange(20, 60)]) for _ in range(5)}]
    profiles = [(p, s) for p in range(40) for s in {rng.choice([1, 2, 3, 3, 10, 11, 25, 31, 44, 999]) for _ in range(p % 6 + 1)}]
    want = []
    for p in range(40):
        own = {s for q, s in profiles if q == p}
        over = {}
        for j, s in jobs:
            if s in own:
                over[j] = over.get(j, 0) + 1
        want += [(p, j, n, r) for r, (j, n) in enumerate(sorted(over.items(), key=lambda x: (-x[1], x[0]))[:pool], 1)]
    a = spark.createDataFrame(profiles + profiles[:5], "profile_id long, skill long")
    b = spark.createDataFrame(jobs + jobs[:9], "job_id long, skill long")
    for share in (0.05, 0.3, 1.0):
        got = matching.lexical_candidates(a, b, pool, share).select("profile_id", "job_id", "overlap", "lexical_rank").collect()
        assert sorted(map(tuple, got)) == sorted(want)


def test_popular_skills_meet_no_posting_one_by_one(spark):
    """All profiles have a skill that half of the jobs have: no join makes a row for each profile and job."""
    a = spark.range(60).selectExpr("id AS profile_id", "explode(array(-1L, id)) AS skill")
    b = spark.range(4000).selectExpr("id AS job_id", "explode(if(id % 2 = 0, array(-1L, id), array(id))) AS skill")
    d = matching.lexical_candidates(a, b, 10)
    d.collect()
    plan = d._jdf.queryExecution().executedPlan()
    assert d.groupBy("profile_id").agg(F.count("*").alias("n")).where("n <> 10").count() == 0 and "WindowGroupLimit" in plan.toString()


def test_routes_of_texts_that_name_topics_and_figures(spark, tmp_path):
    texts_ = [
        "Whenever.", "a percentage of it", "émean", "mean, is it", "upload cv; upload my cv, snapshot", "lexical and semantic: data source", "top  skills", "top 5 skills", "plus demandées", "the salaire", "en moyenne", "breakdown", "comparer", "comparers",
        "How Many, 5 %", "total count of", "who are you", "répartition", None, "", "most commonly", "un_mean_", "salary in it", "skill gap, match score",
    ]
    rows = [(c, t, "user" if c % 4 else "system", x) for c, x in enumerate([x for x in texts_ for _ in range(2)]) for t in (*range(5), None)]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").coalesce(1).write.parquet(str(tmp_path / "conversations.parquet"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM read_parquet('{tmp_path}/conversations.parquet/*.parquet')")
    assert_same(texts.question_routes(spark, str(tmp_path)), con, texts.SQL["question_routes"])
