"""Small tables with their results by hand, for functions that no query exercises."""

from pyspark.sql import functions as F

from postwright.operators import curation, guards, matching, ontology, vectors
from postwright.plans import reports


def test_final_set(spark):
    docs = spark.createDataFrame([(1, "Python and SQL")], "doc_id long, text string")
    rows = [(1, "Python", 0, 6, "Python"), (1, "Python", 3, 6, "hon"), (1, "SQL", 11, 14, "sql"), (1, "Go", 9, 2, "x"), (1, "Rust", 0, 99, "x"), (2, "Java", 0, 1, "J")]
    d = guards.integrity(spark.createDataFrame(rows, "doc_id long, canonical string, start int, end int, quote string"), docs)
    assert sorted(map(tuple, d.collect())) == [(1, "Go", "invalid_offsets"), (1, "Python", "duplicate"), (1, "Rust", "invalid_offsets"), (1, "SQL", "text_mismatch")]


def test_grounded_experience(spark):
    docs = spark.createDataFrame([(1, "Analyst at ACME Corp, 2020. Later Data Lead with Globex. Université de Lyon.")], "doc_id long, text string")
    rows = [
        (1, 1, "Analyst", "acme corp", "Analyst at ACME"), (1, 2, "analyst ", "ACME  Corp", "x"), (1, 3, "Data Lead", "Globex", None), (1, 4, "Student", "Université de Lyon", "x"), (1, 5, "CEO", "Initech", "x"),
        (1, 6, "Writer", " ", "x"), (1, 7, "Writer", None, "x"), (1, 8, "Long", "Analyst at ACME Corp, 2020. Later Data Lead with", "x"),
    ]
    d = guards.grounded_experience(spark.createDataFrame(rows, "doc_id long, entry_id int, title string, company string, quote string"), docs)
    # an entry of the same title and company counts once; a quote that isn't there leaves the name's place
    assert sorted((r["entry_id"], r["start"]) for r in d.collect()) == [(1, 0), (3, 49)]


def test_evidence_place(spark):
    d = spark.createDataFrame([(1, "a bc a", "bc", "a"), (2, "a bc a", "zz", "a"), (3, "a bc a", "", "q"), (4, "a bc a", None, None)], "k int, text string, quote string, name string")
    got = {r["k"]: r["at"] for r in d.select("k", guards.locate(F.col("text"), F.col("quote"), F.col("name")).alias("at")).collect()}
    assert got == {1: 2, 2: 0, 3: None, 4: None}


def test_merged_profiles(spark):
    text = spark.createDataFrame([(1, 30, 1, 0, "senior", "lead"), (2, 7, 0, 2, "junior", "unknown"), (3, None, 0, 0, "mid", None)], "profile_id long, total_months int, internship_count int, professional_count int, career_level string, model_level string")
    entries = spark.createDataFrame([(1, 12, "job"), (1, 13, "job"), (1, 6, "internship"), (2, None, "job")], "profile_id long, months int, entry_type string")
    got = {r["profile_id"]: tuple(r)[1:] for r in guards.merged_profiles(text, entries).collect()}
    assert got == {1: (31, 2.58, 1, 2, "lead"), 2: (7, 0.58, 0, 2, "junior"), 3: (None, None, 0, 0, "mid")}


def test_skill_lists(spark):
    jobs = spark.createDataFrame([(1,), (2,)], "job_id long")
    skills = spark.createDataFrame([(1, "SQL"), (1, "Go"), (1, "SQL"), (1, None)], "job_id long, canonical string")
    assert {r["job_id"]: r["skills"] for r in vectors.with_skill_list(jobs, skills).collect()} == {1: ["Go", "SQL"], 2: []}


def test_candidate_text(spark):
    one = lambda *v: F.array(*[F.lit(x) for x in v]).cast("array<string>")
    d = spark.range(1).select(
        vectors.cv_text(F.lit("senior"), one("SQL", "Go"), one("Data"), one("Go"), one(), F.lit("Master"), one("Lead at X", "Analyst at Y")).alias("a"),
        vectors.cv_text(F.lit("unknown"), one(), one(), one(), one(), F.lit(None).cast("string"), one()).alias("b"),
        vectors.version_stamp("s", "m", "r1", 384, True).alias("v"),
    ).first()
    assert d["a"] == "Career level: senior\nSkills: SQL, Go\nDomains: Data\nProgramming languages: Go\nEducation: Master\nExperience: Lead at X; Analyst at Y"
    assert d["b"] == "" and d["v"] == "s:m:r1:384:true"


def test_set_errors(spark):
    d = spark.createDataFrame([(1, ["a", "b"], ["b", "c"]), (2, ["a"], ["a"]), (3, [], ["x"])], "k int, expected array<string>, actual array<string>")
    assert sorted(map(tuple, curation.set_errors(d, "k").collect())) == [(1, "a", "missing"), (1, "c", "extra"), (3, "x", "extra")]


def test_wishes_and_covered_skills_in_recommendations(spark, sf_dir):
    wish = {r["profile_id"]: r["contract_type"].lower() for r in reports._wishes(spark, sf_dir).collect()}
    covered = {r["profile_id"]: set(r["covered"]) for r in reports._covered(spark, sf_dir).collect()}
    rows = reports.recommend_wished(spark, sf_dir).collect()
    assert rows and any(r["profile_id"] in wish for r in rows)
    for r in rows:
        assert wish.get(r["profile_id"], r["j_contract_type"].lower()) == r["j_contract_type"].lower()
        assert not covered[r["profile_id"]] & set(r["missing"])


def test_confirmed_profiles(spark):
    index = ontology.alias_index(spark.createDataFrame([("Python", "language", ["py"], None), ("SQL", "language", [], None)], "canonical string, category string, aliases array<string>, parent string"))
    p = spark.createDataFrame([(1, ["Go"], "mid", 1.0, ["X"]), (2, ["Go"], "mid", 1.0, ["X"]), (3, ["Go"], "mid", None, ["X"]), (4, ["Go"], "mid", 2.0, ["X"])], "profile_id long, skills array<string>, career_level string, total_years double, domains array<string>")
    said = spark.createDataFrame([(1, ["PY", "sql", "python"], "lead", 0.125, ["B", "A", "B"]), (2, ["cobol", "sql", "apl"], "lead", 9.0, []), (4, [], None, None, [])], p.schema)
    out, rejects = matching.with_confirmed(p, said, index)
    got = {r["profile_id"]: (r["confirmed"], r["skills"], r["career_level"], r["total_years"], r["total_months"], r["domains"]) for r in out.collect()}
    assert got == {1: (True, ["Python", "SQL"], "lead", 0.125, 2, ["A", "B"]), 2: (False, ["Go"], "mid", 1.0, 12, ["X"]), 3: (False, ["Go"], "mid", None, None, ["X"]), 4: (True, [], None, None, None, [])}
    assert sorted((r["profile_id"], r["skill"]) for r in rejects.collect()) == [(2, "apl"), (2, "cobol")] and "confirmed" in out.columns
