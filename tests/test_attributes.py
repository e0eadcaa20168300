import random
import re

from pyspark.sql import functions as F

from postwright.operators import attributes, resumes, skillmatch
from tests.test_matching import shuffled


def test_texts_are_folded_once(spark):
    d = spark.createDataFrame([(1, "Été"), (2, None)], "doc_id long, text string")
    none, t = F.expr("cast(array() as array<string>)"), F.col("text")
    plan = lambda x: x._jdf.queryExecution().optimizedPlan().toString()
    assert plan(d.select(attributes.candidate_attributes(t, none).alias("a"))).count("translate(") == 1
    assert plan(d.select(attributes.job_attributes(t, t, t, F.lit(None).cast("boolean"), t, t, none).alias("a"))).count("translate(") == 3


def test_lines_meet_in_their_row(spark):
    text = "Analyst,\n 03/2021 - \t\nMay 2022\n\t\n5 to 6\nnothing\nStage janvier 2020\n–\nprésent"
    e = resumes.experience_entries(spark.createDataFrame([(1, text), (2, None), (3, "")], "doc_id long, text string"), F.lit("2024-06-15").cast("date"))
    got = [tuple(r) for r in e.orderBy("pos").select("pos", "entry_type", "start_date", "end_date", "months").collect()]
    assert got == [(0, "job", "03/2021", "may 2022", 15), (1, "job", "03/2021", "may 2022", 15), (6, "internship", "janvier 2020", "present", 54)]
    assert e._jdf.queryExecution().optimizedPlan().toString().count("Window [") == 1


def test_signs_miss_no_match(spark):
    """Patterns that are looked for by their signs first say and count what the patterns alone do."""
    tables = [attributes.ROLES, attributes.EDUCATION, attributes.CITIES, attributes.COUNTRIES, attributes.DOMAIN_TEXTS, attributes.LEVELS, attributes.JOB_TYPES, resumes.EDUCATION_LEVELS, resumes.EDUCATION_FIELDS, [("", resumes.ENROLLED)]]
    patterns = sorted({p for t in tables for _, p in t})
    words = sorted({w for p in patterns for w in re.findall(r"[a-z0-9]+", p) if len(w) > 1} | {"é", "x", "sr.", "on-site", "onsite", "ci/cd", "back-end", "apprenties"})
    rng = random.Random(4)
    texts = ["", *words, *["".join(rng.choice(words) + rng.choice([" ", " ", "  ", "-", ".", "_", "", "é"]) for _ in range(rng.randint(2, 9))) for _ in range(3000)]]
    d = spark.createDataFrame([(t,) for t in texts], "t string")
    differ = [F.count_if(attributes.has(F.col("t"), p) != F.col("t").rlike(f"(?U){p}")) + F.count_if(attributes.count_of(F.col("t"), p) != F.regexp_count("t", F.lit(f"(?U){p}"))) for p in patterns]
    assert list(d.agg(*[c.alias(f"c{k}") for k, c in enumerate(differ)]).first()) == [0] * len(patterns)


def test_profiles_leave_their_texts_where_they_are(spark):
    words = F.expr("array_join(transform(sequence(1, 300), k -> concat('w', xxhash64(k, id))), ' ')")
    text = F.concat(F.lit("Experience\nAnalyst, 03/2021 - 05/2022\nSkills\nSQL\n"), words, F.when(F.col("id") % 2 == 0, "\nEducation\nMaster in finance, langage R").otherwise("\nProjects\nskills and R"))
    d = spark.range(400).select(F.col("id").alias("doc_id"), text.alias("text"))
    s = spark.createDataFrame([("SQL", "language", [], None), ("R", "language", [], None)], "canonical string, category string, aliases array<string>, parent string")
    was = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        size, before = d.agg(F.sum(F.length("text"))).first()[0], shuffled(spark)
        rows = resumes.deterministic_profiles(d, skillmatch.matches(d, s), F.lit("2024-06-15").cast("date")).collect()
        assert shuffled(spark) - before < 0.1 * size
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", was)
    got = {(r["doc_id"] % 2, tuple(x["canonical"] for x in r["skills"]), r["total_months"], r["education"]["level"], r["education"]["field"]) for r in rows}
    assert len(rows) == 400 and got == {(0, ("SQL", "R"), 30, "master/mba", "finance"), (1, ("SQL",), 30, None, None)}


def test_date_ranges_at_the_ends_of_long_lines(spark):
    long = " ".join(["filler"] * 90)
    lines = [f"one {long} march 2020", "to", f"june 2021 {long}", "x", f"four {long} 01/2019 a 03/2019 {long}", "y", f"six {long} may 2018 -", f"12/05/18 {long}"]
    d = spark.createDataFrame([(1, "\n".join(lines)), (2, long), (3, None)], "doc_id long, text string")
    got = resumes.experience_entries(d, F.lit("2024-06-15").cast("date"))
    assert sorted((r["doc_id"], r["pos"], r["start_date"], r["end_date"]) for r in got.collect()) == [
        (1, 0, "march 2020", "june 2021"), (1, 2, "01/2019", "03/2019"), (1, 3, "01/2019", "03/2019"), (1, 4, "01/2019", "03/2019"), (1, 5, "may 2018", "12/05/18"), (1, 6, "may 2018", "12/05/18"),
    ]
