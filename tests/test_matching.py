import math
import re
from collections import Counter
from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

from postwright.operators import analytics, curation, guards, matching, resumes
from postwright.operators import vectors as V

PROFILE = "profile_id long, skills array<string>, career_level string, total_years double, domains array<string>, country string, city string, remote boolean"
JOB = "job_id long, title string, skills array<string>, career_level string, min_years double, job_types array<string>, domains array<string>, country string, city string, remote_mode string"


def job(k, skills, **more):
    d = {"title": "t", "career_level": "unknown", "min_years": None, "job_types": [], "domains": [], "country": None, "city": None, "remote_mode": None} | more
    return (k, d["title"], skills, d["career_level"], d["min_years"], d["job_types"], d["domains"], d["country"], d["city"], d["remote_mode"])


@pytest.fixture(scope="module")
def scene(spark):
    p = spark.createDataFrame([(1, ["Python", "AWS"], "unknown", None, [], None, None, None)], PROFILE)
    j = spark.createDataFrame([job(10, ["Python", "AWS"]), job(11, ["Python"]), job(12, ["Python", "Kubernetes"]), job(13, [])], JOB)
    bridge = lambda d, k: d.select(k, F.explode("skills").alias("skill"))
    return p, j, matching.lexical_candidates(bridge(p, "profile_id"), bridge(j, "job_id"))


def test_golden_ranking(scene):
    p, j, c = scene
    r = matching.ranked(matching.scored(c, p, j), 10).orderBy("rank").collect()
    assert [(x["job_id"], x["final_score"]) for x in r] == [(10, 83.94), (11, 76.88), (12, 63.88)]
    assert round(r[0]["skill_score"], 4) == 0.9488 or abs(r[0]["skill_score"] - 0.94875) < 1e-9


def test_null_semantic_score_is_not_zero(scene, spark):
    p, j, c = scene
    s = spark.createDataFrame([(1, 10, 0.5), (1, 13, 0.9)], "profile_id long, job_id long, semantic_score double")
    u = matching.union_candidates(c, s)
    assert {r["job_id"]: r["retrieval_source"] for r in u.collect()} == {10: "both", 11: "lexical", 12: "lexical", 13: "semantic"}
    h = {r["job_id"]: r for r in matching.scored(u, p, j, "hybrid").collect()}
    assert h[11]["final_score"] == 76.88
    assert h[10]["final_score"] == pytest.approx(100 * (0.6 * h[10]["lexical_score"] + 0.4 * 0.5), abs=0.01)


def test_penalties_and_levels(spark):
    p = spark.createDataFrame([(1, ["Sales"], "student", 0.0, ["Sales"], "fr", None, None)], PROFILE)
    j = spark.createDataFrame([job(1, ["Sales"], career_level="senior", min_years=6.0, job_types=["freelance"], domains=["Cloud"], country="FR")], JOB)
    c = spark.createDataFrame([(1, 1, 1)], "profile_id long, job_id long, overlap long")
    r = matching.scored(c, p, j).first()
    assert {x["code"]: x["amount"] for x in r["penalties"]} == {"student_senior_mismatch": 0.3, "large_experience_requirement": 0.25, "freelance_low_experience": 0.25, "business_profile_technical_role_mismatch": 0.45, "experience_gap": 0.25}
    assert (r["penalty_total"], r["final_score"], r["location"]["status"], r["experience_score"]) == (0.75, 0.0, "compatible", 0.15)


def test_gaps_preferences_caution(scene, spark):
    p, j, c = scene
    r = matching.ranked(matching.scored(c, p, j), 10).withColumn("p_quality_label", F.lit("low"))
    assert {x["job_id"]: x["final_score"] for x in matching.cautioned(r).collect()}[12] == pytest.approx(48.88)
    demand = spark.createDataFrame([("Kubernetes", 7)], "skill string, demand long")
    g = matching.skill_gaps(r, demand)
    assert [tuple(x) for x in matching.recommended_skills(g, r).select("skill", "missing_count", "demand", "percent").collect()] == [("Kubernetes", 1, 7, 33.3)]
    f = spark.createDataFrame([(1, "de", None, True)], "profile_id long, country string, city string, remote boolean")
    assert tuple(matching.with_preferences(p, f).select("country", "remote").first()) == ("de", True)
    assert matching.shaped(r).where("job_id = 12").first()["top_missing"] == ["Kubernetes"]
    assert matching.market_context(r).first()["common_skills"][0] == "Python"


def test_average_salary(spark):
    schema = "salary_min double, salary_max double, salary_currency string, salary_period string, country string"
    of = lambda rows: tuple(analytics.average_salary(spark.createDataFrame(rows, schema)).first())
    assert of([(60000.0, 60000.0, "EUR", "year", None), (80000.0, 80000.0, "EUR", "year", None), (0.0, 0.0, "EUR", "year", None)]) == (70000, 2)
    assert of([(50000.0, 50000.0, None, "year", "gb")]) == (58500, 1)
    assert of([(1.0, 1.0, "EUR", "month", None)]) == (None, 0)
    assert of([(float(3000 + k), float(3000 + k), "EUR", "year", None) for k in range(100)]) == (3050, 100)


def test_vectors(spark):
    g = np.random.default_rng(3)
    v = g.normal(size=(300, 16))
    d = spark.createDataFrame([(k, [float(x) for x in v[k]]) for k in range(300)] + [(900, [0.0] * 16), (901, None)], "vec_id long, embedding array<double>")
    q = d.where("vec_id < 5").withColumnRenamed("vec_id", "query_id")
    u = v / np.linalg.norm(v, axis=1, keepdims=True)
    got = {}
    for r in V.nearest(q, d, 10).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append(r["vec_id"])
    assert got == {k: list(np.argsort(-np.round(u @ u[k], 12), kind="stable")[:10]) for k in range(5)}
    near = {}
    for r in V.approximate_nearest(q, d, 10, probes=0.7).collect():
        near.setdefault(r["query_id"], set()).add(r["vec_id"])
    assert np.mean([len(near[k] & set(got[k])) / 10 for k in got]) >= 0.9
    assert [r[0] for r in d.where("vec_id > 898").orderBy("vec_id").select(V.is_valid(F.col("embedding"), 16)).collect()] == [True, False]
    assert math.isclose(d.where("vec_id = 1").select(V.norm(V.unit(F.col("embedding")))).first()[0], 1.0)


def test_approximate_search_deals_a_hot_cell_in_blocks(spark):
    g = np.random.default_rng(4)
    rows = [(k, [1.0] * 8) for k in range(200)] + [(k, [float(x) for x in g.normal(size=8)]) for k in range(200, 400)]
    d = spark.createDataFrame(rows + [(900, [0.0] * 8), (901, None), (902, [1.0, 2.0])], "vec_id long, embedding array<double>")
    q = d.where("vec_id % 20 = 0").withColumnRenamed("vec_id", "query_id")
    pairs = lambda x: {(r["query_id"], r["vec_id"], r["rank"]) for r in x.collect()}
    eight = d.where("size(embedding) = 8")
    assert pairs(V.approximate_nearest(q, d, 10, probes=1.0, block=16)) == pairs(V.nearest(q, eight, 10))
    none = V.approximate_nearest(q, d.where("vec_id > 950"), 10)
    assert none.columns == ["query_id", "vec_id", "score", "rank"] and none.count() == 0


def test_recall_of_the_approximate_query(spark):
    from postwright.plans import texts

    found, exact = [{(r["query_id"], r["vec_id"]) for r in f(spark, "/root/testdata/sf0.01").collect()} for f in (texts.knn_approximate, texts.knn_exact)]
    assert len(found & exact) >= 0.9 * len(exact)


def test_encoder_failures_stay_in_their_batch(spark):
    d = spark.createDataFrame([(k, "bad" if k == 3 else "ok") for k in range(8)], "job_id long, text string").coalesce(1)

    def encoder(texts):
        if "bad" in texts:
            raise ValueError("no")
        return np.ones((len(texts), 4), dtype=np.float32)

    r = {x["job_id"]: x["error"] for x in V.encode(d, encoder, batch=2).collect()}
    assert [k for k, e in sorted(r.items()) if e] == [2, 3]


def test_guards(spark):
    docs = spark.createDataFrame([(1, "uses Python", 1)], "doc_id long, text string, n_pages int")
    s = spark.createDataFrame([("Python", 5), ("SQL", 6)], "canonical string, skill_id long")
    rows = [
        (1, 1, "skill", 0.9, "Python", None, 5, 11, "Python", None), (2, 1, "skill", 0.9, "Python", 5, 5, 11, "Python", None), (3, 1, "skill", 0.9, "Cobol", None, 5, 11, "Python", None),
        (4, 1, "skill", 2.0, "SQL", None, 5, 11, "Python", None), (5, 1, "skill", 0.9, "SQL", 9, 5, 11, "Python", None), (6, 1, "skill", 0.9, "SQL", None, 5, 99, "Python", None),
        (7, 1, "skill", 0.9, "SQL", None, 0, 4, "Python", None), (8, 1, "skill", 0.9, "SQL", None, 0, 4, "nope", None), (9, 1, "role", 0.9, "SQL", None, 0, 4, "uses", None), (10, 1, "skill", 0.9, "SQL", None, 0, 4, "uses", 3),
        (11, 1, "skill", 0.9, "SQL", None, 0, 4, "system prompt", None), (12, 1, "skill", 0.9, None, None, 0, 4, "uses", None),
    ]
    c = spark.createDataFrame(rows, "cand_id int, doc_id long, fact_type string, confidence double, canonical string, skill_id long, start int, end int, quote string, page int")
    got = {r["cand_id"]: r["status"].removeprefix("rejected_") for r in guards.judged_candidates(c, docs, s, c.where("false").select("doc_id", "canonical")).collect()}
    assert got == {1: "accepted", 2: "duplicate", 3: "unknown_skill", 4: "confidence", 5: "unknown_skill", 6: "invalid_offset", 7: "evidence_mismatch", 8: "no_evidence", 9: "unsupported_fact_type", 10: "invalid_offset", 11: "prompt_injection", 12: "schema"}
    r = spark.createDataFrame([(1, 1, 100), (1, 2, 5000)], "doc_id long, role_id int, anchor int")
    d = spark.createDataFrame([(1, 90, "a"), (1, 300, "b")], "doc_id long, start int, range string")
    assert [tuple(x) for x in guards.nearest_dates(r, d).collect()] == [(1, 1, "a", 10)]
    e = spark.createDataFrame([(1, 1, "master/mba", 2020), (1, 2, "bachelor/licence", 2024)], "profile_id int, entry_id int, level string, year int")
    assert tuple(guards.best_education(e).first()) == (1, "master/mba", 2020)


def test_resume_parts(spark):
    one = lambda f, x: spark.createDataFrame([(x,)], "x string").select(f(F.col("x"))).first()[0]
    assert one(resumes.clean_text, "P y t h o n  d e v\r\nplain line") == "Python dev\nplain line"
    q = spark.range(1).select(resumes.extraction_quality(F.lit(5), F.lit(True), F.lit(True), F.lit(True), F.lit(6), F.lit(1.0), F.lit(False))).first()[0]
    assert (q["score"], q["label"]) == (0.95, "high")
    low = spark.range(1).select(resumes.extraction_quality(F.lit(5), F.lit(True), F.lit(False), F.lit(True), F.lit(6), F.lit(1.0), F.lit(False))).first()[0]
    assert (low["score"], low["label"]) == (0.39, "low")
    d = spark.createDataFrame([(1, {"a": 1}, "secret")], "id int, m map<string,int>, text string").withColumn("s", F.struct(F.lit(1).alias("k"), F.col("text")))
    assert resumes.redacted(d).columns == ["id", "m", "s"] and resumes.redacted(d).schema["s"].dataType.names == ["k"]


def test_curation(spark):
    d = spark.createDataFrame([(1, "Same text"), (2, "Same text"), (3, "same  TEXT")], "doc_id long, text string")
    assert curation.duplicate_groups(d, F.col("text")).first()["copies"] == 2
    assert curation.duplicate_groups(d, curation.text_key(F.col("text"))).first()["copies"] == 3
    i = spark.createDataFrame([("cv1", "a"), ("cv1", "b"), ("cv2", "a")], "item string, split string")
    assert [tuple(r) for r in curation.leakage(i).collect()] == [("cv1", 2, "a,b")]
    m = spark.createDataFrame([("f1", 0.5)], "metric string, value double")
    assert curation.gate_failures(m, spark.createDataFrame([("f1", 0.9), ("x", 0.1)], "metric string, threshold double")).count() == 2
    long = " ".join(f"w{k}" for k in range(60))
    n = spark.createDataFrame([(1, long), (2, long.replace("w30", "z")), (3, long), (4, "other words entirely here now ok"), (5, None)], "doc_id long, text string")
    assert sorted(tuple(r) for r in curation.near_duplicate_groups(n).collect()) == [(1, 1), (2, 1), (3, 1)]
    f = spark.createDataFrame([("/d/ds1/a.PDF", 10), ("/d/ds1/b.pdf", 5), ("/d/ds2/c", 1)], "path string, length long")
    assert sorted(tuple(r) for r in curation.inventory(f).collect()) == [("ds1", "pdf", 2, 15), ("ds2", "", 1, 1)]


def seller(spark, skills=("Negotiation",), domains=("Sales",)):
    return spark.createDataFrame([(1, list(skills), "mid", 5.0, list(domains), None, None, None)], PROFILE)


def test_technical_jobs_are_hidden_from_business_profiles(spark):
    j = spark.createDataFrame(
        [job(1, ["Negotiation"], title="Ingénieur commercial"), job(2, ["Negotiation"], title="Sales manager"), job(3, ["Negotiation", "AWS"], title="Account manager"),
         job(4, ["Negotiation"], title="Consultant", domains=["Cloud"]), job(5, ["Negotiation"], title="Editing"), job(6, ["Negotiation"], title=None)], JOB)
    c = j.select(F.lit(1).cast("long").alias("profile_id"), "job_id", F.lit(1).cast("long").alias("overlap"))
    shown = lambda p: sorted(r["job_id"] for r in matching.ranked(matching.scored(c, p, j), 10).collect())
    assert shown(seller(spark)) == [2, 5, 6]
    assert shown(seller(spark, ["Negotiation", "AWS"])) == [1, 2, 3, 4, 5, 6]
    assert shown(seller(spark, domains=["Research"])) == [1, 2, 3, 4, 5, 6]


def test_covered_skills_are_no_gaps(scene, spark):
    p = spark.createDataFrame([(1, ["Python"], "unknown", None, ["AI", "Données"], None, None, None), (2, ["Python"], "unknown", None, [], None, None, None)], PROFILE)
    index = spark.createDataFrame([("ai", "Artificial Intelligence"), ("donnees", "Data Science")], "folded string, canonical string")
    j = spark.createDataFrame([job(1, ["Artificial Intelligence", "Data Science", "Python", "SQL"])], JOB)
    c = spark.createDataFrame([(1, 1, 1), (2, 1, 1)], "profile_id long, job_id long, overlap long")
    rows = {r["profile_id"]: r for r in matching.scored(c, matching.with_covered(p, index), j).collect()}
    assert rows[1]["missing"] == ["SQL"] and rows[2]["missing"] == ["Artificial Intelligence", "Data Science", "SQL"]
    assert rows[1]["matched"] == rows[2]["matched"] == ["Python"] and rows[1]["coverage"] == rows[2]["coverage"]


def test_contract_wish_before_and_after_the_top(scene, spark):
    p, j, c = scene
    kinds = F.when(F.col("job_id") == 10, None).when(F.col("job_id") == 12, "CDI").otherwise("cdd")
    rows = matching.scored(c, p, j.withColumn("contract_type", kinds))
    wish = spark.createDataFrame([(1, "cdi")], "profile_id long, contract_type string")
    ids = lambda d: [r["job_id"] for r in d.orderBy("rank").collect()]
    assert ids(matching.ranked(matching.of_contract(rows, wish), 1)) == [12]
    assert ids(matching.of_contract(matching.ranked(rows, 1), wish)) == []
    assert ids(matching.of_contract(matching.ranked(rows, 3), wish.where("false"))) == [10, 11, 12]


def test_caution_numbers_again(spark):
    rows = spark.createDataFrame([(1, 7, 1, 10.0, "low"), (1, 5, 2, 9.0, "low"), (1, 6, 3, 40.0, "low"), (2, 7, 1, 10.0, "high"), (2, 5, 2, 30.0, "high")], "profile_id long, job_id long, rank int, final_score double, p_quality_label string")
    rows = rows.withColumn("penalties", F.expr("cast(array() as array<struct<code: string, amount: double>>)"))
    got = {(r["profile_id"], r["job_id"]): (r["rank"], r["final_score"]) for r in matching.cautioned(rows).collect()}
    assert got == {(1, 6): (1, 25.0), (1, 5): (2, 0.0), (1, 7): (3, 0.0), (2, 7): (1, 10.0), (2, 5): (2, 30.0)}


def test_only_plain_business_profiles_are_out_of_scope(spark):
    rows = [(1, ["Negotiation"], ["Sales"], []), (2, ["Negotiation"], [], []), (3, [], ["Sales", "Cloud"], []), (4, ["Python"], ["Sales"], []), (5, [], [], ["Finance"]), (6, [], ["Law"], ["Operations"]), (7, [], None, None)]
    p = spark.createDataFrame(rows, "profile_id long, skills array<string>, domains array<string>, roles array<string>")
    s = spark.createDataFrame([("Negotiation", "soft_skill"), ("Python", "language")], "canonical string, category string")
    assert sorted(r["profile_id"] for r in matching.in_scope(p, s).collect()) == [2, 3, 4, 6, 7]


def test_questions_have_topics_and_routes(spark):
    asked = {
        "How does job matching use semantic search?": ("matching", "platform"), "quality report please": ("cv_improve_quality", "platform"), "Which data source is it?": ("corpus_data_source", "platform"),
        "who are you": ("chat_assistant", "platform"), "plus demander": (None, "sql"), "salaire": (None, "unresolved"), "en moyenne": (None, "sql"), "hello": (None, "unresolved"),
    }
    d = spark.createDataFrame([(q,) for q in asked], "q string")
    assert {r["q"]: (r["t"], r["r"]) for r in d.select("q", guards.topic(F.col("q")).alias("t"), guards.route(F.col("q")).alias("r")).collect()} == asked


def shuffled(spark):
    """Bytes that all stages of the session have given to shuffles."""
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    stages = spark.sparkContext._jsc.sc().statusStore().stageList(None, False, False, spark.sparkContext._gateway.new_array(spark.sparkContext._jvm.double, 0), None)
    return sum(stages.apply(k).shuffleWriteBytes() for k in range(stages.size()))


def test_near_duplicates_shuffle_texts_once(spark):
    """Sets stay where the texts are, but for those of candidates."""
    words = F.expr("array_join(transform(sequence(1, 400), k -> concat('w', xxhash64(k, if(id >= 990, 990, id)))), ' ')")
    d = spark.range(1000).select(F.col("id").alias("doc_id"), F.concat(words, F.when(F.col("id") >= 990, F.concat(F.lit(" "), "id")).otherwise("")).alias("text"))
    was = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        size, before = d.agg(F.sum(F.length("text"))).first()[0], shuffled(spark)
        assert sorted(tuple(r) for r in curation.near_duplicate_groups(d).collect()) == [(k, 990) for k in range(990, 1000)]
        assert shuffled(spark) - before < 1.25 * size
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", was)


def test_near_duplicates_lose_no_link(spark, sf_dir, monkeypatch):
    """Pairs within a family that shares a passage with them, but too little to link with them, and the given texts, against all pairs."""
    monkeypatch.setattr(curation, "BLOCK", 7, raising=False)
    run = lambda name, n: " ".join(f"{name}x{k}" for k in range(n))
    family = [(1_000_000 + k, f"{run('Core', 104)} {run(f'pair{k // 2}', 10)}\n{run(f'own{k}', 12)}") for k in range(80)]
    given = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]
    rows = [*family, *given, (2_000_000, None), (2_000_001, " "), (2_000_002, "one two"), (2_000_003, "One  two"), (2_000_004, "one")]
    sets = {}
    for k, text in rows:
        w = re.findall(r"[^\x20\t-\r]+", (text or "").lower())
        sets[k] = {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()
    up = {k: k for k in sets}

    def root(k):
        return k if up[k] == k else root(up[k])

    for a, b in combinations(sorted(k for k in sets if sets[k]), 2):
        if min(len(sets[a]), len(sets[b])) >= 0.8 * max(len(sets[a]), len(sets[b])) and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]):
            low, high = sorted((root(a), root(b)))
            up[high] = low
    groups = Counter(root(k) for k in sets)
    got = curation.near_duplicate_groups(spark.createDataFrame(rows, "doc_id long, text string").repartition(4))
    assert sorted(map(tuple, got.collect())) == sorted((k, root(k)) for k in sets if groups[root(k)] > 1)
    assert groups[1_000_000] == 2 and groups[2_000_002] == 2


def test_postings_of_rare_skills_are_shuffled_twice(spark):
    """Once as counts and once as they are, and no more to make them distinct or to count jobs."""
    p = spark.range(50).selectExpr("id AS profile_id", "id * 7 AS skill")
    j = spark.range(60_000).selectExpr("xxhash64(id div 3) AS job_id", "id % 20000 AS skill").repartition(8)
    was = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        before = shuffled(spark)
        j.groupBy("job_id", "skill").count().collect()
        once, before = shuffled(spark) - before, shuffled(spark)
        assert matching.lexical_candidates(p, j, 10).count() == 150
        assert shuffled(spark) - before < 2.7 * once
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", was)


def test_scored_rows_are_ranked_where_they_lie(scene, spark):
    """Candidates go to their job and then to their profile, where they are ranked without another shuffle."""
    p, j, _ = scene
    c = spark.createDataFrame([(1, 10, 2), (1, 12, 1)], "profile_id long, job_id long, overlap long")
    was = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        d = matching.ranked(matching.scored(c, p, j), 10)
        plan = d._jdf.queryExecution().executedPlan().toString()
        assert plan.split("Final Plan")[0].count("hashpartitioning(profile_id") == 2
        assert [r["job_id"] for r in d.orderBy("rank").collect()] == [10, 12]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", was)


def test_exact_search_is_spread_and_meets_all_vectors(spark, monkeypatch):
    """One file of vectors goes to all tasks; in small products, with copies, blank and odd vectors, the best are those of a full sort."""
    monkeypatch.setattr(V, "ASKED", 3, raising=False)
    monkeypatch.setattr(V, "SLICE", 7)
    monkeypatch.setattr(V, "QUERY_BLOCK", 5)
    g = np.random.default_rng(9)
    v = g.normal(size=(200, 8))
    v[50:90] = v[10]
    v[120] = 0
    odd = [(900, None), (901, [1.0]), (902, [math.nan] * 8)]
    d = spark.createDataFrame([(k, [float(x) for x in v[k]]) for k in range(200)] + odd, "vec_id long, embedding array<double>").coalesce(1)
    q = d.where("vec_id % 20 = 10").withColumnRenamed("vec_id", "query_id")
    n = np.linalg.norm(v, axis=1)
    ids = np.flatnonzero(n > 0)
    u = v[ids] / n[ids, None]
    want = [(k, int(ids[x]), r) for k in range(10, 200, 20) for r, x in enumerate(np.argsort(-np.round(u @ (v[k] / n[k]), 12), kind="stable")[:30], 1)]
    assert sorted((r["query_id"], r["vec_id"], r["rank"]) for r in V.nearest(q, d, 30).collect()) == sorted(want)
    monkeypatch.setattr(V, "QUERY_BLOCK", 100)
    plan = V.nearest(q, d, 30)._jdf.queryExecution().optimizedPlan().toString()
    assert f"Repartition {spark.sparkContext.defaultParallelism}, true" in plan.split("MapInPandas")[1]
