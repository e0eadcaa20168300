import pytest
from pyspark.sql import functions as F

from postwright.operators import audit, enrich, ontology, skillmatch

TINY = [
    ("Java", "language", [], None), ("JavaScript", "language", ["js"], None), ("R", "language", [], None), ("C", "language", ["langage c"], None),
    ("Artificial Intelligence", "ml_ai", ["ai", "ia", "intelligence artificielle"], None), ("CI/CD", "devops", ["ci", "cd", "ci/cd"], None), ("Go", "language", ["golang"], None),
    ("Python", "language", ["python3"], None), ("Kubernetes", "devops", ["k8s"], None), ("Cybersecurity", "other", ["cybersécurité"], None), ("Chef", "devops", [], None),
]
TEXTS = {
    "We use Java and Python.": {"Java", "Python"},
    "We use JavaScript for the frontend.": {"JavaScript"},
    "Python, R, SQL required.": {"Python", "R"},
    "(R) is a plus": set(),
    "CI/CD, R/Python": {"CI/CD", "R", "Python"},
    "Notre service R&D innove sans cesse.": set(),
    "Python, Go, Rust required.": {"Python", "Go"},
    "go-getter attitude wanted": set(),
    "CYBERSÉCURITÉ avancée.": {"Cybersecurity"},
    "intelligence\n  artificielle": {"Artificial Intelligence"},
    "AI engineer": {"Artificial Intelligence"},
    "ai engineer": set(),
    "Chef d'equipe": set(),
    "Ansible, Chef and more": {"Chef"},
    "": set(),
}


@pytest.fixture(scope="module")
def skills(spark):
    return spark.createDataFrame(TINY, "canonical string, category string, aliases array<string>, parent string")


def test_matcher_table(spark, skills):
    docs = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string")
    got = {}
    for r in skillmatch.matches(docs, skills).collect():
        got.setdefault(r["doc_id"], set()).add(r["canonical"])
        text = list(TEXTS)[r["doc_id"]]
        assert text[r["start"] : r["end"]] == r["evidence"]
    assert {k: got.get(k, set()) for k in range(len(TEXTS))} == dict(enumerate(TEXTS.values()))


def test_offsets_are_code_points(spark, skills):
    docs = spark.createDataFrame([(1, "😀 Straße team uses Python"), (2, None)], "doc_id long, text string")
    r = skillmatch.matches(docs, skills).collect()
    assert [("😀 Straße team uses Python"[x["start"] : x["end"]], x["doc_id"]) for x in r] == [("Python", 1)]


def test_fields_and_failures(spark):
    s = spark.createDataFrame([("Data Lake", "data", [], None), ("Python", "language", [], None)], "canonical string, category string, aliases array<string>, parent string")
    j = spark.createDataFrame([(1, "Python dev", "uses a data  lake"), (2, "Senior data", "lake and Python"), (3, None, None)], "job_id long, title string, description string")
    found, failed = skillmatch.posting_matches(j, s)
    got = {(r["job_id"], r["canonical"]): (r["evidence_field"], r["start"], r["end"], r["evidence"]) for r in found.collect()}
    assert got == {(1, "Python"): ("title", 0, 6, "Python"), (1, "Data Lake"): ("description", 7, 17, "data  lake")}
    assert [r["job_id"] for r in failed.collect()] == [2]
    led = {r["job_id"]: (r["status"], r["skill_count"]) for r in enrich.ledger(1, j, found, failed).collect()}
    assert led == {1: ("success", 2), 2: ("failed", 0), 3: ("success", 0)}


def test_ontology_checks(spark, skills):
    assert ontology.alias_conflicts(ontology.alias_index(skills)).count() == 0
    bad = spark.createDataFrame([("A", "language", ["x"], "Z"), ("B", "nope", ["X "], None), ("A", "language", [], None)], skills.schema)
    assert [r["folded"] for r in ontology.alias_conflicts(ontology.alias_index(bad)).collect()] == ["x"]
    assert sorted((r["canonical"], r["problem"]) for r in ontology.violations(bad).collect()) == [("A", "duplicate"), ("A", "unknown_parent"), ("B", "unknown_category")]
    a, b = ontology.version(skills).first()[0], ontology.version(skills.orderBy(F.desc("canonical"))).first()[0]
    assert a == b and len(a) == 64


def test_runs(spark):
    led = spark.createDataFrame([(1, 10, "success", 2), (1, 11, "success", 0), (1, 12, "failed", 0)], "run_id int, job_id int, status string, skill_count int")
    c = enrich.counters(led).first()
    assert (c["processed"], c["succeeded"], c["failed"], c["with_skills"], c["zero_skill"]) == (3, 2, 1, 1, 1)
    status = lambda t, p, s, f: spark.range(1).select(enrich.run_status(*[F.lit(x) for x in (t, p, s, f)])).first()[0]
    assert [status(0, 0, 0, 0), status(3, 3, 3, 0), status(3, 3, 2, 1), status(3, 3, 0, 3)] == ["success", "success", "partial", "failed"]
    old = spark.createDataFrame([(1, 12, "match", 1, "old")], "run_id int, job_id int, stage string, attempts long, error string")
    new = spark.createDataFrame([(1, 12, "match", "new")], "run_id int, job_id int, stage string, error string")
    assert tuple(enrich.merged_failures(old, new).first()) == (1, 12, "match", 2, "new")


def test_evidence_violations(spark):
    jobs = spark.createDataFrame([(1, "Python dev", "")], "job_id long, title string, description string")
    s = spark.createDataFrame([("Python",)], "skill string")
    rows = [
        (1, 1, 1, "Python", "matcher", "python", "title", 0, 6, "Python"), (2, 1, 1, "Python", "matcher", "python", "title", 0, 6, "Python"), (3, 1, 9, "Python", "llm", "python", "title", 0, 6, "Python"),
        (4, 1, 1, "Nope", "llm", "x", "title", 0, 6, "Python"), (5, 2, 1, "Python", "llm", "python", "body", 0, 6, "Python"), (6, 3, 1, "Python", "llm", "python", "title", 5, 2, "Python"),
        (7, 4, 1, "Python", "llm", "python", "title", 0, 60, "Python"), (8, 5, 1, "Python", "llm", "py", "title", 0, 6, "pytho"),
    ]
    f = spark.createDataFrame(rows, "row_id int, run_id int, job_id long, skill string, method string, alias string, evidence_field string, start int, end int, evidence string")
    got = {}
    for r in audit.evidence_violations(f, jobs, s).collect():
        got.setdefault(r["row_id"], set()).add(r["violation"])
    assert got == {
        2: {"duplicate"}, 3: {"missing_job"}, 4: {"missing_skill"}, 5: {"invalid_evidence_field"}, 6: {"invalid_offsets"}, 7: {"offset_out_of_range"}, 8: {"evidence_text_mismatch", "matched_alias_mismatch"},
    }


def test_fixed_values(spark):
    from postwright.operators import audit, resumes

    assert sorted(ontology.CATEGORIES) == ["cloud", "database", "domain", "framework", "language", "methodology", "platform", "soft_skill", "tool"]
    skills = spark.createDataFrame([(c, c, [], None) for c in [*ontology.CATEGORIES, "other"]], "canonical string, category string, aliases array<string>, parent string")
    assert [tuple(r) for r in ontology.violations(skills).collect()] == [("other", "unknown_category")]
    words = {"Notion": True, "monday": True, "Tableau": True, "Jira": True, "Spark": False, "Excel": False, "Rust": False, "rag": True, "LLMOP": True, "12345": False, "C++17x": True, "Docker": False, "NLP": True}
    d = spark.createDataFrame([(w,) for w in words], "w string")
    assert {r["w"]: r["a"] for r in d.select("w", audit.is_ambiguous(F.col("w")).alias("a")).collect()} == words
    said = {"500+ users": True, "3+ clients onboarded": True, "12 %": True, "€ 40k": True, "many users": False, "phase 2+": False}
    d = spark.createDataFrame([(w,) for w in said], "w string")
    assert {r["w"]: r["m"] for r in d.select("w", F.col("w").rlike(resumes.METRIC).alias("m")).collect()} == said


def test_terms_of_several_words_are_context(spark):
    skills = spark.createDataFrame([("Business Intelligence", "domain", ["BI"], None), ("Machine Learning", "domain", ["ML"], None)], "canonical string, category string, aliases array<string>, parent string")
    docs = spark.createDataFrame([(1, "BI, Power BI"), (2, "BI and sailing"), (3, "ML, deep learning"), (4, "bi data"), (5, "ML for cats")], "doc_id long, text string")
    assert sorted((r["doc_id"], r["evidence"]) for r in skillmatch.matches(docs, skills).collect()) == [(1, "BI"), (3, "ML")]


QUALITY = [
    ("Artificial Intelligence", "domain", ["ai", "ia", "ki", "intelligence artificielle", "kunstliche intelligenz", "artificial intelligence"], None), ("Chef", "tool", ["chef"], None),
    ("Machine Learning", "domain", ["ml", "machine learning", "apprentissage automatique"], None), ("Business Intelligence", "domain", ["bi", "business intelligence"], None), ("C", "language", ["langage c"], None),
    ("C++", "language", ["cpp"], None), ("Python", "language", ["python3"], None), ("SAP", "platform", ["sap"], None), ("GCP", "cloud", ["gcp", "google cloud"], None), ("Google Vertex AI", "platform", ["vertex ai"], None),
    ("Large Language Models", "domain", ["llm", "llms"], None), ("Retrieval-Augmented Generation", "domain", ["rag"], None), ("Data Science", "domain", ["data science", "data scientist"], None),
]
# The evaluation set of the matcher: text, skills that it must find, skill that it must not find.
EVALUATION = [
    ("AI Engineer position open.", {"Artificial Intelligence"}, None), ("The main point is available in the appendix.", set(), "Artificial Intelligence"), ("Poste en IA et machine learning.", {"Artificial Intelligence"}, None),
    ("J'ai d?velopp? des mod?les d'IA.", set(), "Artificial Intelligence"), ("Automate infrastructure with Chef recipes.", {"Chef"}, None), ("Chef de Projet Data Scientist", set(), "Chef"),
    ("Sous l'autorit? du chef de projet en charge.", set(), "Chef"), ("Senior Data Scientist / ML Engineer", {"Machine Learning"}, None), ("Ce poste est calme et autonome.", set(), "Machine Learning"),
    ("Lead Data Scientist - BI Prediction", {"Business Intelligence"}, None), ("Nous cherchons une personne bienveillante.", set(), "Business Intelligence"), ("Core product in C/C++ and Python.", {"C", "C++", "Python"}, None),
    ("C'est une entreprise innovante.", set(), "C"), ("Consultant SAP BW data platform.", {"SAP"}, None), ("Une sape ancienne dans le processus.", set(), "SAP"), ("Cloud GCP / Vertex AI platform.", {"GCP", "Google Vertex AI"}, None),
    ("Projects around LLM, RAG and modern AI architectures.", {"Artificial Intelligence", "Large Language Models", "Retrieval-Augmented Generation"}, None), ("Orientation LLM pour mod?les de langage.", {"Large Language Models"}, None),
    ("Data Scientist - Freelance", {"Data Science"}, None), ("Machine Learning Engineer", {"Machine Learning"}, None), ("AI Engineer F/H", {"Artificial Intelligence"}, None),
]


def test_evaluation_set(spark):
    skills = spark.createDataFrame(QUALITY, "canonical string, category string, aliases array<string>, parent string")
    docs = spark.createDataFrame([(k, t) for k, (t, _, _) in enumerate(EVALUATION)], "doc_id long, text string")
    got = {}
    for r in skillmatch.matches(docs, skills).collect():
        got.setdefault(r["doc_id"], set()).add(r["canonical"])
    for k, (text, must, never) in enumerate(EVALUATION):
        assert must <= got.get(k, set()) and never not in got.get(k, set()), text


def test_letters_that_expand(spark):
    skills = spark.createDataFrame([("Python", "language", [], None), ("Straße", "domain", [], None), ("Bureau", "tool", ["oﬃce suite"], None)], "canonical string, category string, aliases array<string>, parent string")
    texts = ["Straße team uses Python", "ﬃ STRASSE: office  suite, ½ python!", "á oﬃce suite İ Python", None, ""]
    docs = spark.createDataFrame([(1, t) for t in texts] + [(None, texts[0]), (None, texts[0])], "doc_id long, text string")
    got = sorted((str(r["doc_id"]), r["canonical"], r["evidence"]) for r in skillmatch.matches(docs, skills).collect())
    assert got == sorted([("1", "Straße", "Straße"), ("1", "Python", "Python"), ("1", "Straße", "STRASSE"), ("1", "Bureau", "office  suite"), ("1", "Python", "python"), ("1", "Bureau", "oﬃce suite"), ("1", "Python", "Python")] + [("None", "Straße", "Straße"), ("None", "Python", "Python")] * 2)
    for r in skillmatch.matches(docs.where("doc_id is null"), skills).collect():
        assert texts[0][r["start"] : r["end"]] == r["evidence"]


def test_hits_beyond_the_broadcast_and_without_exchange(spark, skills, monkeypatch):
    docs = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string")
    near = sorted(map(tuple, skillmatch.matches(docs, skills).collect()))
    plan = skillmatch.hits(docs, skillmatch.alias_table(skills))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == plan.count("BroadcastExchange") == 1
    monkeypatch.setattr(skillmatch, "BROADCAST_ALIASES", -1)
    assert sorted(map(tuple, skillmatch.matches(docs, skills).collect())) == near


def test_a_worker_holds_few_hits_and_postings_are_walked_once(spark, monkeypatch):
    skills = spark.createDataFrame([("Python", "language", ["py"], None), ("SQL", "language", [], None)], "canonical string, category string, aliases array<string>, parent string")
    docs = spark.createDataFrame([(1, "Python SQL " * 9), (2, None), (3, "PY"), (4, "")], "doc_id long, text string")
    whole = sorted(skillmatch.hits(docs, skillmatch.alias_table(skills)).drop("row").collect())
    monkeypatch.setattr(skillmatch, "HITS", 4)
    assert sorted(skillmatch.hits(docs, skillmatch.alias_table(skills)).drop("row").collect()) == whole and len(whole) == 19
    found, failed = skillmatch.posting_matches(docs.selectExpr("doc_id AS job_id", "text AS title", "'SQL' AS description"), skills)
    assert "MapInArrow" not in found._jdf.queryExecution().toString() + failed._jdf.queryExecution().toString()
