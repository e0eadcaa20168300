import datetime
import json

import pytest
from pyspark.sql import functions as F

from postwright.functions import text as T
from postwright.operators import dedup, parse
from postwright.sources import boards, exports
from postwright.streaming.ingest import ingest_stream

ADZUNA = {
    "id": "a1", "title": "Senior Data Scientist (m/f/d)", "description": "<p>First paragraph.</p><p>R&amp;D and more</p>", "company": {"display_name": "ACME Analytics"},
    "location": {"display_name": "Paris, France", "area": ["France", "Paris"]}, "salary_min": 50000.0, "salary_max": 60000.0, "salary_is_predicted": "1",
    "contract_time": "full_time", "created": "2024-03-01T10:00:00Z", "redirect_url": "http://a/1",
}
JOOBLE = {"title": "Data Engineer", "company": "Tech Solutions GmbH", "location": "Berlin, Germany", "snippet": "Short.", "salary": "€70,000 - €90,000", "type": "Full-time", "link": "http://j/1", "updated": "2024-03-01T10:00:00"}
REMOTE = {"id": 7, "position": "Backend Engineer", "company": "Remote Co", "description": "Text", "salary_min": "80000", "salary_max": "120,000", "epoch": "1710000000", "url": "http://r/7"}


def raw(spark, rows):
    return spark.createDataFrame([(k, s, str(k), p if isinstance(p, str) else json.dumps(p)) for k, (s, p) in enumerate(rows)], "raw_job_id long, source string, source_id string, payload string")


def test_boards_parse(spark):
    ok, bad = parse.parse(raw(spark, [("adzuna", ADZUNA), ("remoteok", REMOTE), ("jooble", JOOBLE), ("jooble", {"title": " "}), ("adzuna", "{broken"), ("remoteok", {"title": "x"})]))
    got = {r["source"]: r for r in ok.collect()}
    a, j, r = got["adzuna"], got["jooble"], got["remoteok"]
    assert (a["country"], a["city"], a["salary_is_predicted"], a["contract_type"], a["salary_currency"]) == ("fr", "Paris", True, "full_time", None)
    assert a["description"] == "First paragraph.\n\nR&D and more"
    assert (j["country"], j["city"], j["salary_min"], j["salary_max"], j["salary_currency"]) == ("de", "Berlin", 70000.0, 90000.0, "EUR")
    assert (r["is_remote"], r["salary_min"], r["salary_max"], r["salary_currency"]) == (True, 80000.0, 120000.0, "USD")
    assert r["posted_at"] == datetime.datetime(2024, 3, 9, 16, 0)
    assert sorted(x["reason"] for x in bad.collect()) == ["missing company", "missing title", "missing title"]
    assert {x["source"]: (x["parsed_count"], x["failed_count"]) for x in parse.parse_summary(ok, bad).collect()} == {"adzuna": (1, 1), "jooble": (1, 1), "remoteok": (1, 1)}


def test_adzuna_numbers_must_be_numbers(spark):
    ok, _ = parse.parse(raw(spark, [("adzuna", {**ADZUNA, "salary_min": "50000", "salary_max": None, "company": {}})]))
    r = ok.first()
    assert r["salary_min"] is None and r["salary_period"] is None and r["company_name"] == "Unknown"


@pytest.mark.parametrize(("f", "x", "want"), [
    (T.title_key, "Senior Data Scientist (m/f/d)", "data scientist"), (T.title_key, "Jr. Backend Engineer", "backend engineer"), (T.title_key, "python 3.11", "python 3 11"),
    (T.company_key, "ACME Sarl.", "acme"), (T.company_key, "Example Corp Ltd", "example"), (T.company_key, "Tech Solutions GmbH", "tech solutions"),
    (T.mend_mojibake, "fÃºtbol con pasiÃ³n", "fútbol con pasión"), (T.mend_mojibake, "café", "café"), (T.mend_mojibake, "10 €", "10 €"),
    (T.plain_text, "<p>First paragraph.</p><p>Second paragraph.</p>", "First paragraph.\n\nSecond paragraph."), (T.plain_text, "Join our R&D", "Join our R&D"), (T.plain_text, "a &eacute;&amp;amp; b", "a é&amp; b"),
    (T.optional, "  ", None), (T.optional, "\t x \n", "x"), (T.number, "80,000.5", 80000.5), (T.number, "abc", None), (T.iso_time, "bad", None), (T.epoch_time, "x", None),
    (lambda c: T.iso_country(c, parse.ADZUNA_COUNTRIES), "UK", "gb"), (lambda c: T.iso_country(c, parse.ADZUNA_COUNTRIES), "PT", "pt"), (lambda c: T.iso_country(c, parse.ADZUNA_COUNTRIES), "Narnia", None),
])
def test_text_values(spark, f, x, want):
    assert spark.createDataFrame([(x,)], "x string").select(f(F.col("x"))).first()[0] == want


def test_salary_bounds(spark):
    d = spark.createDataFrame([(50000.0, None), (None, 80000.0)], "a double, b double")
    p = T.whole_salary(F.col("a"), F.col("b"), F.lit("eur"), F.lit("YEAR"))
    assert [tuple(r) for r in d.select(*p.values()).collect()] == [(50000.0, 50000.0, "EUR", "year"), (80000.0, 80000.0, "EUR", "year")]


def test_landed_pages(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps({"results": [{"id": 1}, {"title": "no id"}]}))
    assert [r["source_id"] for r in boards.adzuna_rows(boards.pages(spark, str(tmp_path))).collect()] == ["1"]
    d = spark.createDataFrame([(json.dumps([{"legal": 1, "id": 0}, {"id": 5}, 3]),)], "page string")
    assert [r["source_id"] for r in boards.remoteok_rows(d).collect()] == ["5"]
    ok, bad = boards.jooble_rows(spark.createDataFrame([(json.dumps({"jobs": [{"id": "x"}, {"id": "", "link": " http://l "}, {}]}),)], "page string"))
    assert sorted(len(r["source_id"]) for r in ok.collect()) == [1, 64] and bad.count() == 1


def test_append_is_idempotent(spark, tmp_path):
    d = spark.createDataFrame([(1, "a", "x", "p", None), (2, "a", "x", "q", None), (3, "b", "x", "r", None)], boards.RAW_SCHEMA)
    target = str(tmp_path / "raw")
    assert boards.append_new(d, target, "raw_job_id") == 2
    assert boards.append_new(d, target, "raw_job_id") == 0
    assert sorted(r["raw_job_id"] for r in spark.read.parquet(target).collect()) == [1, 3]


def test_stream_appends_each_key_once(spark, tmp_path):
    d = spark.createDataFrame([(1, "a", "x", "p", None), (2, "a", "y", "q", None)], boards.RAW_SCHEMA)
    landed, target = str(tmp_path / "landed"), str(tmp_path / "raw")
    for _ in range(2):
        d.write.mode("append").parquet(landed)
        ingest_stream(spark, landed, boards.RAW_SCHEMA, target, str(tmp_path / "checkpoint")).awaitTermination()
    assert spark.read.parquet(target).count() == 2


def test_dedup_across_boards(spark):
    rows = [(1, "a", "Senior Data Scientist", "ACME Sarl", "first", None, "fr"), (2, "b", "Data Scientist", "ACME", "second", "u", "fr"), (3, "b", "Data Scientist", "Other", "x", None, "fr")]
    d = spark.createDataFrame(rows, "raw_job_id long, source string, title string, company_name string, description string, url string, country string")
    for c, kind in (("location_raw", "string"), ("city", "string"), ("is_remote", "boolean"), ("contract_type", "string"), ("salary_min", "double"), ("salary_max", "double"), ("salary_currency", "string"), ("salary_period", "string"), ("salary_is_predicted", "boolean"), ("posted_at", "timestamp")):
        d = d.withColumn(c, F.lit(None).cast(kind))
    k = dedup.with_keys(d)
    j = dedup.jobs(k)
    got = {r["job_id"]: r for r in j.collect()}
    assert set(got) == {1, 3} and got[1]["url"] == "u" and got[1]["description"] == "second"
    assert sorted(tuple(r) for r in dedup.links(k, j).collect()) == [(1, 1), (1, 2), (3, 3)]
    assert {r["name_norm"]: r["name"] for r in dedup.companies(k).collect()} == {"acme": "ACME Sarl", "other": "Other"}


def test_exports(spark, tmp_path):
    d = spark.createDataFrame([(1, "a"), (2, "b")], "run_id int, v string")
    exports.write_csv(d, str(tmp_path / "csv"))
    assert spark.read.csv(str(tmp_path / "csv"), header=True).count() == 2
    exports.write_partition(d, str(tmp_path / "runs"))
    exports.write_partition(d.where("run_id = 2").withColumn("v", F.lit("c")), str(tmp_path / "runs"))
    assert {r["run_id"]: r["v"] for r in spark.read.parquet(str(tmp_path / "runs")).collect()} == {1: "a", 2: "c"}


def test_pages_against_unescape(spark):
    import html

    from postwright.functions import text

    pages = ["<p>Caf&eacute; &amp; bar</p><p>1 &lt; 2</p>", "<div>a&#233;b</div><br>c &quot;d&quot;", "plain &euro; text"]
    brute = lambda p: [" ".join(html.unescape(x).split()) for x in __import__("re").split(r"<[^>]+>", p) if x.strip()]
    d = spark.createDataFrame([(p,) for p in pages], "p string")
    for r in d.select("p", text.plain_text(F.col("p")).alias("t")).collect():
        assert r["t"].split("\n\n") == brute(r["p"])


def test_fold_takes_off_any_mark(spark):
    from postwright.functions import text

    words = {"Dvořák": "dvorak", "ŁÓDŹ": "łodz", "Nguyễn": "nguyen", "naïve Straße": "naive straße", "x²": "x2"}
    d = spark.createDataFrame([(w,) for w in words], "w string")
    assert {r["w"]: r["f"] for r in d.select("w", text.fold(F.col("w")).alias("f")).collect()} == words


def test_payloads_are_parsed_once(spark):
    """A payload is parsed once by its board, however many fields and filters name its parts."""
    plan = parse.parse(raw(spark, [("adzuna", ADZUNA)]))[0]._jdf.queryExecution().optimizedPlan().toString()
    assert plan.lower().replace("_", "").count("parsejson") == 3


def test_rare_texts_go_one_by_one(spark):
    """No Arrow batch of whole pages is held by a worker."""
    d = spark.createDataFrame([("<p>a &eacute; ﬁ</p>",), (None,), ("<b>x</b> &amp; y",)], "x string").select(T.plain_text(F.col("x")).alias("t"))
    assert [r[0] for r in d.collect()] == ["a é fi", None, "x & y"]
    plan = d._jdf.queryExecution().executedPlan().toString()
    assert "ArrowEvalPython" not in plan and "BatchEvalPython" in plan
