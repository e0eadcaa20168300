"""Queries of the reports, ledgers, deduplication and raw layer, with their SQL."""

from __future__ import annotations

import contextlib
import re
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from postwright.functions import text as T
from postwright.functions.session import shared_folder, tasks_for
from postwright.operators import analytics as A
from postwright.operators import audit, constraints, curation, dedup, enrich, matching, ontology
from postwright.plans import roles as R
from postwright.sources import boards

QUERIES, SQL = {}, {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql is not None:
            SQL[name] = sql
        return f

    return add


_BASE = f"WITH {R.JOBS_SQL}, {R.JOB_SKILLS_SQL}, {R.SKILLS_SQL}, {R.LEDGER_SQL}"


@query("skill_demand", f"""{_BASE}
SELECT skill, category, job_count, considered, round(job_count * 100.0 / considered, 1) AS percent FROM (
  SELECT skill, category, count(DISTINCT job_id) AS job_count FROM job_skills JOIN skills USING (skill_id) GROUP BY skill, category) c,
  (SELECT count(DISTINCT job_id) AS considered FROM jobs) t""")
def skill_demand(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.skill_demand(R.jobs(spark, sf_dir), R.job_skills(spark, sf_dir), R.skills(spark, sf_dir))


@query("skill_demand_top", f"""{_BASE}, chosen AS (SELECT * FROM jobs WHERE country = 'gb' AND title ILIKE '%senior%')
SELECT skill, category, job_count, considered, round(job_count * 100.0 / considered, 1) AS percent FROM (
  SELECT skill, category, count(DISTINCT job_id) AS job_count FROM job_skills JOIN skills USING (skill_id) WHERE job_id IN (SELECT job_id FROM chosen) GROUP BY skill, category) c,
  (SELECT count(DISTINCT job_id) AS considered FROM chosen) t ORDER BY job_count DESC, skill, category LIMIT 20""")
def skill_demand_top(spark: SparkSession, sf_dir: str) -> DataFrame:
    jobs = A.filtered_jobs(R.jobs(spark, sf_dir), country="gb", level="senior")
    return A.skill_demand(jobs, R.job_skills(spark, sf_dir), R.skills(spark, sf_dir), top=20)


@query("job_count", f"""{_BASE}
SELECT country, title, count(DISTINCT job_id) AS n FROM jobs WHERE contract_type = '1-URGENT' AND title ILIKE '%engineer%' GROUP BY country, title""")
def job_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    j = A.filtered_jobs(R.jobs(spark, sf_dir), contract="1-URGENT", title="engineer")
    return j.groupBy("country", "title").agg(F.count_distinct("job_id").alias("n"))


@query("skill_share", f"""{_BASE}
SELECT count(DISTINCT CASE WHEN skill = 'red widget' THEN j.job_id END) AS job_count, count(DISTINCT j.job_id) AS considered,
  round(count(DISTINCT CASE WHEN skill = 'red widget' THEN j.job_id END) * 100.0 / count(DISTINCT j.job_id), 1) AS percent
FROM jobs j LEFT JOIN (SELECT job_id, skill FROM job_skills JOIN skills USING (skill_id)) s ON j.job_id = s.job_id""")
def skill_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = R.job_skills(spark, sf_dir).join(R.skills(spark, sf_dir), "skill_id").where("skill = 'red widget'").select("job_id").distinct()
    j = R.jobs(spark, sf_dir).select("job_id").distinct()
    both = j.join(s.withColumn("has", F.lit(1)), "job_id", "left").agg(F.count("has").alias("job_count"), F.count("*").alias("considered"))
    return both.withColumn("percent", A.percent(F.col("job_count"), F.col("considered")))


@query("top_skills", f"""{_BASE}
SELECT skill, count(*) AS skill_rows, count(DISTINCT job_id) AS job_count FROM job_skills JOIN skills USING (skill_id)
GROUP BY skill ORDER BY job_count DESC, skill LIMIT 30""")
def top_skills(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.top_skills(R.job_skills(spark, sf_dir).join(R.skills(spark, sf_dir), "skill_id"))


@query("average_salary", f"""{_BASE}, v AS (
  SELECT (salary_min + salary_max) / 2 * CASE coalesce(salary_currency, CASE country WHEN 'gb' THEN 'GBP' WHEN 'us' THEN 'USD' END, 'EUR')
    WHEN 'GBP' THEN 1.17 WHEN 'USD' THEN 0.92 ELSE 1 END AS v FROM jobs
  WHERE salary_min IS NOT NULL AND salary_max IS NOT NULL AND NOT (salary_min = 0 AND salary_max = 0)
), r AS (SELECT v, row_number() OVER (ORDER BY v) - 1 AS i, count(*) OVER () AS n FROM v WHERE v >= 2000)
SELECT CAST(round_even(avg(v), 0) AS BIGINT) AS average_eur, count(*) AS n FROM r
WHERE n < 20 OR v <= (SELECT v FROM r WHERE i = least(n - 1, CAST(floor(n * 0.99) AS BIGINT)))""")
def average_salary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.average_salary(R.jobs(spark, sf_dir))


@query("run_report", f"""{_BASE}, g AS (SELECT *, status = 'success' AS good, CASE WHEN status = 'success' THEN skill_count END AS n FROM ledger)
SELECT count(*) AS processed, count(*) FILTER (WHERE good) AS succeeded, count(*) FILTER (WHERE NOT good) AS failed,
  count(*) FILTER (WHERE good AND skill_count = 0) AS zero_skill, round(avg(n), 4) AS mean_skills, CAST(median(n) AS DOUBLE) AS median_skills,
  round(avg(CASE WHEN n > 0 THEN n END), 4) AS mean_nonzero, round(count(*) FILTER (WHERE good AND skill_count = 0) * 1.0 / count(*) FILTER (WHERE good), 4) AS zero_rate,
  round(count(*) FILTER (WHERE NOT good) * 1.0 / count(*), 4) AS failure_rate FROM g""")
def run_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.run_report(R.ledger(spark, sf_dir))


_COUNTERS = """count(*) AS processed, count(*) FILTER (WHERE status = 'success') AS succeeded, count(*) FILTER (WHERE status <> 'success') AS failed,
  count(*) FILTER (WHERE status = 'success' AND skill_count > 0) AS with_skills, count(*) FILTER (WHERE status = 'success' AND skill_count = 0) AS zero_skill"""


@query("ledger_status", f"""{_BASE}, c AS (SELECT {_COUNTERS} FROM ledger)
SELECT *, CASE WHEN processed = 0 OR failed = 0 THEN 'success' WHEN succeeded > 0 THEN 'partial' ELSE 'failed' END AS run_status FROM c""")
def ledger_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = enrich.counters(R.ledger(spark, sf_dir))
    total = F.col("processed")
    return c.withColumn("run_status", enrich.run_status(total, total, F.col("succeeded"), F.col("failed")))


@query("breakdown_by_country", f"{_BASE} SELECT coalesce(country, '(unknown)') AS key, {_COUNTERS} FROM ledger GROUP BY coalesce(country, '(unknown)')")
def breakdown_by_country(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.breakdown(R.ledger(spark, sf_dir), "country")


@query("failure_stages", """SELECT event_type AS stage, count(*) AS failures, CAST(sum(user_id % 3 + 1) AS BIGINT) AS attempts FROM events GROUP BY event_type""")
def failure_stages(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = R.table(spark, sf_dir, "events").select(F.col("event_type").alias("stage"), (F.col("user_id") % 3 + 1).alias("attempts"))
    return A.failure_stages(e)


@query("merged_failures", """SELECT 1 AS run_id, user_id AS job_id, event_type AS stage,
  CAST(sum(CASE WHEN event_id % 2 = 0 THEN 2 ELSE 1 END) AS BIGINT) AS attempts FROM events GROUP BY user_id, event_type""")
def merged_failures(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = R.table(spark, sf_dir, "events").select(F.lit(1).alias("run_id"), F.col("user_id").alias("job_id"), F.col("event_type").alias("stage"), F.lit(2).cast("long").alias("attempts"), F.lit("e").alias("error"), "event_id")
    return enrich.merged_failures(e.where("event_id % 2 = 0"), e.where("event_id % 2 = 1")).drop("error")


@query("frequency_report", f"""{_BASE}, found AS (SELECT job_id, skill, alias, source FROM job_skills JOIN skills USING (skill_id)),
src AS (SELECT DISTINCT job_id, source FROM job_skills), prim AS (SELECT job_id, min(source) AS source FROM src GROUP BY job_id),
l AS (SELECT ledger.*, prim.source FROM ledger LEFT JOIN prim USING (job_id)), good AS (SELECT * FROM l WHERE status = 'success')
SELECT metric, key, coalesce(secondary_key, '') AS secondary_key, job_count, coalesce(skill_rows, 0) AS skill_rows, coalesce(rate, 0) AS rate FROM (
SELECT * FROM (SELECT 'top_skill' AS metric, skill AS key, CAST(NULL AS VARCHAR) AS secondary_key, count(DISTINCT job_id) AS job_count, count(*) AS skill_rows, CAST(NULL AS DOUBLE) AS rate FROM found GROUP BY skill ORDER BY 4 DESC, 2 LIMIT 30)
UNION ALL SELECT * FROM (SELECT 'top_alias', alias, skill, count(DISTINCT job_id), count(*), NULL FROM found GROUP BY alias, skill ORDER BY 4 DESC, 2, 3 LIMIT 30)
UNION ALL SELECT * FROM (SELECT 'skill_by_source', s.source, skill, count(DISTINCT f.job_id), count(*), NULL FROM found f JOIN src s ON f.job_id = s.job_id GROUP BY s.source, skill ORDER BY 2, 4 DESC, 3 LIMIT 30)
UNION ALL SELECT * FROM (SELECT 'skill_by_country', coalesce(country, '(unknown)'), skill, count(DISTINCT f.job_id), count(*), NULL FROM found f JOIN l ON f.job_id = l.job_id GROUP BY 2, 3 ORDER BY 2, 4 DESC, 3 LIMIT 30)
UNION ALL SELECT 'zero_rate_by_source', coalesce(source, '(unknown)'), NULL, count(*), NULL, round(avg(CASE WHEN skill_count = 0 THEN 1.0 ELSE 0.0 END), 4) FROM good GROUP BY 2
UNION ALL SELECT 'zero_rate_by_country', coalesce(country, '(unknown)'), NULL, count(*), NULL, round(avg(CASE WHEN skill_count = 0 THEN 1.0 ELSE 0.0 END), 4) FROM good GROUP BY 2
UNION ALL SELECT 'skill_count', CAST(skill_count AS VARCHAR), NULL, count(*), NULL, NULL FROM good GROUP BY skill_count
UNION ALL SELECT * FROM (SELECT 'highest_job', CAST(job_id AS VARCHAR), NULL, 1, skill_count, NULL FROM good ORDER BY skill_count DESC, job_id LIMIT 25))""")
def frequency_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    js = R.job_skills(spark, sf_dir)
    tasks = tasks_for(js)
    found = js.join(R.skills(spark, sf_dir), "skill_id").select("job_id", "skill", "alias")
    src = js.select("job_id", "source").repartition(tasks, "job_id").distinct()
    prim = src.groupBy("job_id").agg(F.min("source").alias("source"))
    report = A.frequency_report(R.ledger(spark, sf_dir, tasks).join(prim, "job_id", "left"), found, src, tasks=tasks)
    return report.fillna({"secondary_key": "", "skill_rows": 0, "rate": 0.0})


@query("table_counts", f"""{_BASE} SELECT count(*) AS jobs, count(salary_min) AS with_salary, round(count(salary_min) * 100.0 / count(*), 1) AS salary_percent,
  count(*) FILTER (WHERE salary_currency IS NULL) AS without_currency, (SELECT count(*) FROM customer) AS companies, (SELECT count(*) FROM part) AS skills FROM jobs""")
def table_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    one = R.jobs(spark, sf_dir).agg(F.count("*").alias("jobs"), F.count("salary_min").alias("with_salary"), F.count_if(F.col("salary_currency").isNull()).alias("without_currency"))
    for t, name in (("customer", "companies"), ("part", "skills")):
        one = A.with_total(one, R.table(spark, sf_dir, t).agg(F.count("*").alias(name)))
    return one.withColumn("salary_percent", A.percent(F.col("with_salary"), F.col("jobs")))


@query("raw_parsed_by_source", """SELECT event_type AS source, count(*) AS raw_rows, count(CASE WHEN event_id % 4 <> 0 THEN 1 END) AS parsed, count(*) - count(CASE WHEN event_id % 4 <> 0 THEN 1 END) AS unparsed FROM events GROUP BY event_type""")
def raw_parsed_by_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = _raw(spark, sf_dir)
    linked = raw.where("raw_job_id % 4 <> 0").select("raw_job_id", F.lit(1).alias("ok"))
    return raw.join(linked, "raw_job_id", "left").groupBy("source").agg(F.count("*").alias("raw_rows"), F.count("ok").alias("parsed"), (F.count("*") - F.count("ok")).alias("unparsed"))


@query("coverage_overview", f"""{_BASE} SELECT (SELECT count(*) FROM jobs) AS jobs, (SELECT count(*) FROM ledger WHERE status = 'success') AS in_run,
  (SELECT count(DISTINCT skill_id) FROM job_skills) AS distinct_skills, (SELECT count(*) FROM jobs JOIN embeddings ON job_id = vec_id) AS embedded""")
def coverage_overview(spark: SparkSession, sf_dir: str) -> DataFrame:
    from postwright.operators import vectors as V

    v = R.table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("job_id"), "embedding")
    one = V.coverage(R.jobs(spark, sf_dir).select("job_id"), v)
    one = A.with_total(one, R.ledger(spark, sf_dir).agg(F.count_if(F.col("status") == "success").alias("in_run")))
    return A.with_total(one, R.job_skills(spark, sf_dir).agg(F.count_distinct("skill_id").alias("distinct_skills")))


def _raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.table(spark, sf_dir, "events").select(
        F.col("event_id").alias("raw_job_id"), F.col("event_type").alias("source"), F.col("user_id").cast("string").alias("source_id"), F.col("props").alias("payload"), F.col("ts").alias("fetched_at")
    )


@query("append_idempotent", """WITH old AS (SELECT DISTINCT event_type, user_id FROM events WHERE event_id % 2 = 0),
new AS (SELECT *, row_number() OVER (PARTITION BY event_type, user_id ORDER BY event_id) AS r FROM events WHERE event_id % 2 = 1)
SELECT event_id AS raw_job_id, event_type AS source, CAST(user_id AS VARCHAR) AS source_id FROM new n WHERE r = 1
  AND NOT EXISTS (SELECT 1 FROM old o WHERE o.event_type = n.event_type AND o.user_id = n.user_id)""")
def append_idempotent(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = _raw(spark, sf_dir)
    return boards.new_rows(raw.where("raw_job_id % 2 = 1"), raw.where("raw_job_id % 2 = 0"), "raw_job_id").select("raw_job_id", "source", "source_id")


@query("ingest_audit", """WITH old AS (SELECT DISTINCT event_type, user_id FROM events WHERE event_id % 2 = 0), new AS (SELECT * FROM events WHERE event_id % 2 = 1)
SELECT event_type AS source, count(*) AS rows_fetched,
  count(DISTINCT CASE WHEN NOT EXISTS (SELECT 1 FROM old o WHERE o.event_type = n.event_type AND o.user_id = n.user_id) THEN user_id END) AS rows_inserted, 'success' AS status FROM new n GROUP BY event_type""")
def ingest_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = _raw(spark, sf_dir)
    return boards.run_audit(raw.where("raw_job_id % 2 = 1"), raw.where("raw_job_id % 2 = 0"), "raw_job_id")


@query("unparsed_rows", """SELECT event_id AS raw_job_id, event_type AS source FROM events WHERE event_type = 'click' AND event_id % 3 <> 0 AND event_id % 7 <> 0""")
def unparsed_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = _raw(spark, sf_dir)
    return boards.unparsed(raw, raw.where("raw_job_id % 3 = 0"), raw.where("raw_job_id % 7 = 0"), "click").select("raw_job_id", "source")


@query("reparse_rows", "SELECT event_id AS raw_job_id, event_type AS source FROM events WHERE event_type = 'view'")
def reparse_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return boards.for_reparse(_raw(spark, sf_dir), "view").select("raw_job_id", "source")


@query("incremental_anti_join", f"""{_BASE}, done AS (SELECT DISTINCT job_id FROM job_skills WHERE run_id = 1)
SELECT job_id FROM jobs WHERE job_id NOT IN (SELECT job_id FROM done)""")
def incremental_anti_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    js = R.job_skills(spark, sf_dir)
    led = js.select("run_id", "job_id").distinct().withColumn("status", F.lit("success"))
    runs = spark.createDataFrame([(1, "m", "o"), (2, "m", "old")], "run_id int, matcher_version string, ontology_version string")
    return enrich.not_done(R.jobs(spark, sf_dir).select("job_id"), led, runs, "m", "o")


@query("resume_run", f"""{_BASE} SELECT job_id FROM jobs WHERE job_id NOT IN (SELECT job_id FROM ledger WHERE status = 'success')""")
def resume_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    led = R.ledger(spark, sf_dir).withColumn("run_id", F.lit(7))
    return enrich.to_resume(R.jobs(spark, sf_dir).select("job_id"), led, 7)


@query("selected_jobs", f"""{_BASE} SELECT job_id FROM jobs WHERE country = 'us' AND job_id >= 10 AND job_id IN (SELECT job_id FROM job_skills WHERE source = 'A')""")
def selected_jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    js = R.job_skills(spark, sf_dir).withColumn("raw_job_id", F.col("job_id") * 10 + F.col("line"))
    raw = js.select("raw_job_id", "source")
    return enrich.selected_jobs(R.jobs(spark, sf_dir), js.select("job_id", "raw_job_id"), raw, country="us", source="A", from_id=10).select("job_id")


@query("latest_run", """SELECT max(CAST(o_orderkey AS BIGINT)) AS run_id FROM orders WHERE o_orderstatus IN ('F', 'P')""")
def latest_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    runs = R.table(spark, sf_dir, "orders").selectExpr("o_orderkey AS run_id", "'matcher' AS run_type", "CASE o_orderstatus WHEN 'F' THEN 'success' WHEN 'P' THEN 'partial' ELSE 'running' END AS status")
    return enrich.latest_run(runs)


@query("merge_first_known", f"""WITH rows AS (SELECT l_orderkey * 10 + l_linenumber AS raw_id, l_partkey, l_suppkey, CASE WHEN l_quantity < 10 THEN NULL ELSE l_shipdate END AS posted, l_returnflag, l_linestatus, CASE WHEN l_tax < 0.04 THEN NULL ELSE l_tax END AS tax, l_extendedprice FROM lineitem),
u AS (SELECT *, row_number() OVER (PARTITION BY raw_id ORDER BY l_partkey, l_extendedprice) AS d FROM rows), r AS (SELECT * FROM u WHERE d = 1)
SELECT l_partkey AS k, min(raw_id) AS first_raw_id, arg_min(posted, raw_id) FILTER (WHERE posted IS NOT NULL) AS posted, arg_min(tax, raw_id) FILTER (WHERE tax IS NOT NULL) AS tax, arg_max(l_extendedprice, raw_id) AS price FROM r GROUP BY l_partkey""")
def merge_first_known(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window

    d = R.table(spark, sf_dir, "lineitem").selectExpr("l_orderkey * 10 + l_linenumber AS raw_id", "l_partkey AS k", "CASE WHEN l_quantity < 10 THEN NULL ELSE l_shipdate END AS posted", "CASE WHEN l_tax < 0.04 THEN NULL ELSE l_tax END AS tax", "l_extendedprice AS price")
    one = F.row_number().over(Window.partitionBy("raw_id").orderBy("k", "price"))
    return dedup.merge(d.withColumn("d", one).where("d = 1"), "k", "raw_id", ["posted", "tax"], ["price"])


_KEYED = """k AS (SELECT doc_id AS raw_job_id, source, trim(regexp_replace(regexp_replace(lower(split_part(text, chr(10), 1)), '[^\\p{L}\\p{N}\\s]', ' ', 'g'), '\\s+', ' ', 'g')) AS t, lang FROM documents),
h AS (SELECT raw_job_id, source, sha256(t || '||' || coalesce(lang, '')) AS job_hash FROM k), j AS (SELECT job_hash, min(raw_job_id) AS job_id FROM h GROUP BY job_hash), l AS (SELECT DISTINCT job_id, raw_job_id FROM h JOIN j USING (job_hash))"""


def _keyed(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    d = R.postings(spark, sf_dir)
    t = T._squeezed(F.regexp_replace(F.lower("title"), "_", " "))
    h = d.select(F.col("job_id").alias("raw_job_id"), "source", dedup.job_hash(t, F.lit(""), F.col("country")).alias("job_hash"))
    j = h.groupBy("job_hash").agg(F.min("raw_job_id").alias("job_id"))
    return h.select("raw_job_id", "source"), dedup.links(h, j), h


@query("job_links", f"WITH {_KEYED} SELECT job_id, raw_job_id FROM l")
def job_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _keyed(spark, sf_dir)[1]


@query("dedup_report", f"""WITH {_KEYED}, r AS (SELECT h.source, h.raw_job_id, l.job_id FROM h LEFT JOIN l USING (raw_job_id)),
c AS (SELECT source, count(DISTINCT raw_job_id) AS raw_rows, count(job_id) AS linked_rows, count(DISTINCT job_id) AS unique_jobs FROM r GROUP BY source UNION ALL SELECT NULL, count(DISTINCT raw_job_id), count(job_id), count(DISTINCT job_id) FROM r)
SELECT *, CASE WHEN unique_jobs > 0 THEN linked_rows * 1.0 / unique_jobs ELSE 0 END AS dedup_factor FROM c""")
def dedup_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw, linked, _ = _keyed(spark, sf_dir)
    return dedup.dedup_report(raw, linked)


@query("primary_source", f"WITH {_KEYED} SELECT job_id, min(source) AS source FROM l JOIN h USING (raw_job_id) GROUP BY job_id")
def primary_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw, linked, _ = _keyed(spark, sf_dir)
    return dedup.primary_source(linked, raw)


@query("companies", """SELECT trim(regexp_replace(regexp_replace(lower(c_name), '[^a-z0-9]', ' ', 'g'), '\\s+', ' ', 'g')) AS name_norm, arg_min(c_name, c_custkey) AS name, min(c_custkey) AS company_id FROM customer GROUP BY 1""")
def companies(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = R.table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("raw_job_id"), F.col("c_name").alias("company_name"))
    return dedup.companies(d.withColumn("company_norm", T.company_key(F.col("company_name"))))


@query("best_per_job", """SELECT l_suppkey AS profile_id, l_partkey AS job_id, l_extendedprice AS score, l_orderkey * 10 + l_linenumber AS row_id FROM lineitem
QUALIFY row_number() OVER (PARTITION BY l_suppkey, l_partkey ORDER BY l_extendedprice DESC, l_orderkey * 10 + l_linenumber) = 1""")
def best_per_job(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = R.table(spark, sf_dir, "lineitem").selectExpr("l_suppkey AS profile_id", "l_partkey AS job_id", "l_extendedprice AS score", "l_orderkey * 10 + l_linenumber AS row_id")
    return dedup.best_per_job(d)


@query("lexical_candidates", f"""{_BASE}, {R.PROFILES_SQL}, c AS (SELECT p.profile_id, j.job_id, count(DISTINCT p.skill) AS overlap FROM profile_skills p JOIN job_skills j ON p.skill = j.skill_id GROUP BY p.profile_id, j.job_id)
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY profile_id ORDER BY overlap DESC, job_id) AS lexical_rank FROM c) WHERE lexical_rank <= 200""")
def lexical_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    js = R.job_skills(spark, sf_dir).select("job_id", F.col("skill_id").alias("skill"))
    return matching.lexical_candidates(R.profile_skills(spark, sf_dir), js)


# A skill of half the jobs (-1) and one of a third (-2), which all profiles and half of them have.
@query("popular_candidates", f"""{_BASE}, {R.PROFILES_SQL}, js AS (SELECT DISTINCT job_id, skill_id AS skill FROM job_skills UNION SELECT job_id, -1 FROM jobs WHERE job_id % 2 = 0 UNION SELECT job_id, -2 FROM jobs WHERE job_id % 3 = 0),
ps AS (SELECT profile_id, skill FROM profile_skills UNION ALL SELECT profile_id, -1 FROM profiles UNION ALL SELECT profile_id, -2 FROM profiles WHERE profile_id % 2 = 0),
c AS (SELECT profile_id, job_id, count(*) AS overlap FROM ps JOIN js USING (skill) GROUP BY profile_id, job_id)
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY profile_id ORDER BY overlap DESC, job_id) AS lexical_rank FROM c) WHERE lexical_rank <= 100""")
def popular_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    js = R.job_skills(spark, sf_dir).select("job_id", F.col("skill_id").alias("skill"))
    jobs, profiles = R.jobs(spark, sf_dir), R.profiles(spark, sf_dir)
    js = js.union(jobs.where("job_id % 2 = 0").selectExpr("job_id", "-1")).union(jobs.where("job_id % 3 = 0").selectExpr("job_id", "-2"))
    ps = R.profile_skills(spark, sf_dir).union(profiles.selectExpr("profile_id", "-1")).union(profiles.where("profile_id % 2 = 0").selectExpr("profile_id", "-2"))
    return matching.lexical_candidates(ps, js, 100)


def _recommended(spark: SparkSession, sf_dir: str, mode: str = "lexical") -> DataFrame:
    js = R.job_skills(spark, sf_dir).select("job_id", F.col("skill_id").alias("skill"))
    c = matching.lexical_candidates(R.profile_skills(spark, sf_dir), js)
    if mode != "lexical":
        c = matching.union_candidates(c, _semantic(spark, sf_dir))
    return matching.scored(c, R.profiles(spark, sf_dir), R.match_jobs(spark, sf_dir), mode, generic=["1", "2", "3"], specialised=["4", "5", "6", "7"])


def _semantic(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Neighbours of the vector of a profile's number among the vectors of the jobs' numbers."""
    from postwright.operators import vectors as V

    e = R.table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    q = e.join(R.table(spark, sf_dir, "supplier"), F.col("vec_id") == F.col("s_suppkey")).select(F.col("s_suppkey").alias("query_id"), "embedding")
    return V.nearest(q, e, 50).select(F.col("query_id").alias("profile_id"), F.col("vec_id").alias("job_id"), F.col("score").alias("semantic_score"))


_SCORED = f"""{_BASE}, {R.PROFILES_SQL}, cand AS (SELECT * FROM (SELECT profile_id, job_id, overlap, row_number() OVER (PARTITION BY profile_id ORDER BY overlap DESC, job_id) AS r
  FROM (SELECT p.profile_id, j.job_id, count(DISTINCT p.skill) AS overlap FROM profile_skills p JOIN job_skills j ON p.skill = j.skill_id GROUP BY p.profile_id, j.job_id)) WHERE r <= 200),
js AS (SELECT DISTINCT job_id, skill_id FROM job_skills), nj AS (SELECT job_id, count(*) AS nj FROM js GROUP BY job_id), np AS (SELECT profile_id, count(*) AS np FROM profile_skills GROUP BY profile_id),
hit AS (SELECT c.profile_id, c.job_id, count(*) AS nm, sum(CASE WHEN s.skill_id IN (4, 5, 6, 7) THEN 100 WHEN s.skill_id IN (1, 2, 3) THEN 35 ELSE 65 END) / 100.0 AS spec,
  count(*) FILTER (WHERE s.skill_id IN (4, 5, 6, 7)) AS nspec FROM cand c JOIN js s ON c.job_id = s.job_id JOIN profile_skills p ON p.profile_id = c.profile_id AND p.skill = s.skill_id GROUP BY c.profile_id, c.job_id),
a AS (SELECT h.profile_id, h.job_id, nm, nspec, nj, np, nm * 1.0 / nj AS coverage, nm * 1.0 / np AS relevance, CASE WHEN nj = 1 THEN 0.6 WHEN nj = 2 THEN 0.75 WHEN nj <= 5 THEN 0.9 ELSE 1.0 END AS richness, spec / nm AS specificity,
  p.career_level, p.total_years, p.country AS pc, j.country AS jc, CAST(substr(contract_type, 1, 1) AS INTEGER) AS k, p.profile_id % 3 AS dom
  FROM hit h JOIN nj USING (job_id) JOIN np USING (profile_id) JOIN profiles p USING (profile_id) JOIN jobs j ON j.job_id = h.job_id),
b AS (SELECT *, CASE k WHEN 1 THEN 5.0 WHEN 2 THEN 1.0 WHEN 3 THEN 4.0 END AS need, CASE k WHEN 1 THEN 3 WHEN 2 THEN 1 WHEN 3 THEN 4 WHEN 4 THEN 2 ELSE 0 END AS target_rank,
  CASE career_level WHEN 'student' THEN 0 WHEN 'junior' THEN 1 WHEN 'mid' THEN 2 WHEN 'senior' THEN 3 ELSE -1 END AS own_rank FROM a),
c AS (SELECT *, least(1.0, 0.55 * coverage + 0.20 * relevance + 0.10 * richness + 0.15 * specificity) AS skill_score,
  CASE WHEN need IS NULL THEN NULL WHEN total_years IS NULL THEN need WHEN total_years >= need THEN 0.0 ELSE need - total_years END AS gap,
  CASE WHEN need IS NULL THEN 0.9 WHEN total_years IS NULL THEN 0.55 WHEN total_years >= need THEN 1.0 ELSE greatest(0.15, 1 - (need - total_years) / greatest(need, 1.0)) END AS experience,
  CASE WHEN career_level = 'unknown' THEN 0.65 WHEN k = 5 THEN CASE WHEN career_level IN ('student', 'junior') THEN 1.0 ELSE 0.55 END WHEN target_rank - own_rank <= 0 THEN 1.0 WHEN target_rank - own_rank = 1 THEN 0.7 WHEN target_rank - own_rank = 2 THEN 0.35 ELSE 0.1 END AS career,
  CASE WHEN k = 4 THEN 0.65 WHEN k = 5 THEN CASE WHEN career_level = 'student' THEN 1.0 ELSE 0.55 END WHEN k = 3 THEN CASE WHEN total_years IS NULL OR total_years < 2 THEN 0.35 ELSE 0.85 END ELSE 0.75 END AS job_type,
  CASE WHEN k = 4 THEN 0.45 WHEN dom = 2 THEN 0.35 WHEN dom = 1 THEN CASE WHEN k = 5 THEN 0.275 ELSE 0.0 END ELSE CASE k WHEN 1 THEN 0.75 WHEN 2 THEN 1.0 WHEN 3 THEN 0.0 ELSE 0.375 END END AS domain,
  CASE WHEN pc = jc THEN 0.75 WHEN pc IS NULL THEN 0.5 WHEN jc IS NULL THEN 0.5 ELSE 0.25 END AS place FROM b),
d AS (SELECT *, 0.5 * skill_score + 0.15 * experience + 0.15 * career + 0.1 * domain + 0.05 * job_type + 0.05 * place AS weighted,
  least(0.75, CASE WHEN career_level = 'student' AND k IN (1, 3) THEN 0.3 ELSE 0 END + CASE WHEN career_level = 'student' AND need >= 5 THEN 0.25 ELSE 0 END
    + CASE WHEN k = 3 AND (total_years IS NULL OR total_years < 2) THEN 0.25 ELSE 0 END + CASE WHEN dom = 1 AND k <> 4 THEN 0.45 ELSE 0 END
    + CASE WHEN need IS NOT NULL AND total_years IS NULL THEN 0.08 WHEN gap > 0 THEN least(0.25, 0.06 * gap) ELSE 0 END) AS penalty FROM c)"""


@query("recommend_lexical", f"""{_SCORED} SELECT profile_id, job_id, nm AS matched_count, round(skill_score, 6) AS skill_score, round(experience, 6) AS experience_score, career AS career_score, job_type AS job_type_score,
  domain AS domain_score, place AS location_score, round(penalty, 6) AS penalty_total, round(greatest(0, weighted), 6) AS lexical_score FROM d""")
def recommend_lexical(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _recommended(spark, sf_dir).select(
        "profile_id", "job_id", F.size("matched").cast("long").alias("matched_count"), F.round("skill_score", 6).alias("skill_score"), F.round("experience_score", 6).alias("experience_score"), "career_score", "job_type_score",
        "domain_score", F.col("location.score").alias("location_score"), F.round("penalty_total", 6).alias("penalty_total"), F.round("lexical_score", 6).alias("lexical_score"),
    )


@query("suppressed_jobs", f"""{_SCORED} SELECT d.profile_id, count(*) AS candidates, count(*) FILTER (WHERE dom = 1 AND (k <> 4 OR regexp_matches(lower(j.title), '{matching.TECHNICAL_TITLE}'))) AS suppressed
FROM d JOIN jobs j ON d.job_id = j.job_id GROUP BY d.profile_id""")
def suppressed_jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    hidden = F.count_if(matching.suppressed()).alias("suppressed")
    return _recommended(spark, sf_dir).groupBy("profile_id").agg(F.count("*").alias("candidates"), hidden)


@query("recommend_top", None)
def recommend_top(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matching.shaped(matching.ranked(_recommended(spark, sf_dir), 10))


#: Names of domains that are skills of jobs as well: who has the domain doesn't lack them.
_DOMAIN_SKILLS = [("1", ["Data Science"]), ("2", ["data  science", "sales"]), ("5", ["SALES"]), ("9", ["cooking"])]


def _wishes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every other profile wishes one contract."""
    return R.profiles(spark, sf_dir).where("profile_id % 2 = 0").select("profile_id", F.element_at(F.array(*[F.lit(x) for x in ("1-Urgent", "2-high", "3-MEDIUM")]), (F.col("profile_id") % 3 + 1).cast("int")).alias("contract_type"))


def _covered(spark: SparkSession, sf_dir: str) -> DataFrame:
    skills = spark.createDataFrame([(c, "domain", a, None) for c, a in _DOMAIN_SKILLS], "canonical string, category string, aliases array<string>, parent string")
    return matching.with_covered(R.profiles(spark, sf_dir), ontology.alias_index(skills))


# Every other profile has confirmed skills as written, a level, years and domains; one in six names a skill that nobody knows.
@query("confirmed_profiles", f"""WITH {R.JOBS_SQL}, {R.JOB_SKILLS_SQL}, {R.PROFILES_SQL}, own AS (SELECT profile_id, list_sort(list(CAST(skill AS VARCHAR))) AS skills FROM profile_skills GROUP BY profile_id),
c AS (SELECT profile_id, CASE profile_id % 6 WHEN 0 THEN ['PY', ' sql '] WHEN 2 THEN ['ml', 'Python', 'py'] ELSE ['cobol', 'SQL'] END AS said FROM profiles WHERE profile_id % 2 = 0),
e AS (SELECT profile_id, CASE lower(trim(s)) WHEN 'py' THEN 'Python' WHEN 'python' THEN 'Python' WHEN 'sql' THEN 'SQL' WHEN 'ml' THEN 'Machine Learning' END AS skill FROM (SELECT profile_id, unnest(said) AS s FROM c)),
k AS (SELECT profile_id, string_agg(DISTINCT skill, '|' ORDER BY skill) AS skills FROM e GROUP BY profile_id HAVING count(*) = count(skill))
SELECT p.profile_id, k.profile_id IS NOT NULL AS confirmed, CASE WHEN k.profile_id IS NULL THEN coalesce(array_to_string(own.skills, '|'), '') ELSE k.skills END AS skills, CASE WHEN k.profile_id IS NULL THEN career_level ELSE 'lead' END AS career_level,
  CASE WHEN k.profile_id IS NULL THEN CAST(total_years AS DOUBLE) ELSE p.profile_id / 8.0 END AS total_years, CAST(round_even(CASE WHEN k.profile_id IS NULL THEN CAST(total_years AS DOUBLE) ELSE p.profile_id / 8.0 END * 12, 0) AS INTEGER) AS total_months,
  CASE WHEN k.profile_id IS NOT NULL THEN 'A|B' WHEN p.profile_id % 3 = 0 THEN 'Data Science' WHEN p.profile_id % 3 = 1 THEN 'Sales' ELSE '' END AS domains
FROM profiles p LEFT JOIN own USING (profile_id) LEFT JOIN k USING (profile_id)""")
def confirmed_profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    skills = spark.createDataFrame([("Python", "language", ["py"], None), ("SQL", "language", [], None), ("Machine Learning", "domain", ["ml"], None)], "canonical string, category string, aliases array<string>, parent string")
    p = R.profiles(spark, sf_dir)
    texts = lambda *v: F.array(*[F.lit(x) for x in v])
    k = F.col("profile_id") % 6
    said = p.where("profile_id % 2 = 0").select(
        "profile_id", F.when(k == 0, texts("PY", " sql ")).when(k == 2, texts("ml", "Python", "py")).otherwise(texts("cobol", "SQL")).alias("skills"), F.lit("lead").alias("career_level"),
        (F.col("profile_id") / 8).alias("total_years"), texts("B", "A", "B").alias("domains"),
    )
    out, _ = matching.with_confirmed(p, said, ontology.alias_index(skills))
    return out.select("profile_id", "confirmed", F.array_join("skills", "|").alias("skills"), "career_level", "total_years", "total_months", F.array_join("domains", "|").alias("domains"))


@query("covered_skills", f"""WITH {R.JOBS_SQL}, {R.JOB_SKILLS_SQL}, {R.PROFILES_SQL}, d AS (SELECT profile_id, CASE profile_id % 3 WHEN 0 THEN 'data science' WHEN 1 THEN 'sales' END AS label FROM profiles),
a AS (SELECT * FROM (VALUES ('1', 'data science'), ('2', 'data science'), ('2', 'sales'), ('5', 'sales'), ('9', 'cooking')) v(skill, label))
SELECT profile_id, coalesce(string_agg(skill, '|' ORDER BY skill), '') AS covered FROM d LEFT JOIN a USING (label) GROUP BY profile_id""")
def covered_skills(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _covered(spark, sf_dir).select("profile_id", F.array_join("covered", "|").alias("covered"))


@query("wished_candidates", f"""{_BASE}, {R.PROFILES_SQL}, c AS (SELECT p.profile_id, j.job_id, count(DISTINCT p.skill) AS overlap FROM profile_skills p JOIN job_skills j ON p.skill = j.skill_id GROUP BY p.profile_id, j.job_id),
r AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY profile_id ORDER BY overlap DESC, job_id) AS lexical_rank FROM c) WHERE lexical_rank <= 200)
SELECT r.profile_id, r.job_id, r.lexical_rank FROM r JOIN jobs USING (job_id) WHERE r.profile_id % 2 <> 0 OR upper(jobs.contract_type) = upper(['1-Urgent', '2-high', '3-MEDIUM'][r.profile_id % 3 + 1])""")
def wished_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    js = R.job_skills(spark, sf_dir).select("job_id", F.col("skill_id").alias("skill"))
    c = matching.lexical_candidates(R.profile_skills(spark, sf_dir), js).join(R.jobs(spark, sf_dir).select("job_id", F.col("contract_type").alias("j_contract_type")), "job_id")
    return matching.of_contract(c, _wishes(spark, sf_dir)).select("profile_id", "job_id", "lexical_rank")


@query("recommend_wished", None)
def recommend_wished(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best jobs of the wished contract; skills that a profile's domains cover aren't missing."""
    js = R.job_skills(spark, sf_dir).select("job_id", F.col("skill_id").alias("skill"))
    jobs = R.match_jobs(spark, sf_dir).join(R.jobs(spark, sf_dir).select("job_id", "contract_type"), "job_id")
    rows = matching.scored(matching.lexical_candidates(R.profile_skills(spark, sf_dir), js), _covered(spark, sf_dir), jobs, "lexical", generic=["1", "2", "3"], specialised=["4", "5", "6", "7"])
    return matching.ranked(matching.of_contract(rows, _wishes(spark, sf_dir)), 10).select("profile_id", "job_id", "rank", "final_score", "matched", "missing", "j_contract_type")


@query("recommend_hybrid", None)
def recommend_hybrid(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = matching.ranked(_recommended(spark, sf_dir, "hybrid"), 10)
    return r.select("profile_id", "job_id", "rank", "final_score", "lexical_score", "semantic_score", "retrieval_source")


@query("skill_gaps", f"""{_BASE}, {R.PROFILES_SQL}, c AS (SELECT p.profile_id, j.job_id, count(DISTINCT p.skill) AS overlap FROM profile_skills p JOIN job_skills j ON p.skill = j.skill_id GROUP BY p.profile_id, j.job_id),
m AS (SELECT profile_id, job_id FROM (SELECT *, row_number() OVER (PARTITION BY profile_id ORDER BY overlap DESC, job_id) AS r FROM c) WHERE r <= 20), n AS (SELECT profile_id, count(*) AS n FROM m GROUP BY profile_id),
lost AS (SELECT m.profile_id, s.skill_id AS skill, count(*) AS missing_count FROM m JOIN (SELECT DISTINCT job_id, skill_id FROM job_skills) s USING (job_id)
  WHERE NOT EXISTS (SELECT 1 FROM profile_skills p WHERE p.profile_id = m.profile_id AND p.skill = s.skill_id) GROUP BY ALL),
demand AS (SELECT skill_id AS skill, count(DISTINCT job_id) AS demand FROM job_skills GROUP BY skill_id)
SELECT profile_id, skill, missing_count, demand, row_number() OVER (PARTITION BY profile_id ORDER BY demand DESC, missing_count DESC, skill) AS rank, round(missing_count * 100.0 / n, 1) AS percent FROM lost JOIN demand USING (skill) JOIN n USING (profile_id)""")
def skill_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    js = R.job_skills(spark, sf_dir).select("job_id", F.col("skill_id").alias("skill"))
    js = js.repartition(tasks_for(js), "job_id").distinct()
    ps = R.profile_skills(spark, sf_dir)
    own = ps.groupBy("profile_id").agg(F.collect_list("skill").alias("own"))
    lists = js.groupBy("job_id").agg(F.collect_list("skill").alias("skills"))
    m = matching.lexical_candidates(ps, js, 20).join(lists, "job_id").join(own, "profile_id").withColumn("missing", F.array_except("skills", "own"))
    demand = matching.demand_of(js, js.select("skill").distinct())
    return matching.recommended_skills(matching.skill_gaps(m, demand), m).drop("n_matches")


# Tables with a violation of every rule, by arithmetic on the given ones; the SQL states each rule anew.
_RULED = {
    "companies": "SELECT c_custkey AS company_id FROM customer WHERE c_custkey % 10 <> 0",
    "raw_jobs": "SELECT event_id AS raw_job_id, event_type AS source, CASE WHEN event_id % 9 <> 0 THEN user_id END AS source_id FROM events",
    "jobs": "SELECT CASE WHEN o_orderkey % 50 = 3 THEN o_orderkey - 1 ELSE o_orderkey END AS job_id, o_custkey AS company_id FROM orders WHERE o_orderkey % 40 <> 7",
    "skills": "SELECT p_partkey AS skill_id, p_name AS canonical, CASE WHEN p_partkey % 3 = 0 THEN p_partkey * 2 END AS parent_id FROM part",
    "job_sources": "SELECT l_orderkey AS job_id, CASE WHEN l_linenumber > 5 THEN l_linenumber - 1 ELSE l_linenumber END AS raw_job_id FROM lineitem",
    "runs": "SELECT r_regionkey AS run_id, CASE r_regionkey WHEN 1 THEN 'other' ELSE 'matcher' END AS run_type, CASE r_regionkey WHEN 2 THEN 'odd' ELSE 'partial' END AS status, r_regionkey - 1 AS jobs_total, r_regionkey - 2 AS jobs_processed, 1 - r_regionkey AS jobs_succeeded, CASE WHEN r_regionkey > 0 THEN -r_regionkey END AS jobs_failed, 3 - r_regionkey AS jobs_with_skills, r_regionkey - 4 AS zero_skill_jobs FROM region",
    "job_skills": "SELECT l_linenumber - 1 AS run_id, l_orderkey AS job_id, CASE WHEN l_partkey % 70 = 0 THEN -1 ELSE l_partkey END AS skill_id, CASE l_returnflag WHEN 'A' THEN 'matcher' WHEN 'N' THEN 'llm' ELSE 'other' END AS method, CASE l_linestatus WHEN 'O' THEN 'title' WHEN 'F' THEN CASE WHEN l_suppkey % 4 = 0 THEN 'body' ELSE 'description' END END AS evidence_field, l_linenumber - 2 AS start_char, l_quantity AS end_char, CASE WHEN l_linenumber > 2 THEN l_discount * 12 END AS confidence FROM lineitem",
    "ledger": "SELECT o_orderkey % 6 AS run_id, CASE WHEN o_orderkey % 30 < 2 THEN 1 ELSE o_orderkey END AS job_id, CASE o_orderstatus WHEN 'O' THEN 'success' WHEN 'F' THEN 'failed' ELSE 'open' END AS status, o_orderkey % 12 - 1 AS skill_count FROM orders",
    "failures": "SELECT s_suppkey % 7 AS run_id, s_suppkey * 4 AS job_id, CASE WHEN s_suppkey % 5 > 0 THEN 'match' END AS stage, s_suppkey % 4 AS attempts FROM supplier UNION ALL SELECT 1, 4, 'match', 2",
}


def _ruled_sql() -> str:
    off = lambda t, rule, bad: f"SELECT '{t}' AS table_name, '{rule}' AS rule, count(*) FILTER (WHERE {bad}) AS n FROM {t}"
    twice = lambda t, *c: f"SELECT '{t}', 'unique_{'_'.join(c)}', count(*) - count(DISTINCT ({', '.join(c)}, 0)) FROM {t} WHERE {' AND '.join(f'{x} IS NOT NULL' for x in c)}"
    lost = lambda t, c, parent, key: f"SELECT '{t}', 'foreign_{c}', count(*) FROM {t} t WHERE {c} IS NOT NULL AND NOT EXISTS (SELECT 1 FROM {parent} p WHERE p.{key} = t.{c})"
    rows = [
        off("runs", "run_type", "run_type NOT IN ('matcher', 'llm_experiment')"), off("runs", "status", "status NOT IN ('running', 'success', 'partial', 'failed')"),
        *[off("runs", f"{c}_nonnegative", f"{c} < 0") for c in ("jobs_total", "jobs_processed", "jobs_succeeded", "jobs_failed", "jobs_with_skills", "zero_skill_jobs")],
        off("job_skills", "method", "method NOT IN ('matcher', 'llm')"), off("job_skills", "evidence_field", "evidence_field NOT IN ('title', 'description')"), off("job_skills", "start_nonnegative", "start_char < 0"),
        off("job_skills", "end_after_start", "end_char < start_char"), off("job_skills", "confidence_range", "confidence < 0 OR confidence > 1"), off("ledger", "status", "status NOT IN ('success', 'failed')"),
        off("ledger", "skill_count_nonnegative", "skill_count < 0"), off("failures", "attempts_positive", "attempts < 1"),
        twice("raw_jobs", "source", "source_id"), twice("jobs", "job_id"), twice("skills", "canonical"), twice("job_sources", "job_id", "raw_job_id"), twice("job_skills", "run_id", "job_id", "skill_id", "method"), twice("ledger", "run_id", "job_id"), twice("failures", "run_id", "job_id", "stage"),
        lost("jobs", "company_id", "companies", "company_id"), lost("skills", "parent_id", "skills", "skill_id"), lost("job_sources", "job_id", "jobs", "job_id"), lost("job_sources", "raw_job_id", "raw_jobs", "raw_job_id"),
        *[lost(t, "run_id", "runs", "run_id") for t in ("job_skills", "ledger", "failures")], *[lost(t, "job_id", "jobs", "job_id") for t in ("job_skills", "ledger", "failures")], lost("job_skills", "skill_id", "skills", "skill_id"),
    ]
    return "WITH " + ", ".join(f"{t} AS ({q})" for t, q in _RULED.items()) + " " + " UNION ALL ".join(rows)


@query("constraint_violations", _ruled_sql())
def constraint_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    for t in ("customer", "events", "orders", "part", "lineitem", "region", "supplier"):
        R.table(spark, sf_dir, t).createOrReplaceTempView(f"ruled_{t}")
    own = lambda q: re.sub(r"FROM (\w+)", r"FROM ruled_\1", q)
    return constraints.violations({t: spark.sql(own(q)) for t, q in _RULED.items()})


# A first batch, the same again, one with a row that can't be made, and all rows: what each run has fetched, added and left.
@query("ingest_runs", """WITH e AS (SELECT DISTINCT event_type AS s, user_id FROM events), h AS (SELECT DISTINCT event_type AS s, user_id FROM events WHERE event_id % 2 = 0)
SELECT 1 AS nth, 'success' AS status, (SELECT count(*) FROM events WHERE event_id % 2 = 0) AS rows_fetched, (SELECT count(*) FROM h) AS rows_inserted, false AS traced, (SELECT count(*) FROM e) AS stored
UNION ALL SELECT 2, 'success', (SELECT count(*) FROM events WHERE event_id % 2 = 0), 0, false, (SELECT count(*) FROM e)
UNION ALL SELECT 3, 'failed', 0, 0, true, (SELECT count(*) FROM e)
UNION ALL SELECT 4, 'success', (SELECT count(*) FROM events), (SELECT count(*) FROM e) - (SELECT count(*) FROM h), false, (SELECT count(*) FROM e)""")
def ingest_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw, folder = _raw(spark, sf_dir), f"{shared_folder(spark)}/ingest-{uuid.uuid4().hex}"
    half = raw.where("raw_job_id % 2 = 0")
    broken = raw.withColumn("payload", F.when(F.col("raw_job_id") == 0, F.raise_error(F.lit("unreadable row"))).otherwise(F.col("payload")))
    for batch in (half, half, broken, raw):
        with contextlib.suppress(Exception):  # the record says that it failed
            boards.ingest_run(batch, f"{folder}/raw", f"{folder}/runs", "events")
    runs = spark.read.parquet(f"{folder}/runs").withColumn("nth", F.row_number().over(Window.partitionBy("source").orderBy("started_at")))
    stored = F.lit(spark.read.parquet(f"{folder}/raw").count()).alias("stored")
    return runs.select("nth", "status", "rows_fetched", "rows_inserted", F.coalesce(F.col("error").contains("unreadable row"), F.lit(False)).alias("traced"), stored)


@query("sampled_ids", "SELECT doc_id FROM documents ORDER BY sha256('seed:' || CAST(doc_id AS VARCHAR)), doc_id LIMIT 50")
def sampled_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.sample(R.table(spark, sf_dir, "documents").select("doc_id"), "doc_id", 50, "seed")


@query("top_skill_review", f"""{_BASE}, f AS (SELECT DISTINCT skill, job_id FROM job_skills JOIN skills USING (skill_id)), top AS (SELECT skill FROM f GROUP BY skill ORDER BY count(*) DESC, skill LIMIT 10)
SELECT skill, job_id FROM f WHERE skill IN (SELECT skill FROM top) QUALIFY row_number() OVER (PARTITION BY skill ORDER BY sha256('review:' || CAST(job_id AS VARCHAR)), job_id) <= 10""")
def top_skill_review(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.top_skill_review(R.job_skills(spark, sf_dir).join(R.skills(spark, sf_dir), "skill_id"), force=None)


@query("zero_skill_review", f"{_BASE} SELECT job_id FROM ledger WHERE status = 'success' AND skill_count = 0 ORDER BY sha256('zero:' || CAST(job_id AS VARCHAR)), job_id LIMIT 50")
def zero_skill_review(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.zero_skill_review(R.ledger(spark, sf_dir)).select("job_id")


@query("high_count_review", f"""{_BASE}, most AS (SELECT job_id, skill_count FROM ledger WHERE status = 'success' ORDER BY skill_count DESC, job_id LIMIT 25), f AS (SELECT job_id, skill_count, skill, alias FROM most JOIN job_skills USING (job_id) JOIN skills USING (skill_id))
SELECT job_id, skill_count, (SELECT string_agg(skill, ', ' ORDER BY skill) FROM (SELECT DISTINCT g.skill FROM f g WHERE g.job_id = f.job_id)) AS skills, string_agg(skill || '=' || alias, '; ' ORDER BY skill, alias) AS evidence FROM f GROUP BY job_id, skill_count""")
def high_count_review(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.high_count_review(R.ledger(spark, sf_dir), R.job_skills(spark, sf_dir).join(R.skills(spark, sf_dir), "skill_id"))


@query("dedup_exact", "SELECT sha256(text) AS key, min(doc_id) AS first_id, count(*) AS copies FROM documents GROUP BY text HAVING count(*) > 1")
def dedup_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    return curation.duplicate_groups(R.table(spark, sf_dir, "documents"), F.col("text"))


@query("dedup_normalised", "SELECT sha256(t) AS key, min(doc_id) AS first_id, count(*) AS copies FROM (SELECT doc_id, trim(regexp_replace(lower(text), '\\s+', ' ', 'g')) AS t FROM documents) GROUP BY t HAVING count(*) > 1")
def dedup_normalised(spark: SparkSession, sf_dir: str) -> DataFrame:
    return curation.duplicate_groups(R.table(spark, sf_dir, "documents"), curation.text_key(F.col("text")))


@query("split_leakage", """SELECT sha256(text) AS item, count(DISTINCT doc_id % 3) AS splits, string_agg(DISTINCT CAST(doc_id % 3 AS VARCHAR), ',' ORDER BY CAST(doc_id % 3 AS VARCHAR)) AS in_splits FROM documents GROUP BY text HAVING count(DISTINCT doc_id % 3) > 1""")
def split_leakage(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = R.table(spark, sf_dir, "documents").select(F.sha2(F.col("text").cast("binary"), 256).alias("item"), (F.col("doc_id") % 3).cast("string").alias("split"))
    return curation.leakage(d)


@query("unannotated", "SELECT doc_id AS item FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def unannotated(spark: SparkSession, sf_dir: str) -> DataFrame:
    item = F.col("doc_id").alias("item")
    return curation.unannotated(R.table(spark, sf_dir, "documents").select(item), R.table(spark, sf_dir, "labels").select(item))


@query("quality_gates", """SELECT source AS metric, round(avg(n_chars), 4) AS value, 2400.0 AS threshold FROM documents GROUP BY source HAVING avg(n_chars) < 2400""")
def quality_gates(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = R.table(spark, sf_dir, "documents").groupBy(F.col("source").alias("metric")).agg(F.round(F.avg("n_chars"), 4).alias("value"))
    return curation.gate_failures(m, m.select("metric", F.lit(2400.0).alias("threshold")))


@query("confusion", """SELECT CASE WHEN quality = 1 THEN 'good' ELSE 'bad' END AS expected, CASE WHEN n_chars >= 400 THEN 'good' ELSE 'bad' END AS actual, count(*) AS n FROM labels JOIN documents USING (doc_id) GROUP BY 1, 2""")
def confusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = R.table(spark, sf_dir, "labels").join(R.table(spark, sf_dir, "documents"), "doc_id")
    return curation.confusion(d.select(F.when(F.col("quality") == 1, "good").otherwise("bad").alias("expected"), F.when(F.col("n_chars") >= 400, "good").otherwise("bad").alias("actual")))


@query("balanced_selection", """WITH dup AS (SELECT doc_id FROM documents WHERE text IN (SELECT text FROM documents GROUP BY text HAVING count(*) > 1)),
r AS (SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY sha256('gold:' || CAST(doc_id AS VARCHAR)), doc_id) AS r FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM dup))
SELECT doc_id, lang, CASE WHEN r <= 10 THEN 'dev' ELSE 'test' END AS split FROM r WHERE r <= 30""")
def balanced_selection(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = R.table(spark, sf_dir, "documents").withColumn("key", F.sha2(F.col("text").cast("binary"), 256))
    dup = d.join(curation.duplicate_groups(d, F.col("text")).select("key"), "key", "left_semi")
    return curation.balanced_selection(d.select("doc_id", "lang"), dup, {"dev": 10, "test": 20}, "lang", "doc_id", "gold")


@query("set_scores", f"""{_BASE}, e AS (SELECT job_id, list_distinct(list(skill)) AS expected FROM job_skills JOIN skills USING (skill_id) WHERE line <= 3 GROUP BY job_id), a AS (SELECT job_id, list_distinct(list(skill)) AS actual FROM job_skills JOIN skills USING (skill_id) WHERE line >= 3 GROUP BY job_id),
m AS (SELECT len(list_intersect(expected, actual)) AS tp, len(expected) AS ne, len(actual) AS na FROM e JOIN a USING (job_id)), s AS (SELECT tp, ne, na, tp * 1.0 / na AS p, tp * 1.0 / ne AS r FROM m)
SELECT count(*) AS items, round(sum(tp) * 1.0 / sum(na), 6) AS micro_precision, round(sum(tp) * 1.0 / sum(ne), 6) AS micro_recall, round(avg(p), 6) AS macro_precision, round(avg(r), 6) AS macro_recall, round(avg(CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0 END), 6) AS macro_f1 FROM s""")
def set_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = R.job_skills(spark, sf_dir).join(R.skills(spark, sf_dir), "skill_id")
    e = d.where("line <= 3").groupBy("job_id").agg(F.collect_set("skill").alias("expected"))
    a = d.where("line >= 3").groupBy("job_id").agg(F.collect_set("skill").alias("actual"))
    s = curation.score_summary(e.join(a, "job_id"))
    return s.select("items", *[F.round(c, 6).alias(c) for c in ("micro_precision", "micro_recall", "macro_precision", "macro_recall", "macro_f1")])


@query("pii_queue", f"""WITH c AS (SELECT doc_id, len(regexp_extract_all(text, '{curation.EMAIL}')) AS emails, len(regexp_extract_all(text, '{curation.PHONE}')) AS phones, len(regexp_extract_all(text, '{curation.URL}')) AS urls,
  len(regexp_extract_all(text, '{curation.ADDRESS}')) AS addresses FROM documents)
SELECT *, CASE WHEN emails + phones + addresses >= 3 THEN 'remove' WHEN emails + phones + addresses > 0 THEN 'redact' WHEN urls > 0 THEN 'review' ELSE 'keep' END AS action FROM c""")
def pii_queue(spark: SparkSession, sf_dir: str) -> DataFrame:
    return curation.pii_queue(R.table(spark, sf_dir, "documents"))


@query("title_keys", """SELECT p_partkey AS id, trim(regexp_replace(regexp_replace(regexp_replace(lower('Senior ' || p_name || ' (M/F/D), Jr.'), '\\b(senior|junior|sr\\.?|jr\\.?)\\b|\\((h/f|m/f/d|f/m/d|h/f/m)\\)', ' ', 'g'), '[^\\w\\s]', ' ', 'g'), '\\s+', ' ', 'g')) AS title_norm FROM part""")
def title_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.concat(F.lit("Senior "), F.col("p_name"), F.lit(" (M/F/D), Jr."))
    return R.table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), T.title_key(t).alias("title_norm"))


@query("company_keys", """SELECT c_custkey AS id, trim(regexp_replace(regexp_replace(regexp_replace(lower(c_name || ' Sarl. & Co, Ltd'), '\\b(sarl|sas|gmbh|ltd\\.?|limited|inc\\.?|incorporated|bv|sa|ag|plc|llc|corp\\.?|corporation)\\b\\.?', ' ', 'g'), '[^\\w\\s]', ' ', 'g'), '\\s+', ' ', 'g')) AS company_norm FROM customer""")
def company_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), T.company_key(F.concat(F.col("c_name"), F.lit(" Sarl. & Co, Ltd"))).alias("company_norm"))


@query("payload_values", """SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k, CASE WHEN event_type = '' THEN NULL ELSE upper(event_type) END AS kind, CAST(value AS DOUBLE) AS amount,
  epoch_ms(1700000000000 + event_id * 1000) AS at, CAST(value AS DOUBLE) * 1 AS low FROM events""")
def payload_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = R.table(spark, sf_dir, "events")
    return e.select(
        "event_id",
        F.get_json_object("props", "$.k").cast("long").alias("k"),
        F.upper(T.optional(F.concat(F.lit(" "), F.col("event_type"), F.lit("\t")))).alias("kind"),
        T.number(F.col("value").cast("string")).alias("amount"),
        T.epoch_time((F.col("event_id") + 1700000000).cast("string")).cast("timestamp_ntz").alias("at"),
        T.whole_salary(T.number(F.col("value").cast("string")), F.lit(None).cast("double"), F.lit("eur"), F.lit("Year"))["salary_max"].alias("low"),
    )


@query("salary_texts", """SELECT o_orderkey AS id, CAST(floor(o_totalprice) AS DOUBLE) AS salary_min, CASE WHEN o_orderkey % 2 = 0 THEN CAST(floor(o_totalprice) AS DOUBLE) ELSE CAST(floor(o_totalprice) + 1000 AS DOUBLE) END AS salary_max,
  CASE o_orderkey % 4 WHEN 0 THEN 'USD' WHEN 1 THEN 'EUR' WHEN 2 THEN 'GBP' END AS salary_currency, 'year' AS salary_period FROM orders""")
def salary_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = R.table(spark, sf_dir, "orders")
    low, sign = F.floor("o_totalprice"), F.element_at(F.array(F.lit("$"), F.lit("€"), F.lit("£"), F.lit("")), (F.col("o_orderkey") % 4 + 1).cast("int"))
    text = F.concat(sign, F.format_number(low, 0), F.when(F.col("o_orderkey") % 2 == 0, "").otherwise(F.concat(F.lit(" - "), sign, F.format_number(low + 1000, 0))), F.lit(" a year"))
    return o.select(F.col("o_orderkey").alias("id"), *[v.alias(k) for k, v in T.salary_text(text).items()])
