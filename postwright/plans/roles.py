"""The given tables in the roles of postings, skills, runs, profiles and texts.

Each role has a DataFrame and the SQL of the same rows, for the oracles.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from postwright.functions.session import tasks_for


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# Countries of three nations have a currency of their own; others are taken as euros.
COUNTRY = "CASE n_nationkey WHEN 1 THEN 'gb' WHEN 2 THEN 'us' WHEN 3 THEN NULL ELSE lower(n_name) END"
TITLE = "CASE substr(o_orderpriority, 1, 1) WHEN '1' THEN 'Senior Data Engineer' WHEN '2' THEN 'Junior Data Scientist (m/f/d)' WHEN '3' THEN 'Lead Developer' WHEN '4' THEN 'Consultant' ELSE 'Intern, Back-end' END"

JOBS_SQL = f"""jobs AS (
  SELECT o_orderkey AS job_id, {TITLE} AS title, {COUNTRY} AS country, o_orderpriority AS contract_type,
    CASE WHEN o_orderkey % 11 = 0 THEN NULL ELSE o_totalprice / 4 END AS salary_min,
    CASE WHEN o_orderkey % 11 = 0 THEN NULL WHEN o_orderkey % 97 = 0 THEN 0 ELSE o_totalprice / 2 END AS salary_max,
    CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE 'EUR' END AS salary_currency, 'year' AS salary_period,
    o_orderdate AS posted_at, c_name AS company_name, CASE o_orderstatus WHEN 'P' THEN 'failed' ELSE 'success' END AS status
  FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
)"""


def jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as jobs: the customer is the company, its nation the country, the total price the salary."""
    o, c, n = (table(spark, sf_dir, t) for t in ("orders", "customer", "nation"))
    d = o.join(c, o.o_custkey == c.c_custkey).join(n, c.c_nationkey == n.n_nationkey)
    return d.selectExpr(
        "o_orderkey AS job_id",
        f"{TITLE} AS title",
        f"{COUNTRY} AS country",
        "o_orderpriority AS contract_type",
        "CASE WHEN o_orderkey % 11 = 0 THEN NULL ELSE o_totalprice / 4 END AS salary_min",
        "CASE WHEN o_orderkey % 11 = 0 THEN NULL WHEN o_orderkey % 97 = 0 THEN 0 ELSE o_totalprice / 2 END AS salary_max",
        "CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE 'EUR' END AS salary_currency",
        "'year' AS salary_period",
        "o_orderdate AS posted_at",
        "c_name AS company_name",
        "CASE o_orderstatus WHEN 'P' THEN 'failed' ELSE 'success' END AS status",
    )


JOB_SKILLS_SQL = "job_skills AS (SELECT l_orderkey AS job_id, l_partkey AS skill_id, l_suppkey AS supplier_id, l_linenumber AS line, CASE l_linestatus WHEN 'O' THEN 1 ELSE 2 END AS run_id, l_returnflag AS source, l_quantity AS weight FROM lineitem)"


def job_skills(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of orders as skills of jobs."""
    return table(spark, sf_dir, "lineitem").selectExpr(
        "l_orderkey AS job_id", "l_partkey AS skill_id", "l_suppkey AS supplier_id", "l_linenumber AS line",
        "CASE l_linestatus WHEN 'O' THEN 1 ELSE 2 END AS run_id", "l_returnflag AS source", "l_quantity AS weight",
    )


SKILLS_SQL = "skills AS (SELECT p_partkey AS skill_id, p_name AS skill, p_type AS category, p_brand AS alias FROM part)"


def skills(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as skills: the name is the skill, the type its category."""
    return table(spark, sf_dir, "part").selectExpr("p_partkey AS skill_id", "p_name AS skill", "p_type AS category", "p_brand AS alias")


LEDGER_SQL = "ledger AS (SELECT j.job_id, j.status, j.country, CASE WHEN j.status = 'failed' THEN 0 ELSE coalesce(s.n, 0) END AS skill_count FROM jobs j LEFT JOIN (SELECT job_id, count(DISTINCT skill_id) AS n FROM job_skills GROUP BY job_id) s ON j.job_id = s.job_id)"


def ledger(spark: SparkSession, sf_dir: str, tasks: int | None = None) -> DataFrame:
    """Jobs with their status and number of skills, dealt by job into ``tasks`` if that is given."""
    dealt = lambda rows: rows if tasks is None else rows.repartition(tasks, "job_id")
    n = dealt(job_skills(spark, sf_dir).select("job_id", "skill_id")).groupBy("job_id").agg(F.count_distinct("skill_id").alias("n"))
    j = dealt(jobs(spark, sf_dir).select("job_id", "status", "country")).join(n, "job_id", "left")
    return j.select("job_id", "status", "country", F.when(F.col("status") == "failed", 0).otherwise(F.coalesce("n", F.lit(0))).cast("long").alias("skill_count"))


# Suppliers are the profiles: a profile has the five parts that it supplies most of.
LEVELS = "CASE s_suppkey % 5 WHEN 0 THEN 'student' WHEN 1 THEN 'junior' WHEN 2 THEN 'mid' WHEN 3 THEN 'senior' ELSE 'unknown' END"
PROFILES_SQL = f"""profile_skills AS (
  SELECT profile_id, skill FROM (
    SELECT supplier_id AS profile_id, skill_id AS skill, row_number() OVER (PARTITION BY supplier_id ORDER BY sum(weight) DESC, skill_id) AS r
    FROM job_skills GROUP BY supplier_id, skill_id) WHERE r <= 5
), profiles AS (
  SELECT s_suppkey AS profile_id, {LEVELS} AS career_level, CASE WHEN s_suppkey % 7 = 0 THEN NULL ELSE s_suppkey % 13 * 0.5 END AS total_years,
    {COUNTRY} AS country FROM supplier JOIN nation ON s_nationkey = n_nationkey
)"""


def profile_skills(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window

    w = job_skills(spark, sf_dir).groupBy(F.col("supplier_id").alias("profile_id"), F.col("skill_id").alias("skill")).agg(F.sum("weight").alias("w"))
    best = Window.partitionBy("profile_id").orderBy(F.col("w").desc(), "skill")
    return w.withColumn("r", F.row_number().over(best)).where("r <= 5").select("profile_id", "skill")


def profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers as profiles with the columns that scoring reads; skills are part keys as text."""
    s, n = table(spark, sf_dir, "supplier"), table(spark, sf_dir, "nation")
    own = profile_skills(spark, sf_dir).groupBy("profile_id").agg(F.sort_array(F.collect_list(F.col("skill").cast("string"))).alias("skills"))
    d = s.join(n, s.s_nationkey == n.n_nationkey).selectExpr(
        "s_suppkey AS profile_id", f"{LEVELS} AS career_level",
        "CASE WHEN s_suppkey % 7 = 0 THEN NULL ELSE cast(s_suppkey % 13 * 0.5 AS double) END AS total_years", f"{COUNTRY} AS country",
    )
    none = F.expr("cast(array() as array<string>)")
    domains = F.when(F.col("profile_id") % 3 == 0, F.array(F.lit("Data Science"))).when(F.col("profile_id") % 3 == 1, F.array(F.lit("Sales"))).otherwise(none)
    return d.join(own, "profile_id", "left").select(
        "profile_id", F.coalesce("skills", none).alias("skills"), "career_level", "total_years", domains.alias("domains"), "country",
        F.lit(None).cast("string").alias("city"), F.lit(None).cast("boolean").alias("remote"),
    )


def match_jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders with the columns that scoring reads; lines are dealt by job before their lists are made, not lists of single lines."""
    lines = job_skills(spark, sf_dir).select("job_id", "skill_id")
    lists = lines.repartition(tasks_for(lines), "job_id").groupBy("job_id").agg(F.sort_array(F.collect_set(F.col("skill_id").cast("string"))).alias("skills"))
    d = jobs(spark, sf_dir).join(lists, "job_id")
    p = F.substring("contract_type", 1, 1)
    pick = lambda *v: F.element_at(F.array(*v), p.cast("int"))
    text = lambda *v: pick(*[F.lit(x) for x in v])
    arrays = lambda *v: pick(*[F.array(*[F.lit(y) for y in x]) if x else F.expr("cast(array() as array<string>)") for x in v])
    return d.select(
        "job_id", "title", "skills", "country", F.lit(None).cast("string").alias("city"),
        text("senior", "junior", "lead", "consultant", "internship").alias("career_level"),
        pick(F.lit(5.0), F.lit(1.0), F.lit(4.0), F.lit(None).cast("double"), F.lit(None).cast("double")).alias("min_years"),
        arrays(["cdi"], ["cdi"], ["freelance"], [], ["stage"]).alias("job_types"),
        arrays(["Data Engineering"], ["Data Science"], ["Software Engineering"], [], ["Backend", "AI"]).alias("domains"),
        F.lit(None).cast("string").alias("remote_mode"),
    )


POSTINGS_SQL = """postings AS (
  SELECT doc_id AS job_id, split_part(text, chr(10), 1) AS title,
    CASE WHEN instr(text, chr(10)) > 0 THEN substr(text, instr(text, chr(10)) + 1) ELSE '' END AS description, source, lang AS country, text FROM documents
)"""


def postings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as postings: the first line is the title, the rest the description."""
    d = table(spark, sf_dir, "documents")
    return d.select(
        F.col("doc_id").alias("job_id"),
        F.split_part("text", F.lit("\n"), F.lit(1)).alias("title"),
        F.when(F.instr("text", "\n") > 0, F.expr("substring(text, instr(text, '\\n') + 1)")).otherwise("").alias("description"),
        "source",
        F.col("lang").alias("country"),
        "text",
    )
