"""Postings across boards: one job for equal titles, companies and countries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from postwright.functions import text as T

#: Columns of which the first value that isn't null stays.
FIRST = [
    "location_raw", "country", "city", "is_remote", "contract_type", "salary_min", "salary_max",
    "salary_currency", "salary_period", "salary_is_predicted", "posted_at", "url",
]
#: Columns that the last row overwrites.
LAST = ["title", "title_norm", "description"]


def job_hash(title_norm: Column, company_norm: Column, country: Column) -> Column:
    key = F.concat(title_norm, F.lit("|"), company_norm, F.lit("|"), F.coalesce(country, F.lit("")))
    return F.sha2(key.cast("binary"), 256)


def with_keys(parsed: DataFrame) -> DataFrame:
    keyed = parsed.withColumn("title_norm", T.title_key(F.col("title"))).withColumn("company_norm", T.company_key(F.col("company_name")))
    return keyed.withColumn("job_hash", job_hash(F.col("title_norm"), F.col("company_norm"), F.col("country")))


def first_known(column: str, order: str) -> Column:
    """The first value by ``order`` that isn't null."""
    return F.min_by(F.col(column), F.when(F.col(column).isNotNull(), F.col(order)))


def merge(rows: DataFrame, key: str, order: str, first: list[str], last: list[str]) -> DataFrame:
    """One row for each ``key``: the first known values of some columns, the last values of others.

    Partial aggregates in every task: a key that very many rows share costs a row a task.
    """
    return rows.groupBy(key).agg(
        F.min(order).alias(f"first_{order}"),
        *[first_known(c, order).alias(c) for c in first],
        *[F.max_by(c, order).alias(c) for c in last],
    )


def jobs(keyed: DataFrame) -> DataFrame:
    """Jobs of keyed postings; the id of a job is that of its first raw row."""
    own = merge(keyed, "job_hash", "raw_job_id", [*FIRST, "company_norm"], LAST)
    return own.withColumnRenamed("first_raw_job_id", "job_id")


def companies(keyed: DataFrame) -> DataFrame:
    """Companies by key, under the name that was seen first."""
    return keyed.groupBy(F.col("company_norm").alias("name_norm")).agg(
        F.min_by("company_name", "raw_job_id").alias("name"), F.min("raw_job_id").alias("company_id")
    )


def links(keyed: DataFrame, found: DataFrame) -> DataFrame:
    """``(job_id, raw_job_id)``, each once."""
    return keyed.join(found.select("job_hash", "job_id"), "job_hash").select("job_id", "raw_job_id").distinct()


def dedup_report(raw: DataFrame, linked: DataFrame) -> DataFrame:
    """Raw rows, links and jobs of each source and of all (source null), and links a job."""
    rows = raw.select("raw_job_id", "source").join(linked, "raw_job_id", "left")
    counts = [
        F.count_distinct("raw_job_id").alias("raw_rows"),
        F.count("job_id").alias("linked_rows"),
        F.count_distinct("job_id").alias("unique_jobs"),
    ]
    report = rows.groupBy("source").agg(*counts).unionByName(rows.agg(*counts).withColumn("source", F.lit(None).cast("string")))
    factor = F.when(F.col("unique_jobs") > 0, F.col("linked_rows") / F.col("unique_jobs")).otherwise(0.0)
    return report.withColumn("dedup_factor", factor)


def primary_source(linked: DataFrame, raw: DataFrame) -> DataFrame:
    """The smallest source of each job."""
    return linked.join(raw.select("raw_job_id", "source"), "raw_job_id").groupBy("job_id").agg(F.min("source").alias("source"))


def best_per_job(scored: DataFrame, score: str = "score") -> DataFrame:
    """The best row of each profile and job; ties go to the smaller ``row_id``."""
    best = Window.partitionBy("profile_id", "job_id").orderBy(F.col(score).desc(), "row_id")
    return scored.withColumn("__n", F.row_number().over(best)).where("__n = 1").drop("__n")
