"""Enrichment runs: which jobs, their ledger, counters and status."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def selected_jobs(jobs: DataFrame, links: DataFrame | None = None, raw: DataFrame | None = None, country: str | None = None, source: str | None = None, from_id: int | None = None, to_id: int | None = None, limit: int | None = None) -> DataFrame:
    """Jobs of a country, an id range and a source that any of their raw rows has, by id."""
    if country is not None:
        jobs = jobs.where(F.lower("country") == country.lower())
    if from_id is not None:
        jobs = jobs.where(F.col("job_id") >= from_id)
    if to_id is not None:
        jobs = jobs.where(F.col("job_id") <= to_id)
    if source is not None and links is not None and raw is not None:
        jobs = jobs.join(links.join(raw.where(F.col("source") == source), "raw_job_id").select("job_id"), "job_id", "left_semi")
    return jobs.orderBy("job_id").limit(limit) if limit is not None else jobs


def not_done(jobs: DataFrame, ledger: DataFrame, runs: DataFrame, matcher_version: str, ontology_version: str) -> DataFrame:
    """Jobs that no run of these versions has finished with success."""
    same = runs.where((F.col("matcher_version") == matcher_version) & (F.col("ontology_version") == ontology_version))
    done = ledger.where("status = 'success'").join(same.select("run_id"), "run_id", "left_semi")
    return jobs.join(done.select("job_id"), "job_id", "left_anti")


def to_resume(jobs: DataFrame, ledger: DataFrame, run_id: int) -> DataFrame:
    """Jobs that the run itself hasn't finished with success."""
    done = ledger.where((F.col("run_id") == run_id) & (F.col("status") == "success"))
    return jobs.join(done.select("job_id"), "job_id", "left_anti")


def ledger(run_id: int, jobs: DataFrame, found: DataFrame, failures: DataFrame) -> DataFrame:
    """A row for each job that was tried, jobs without skills included."""
    n = found.groupBy("job_id").agg(F.count_distinct("canonical").alias("n"))
    failed = failures.select("job_id", F.lit(True).alias("failed")).distinct()
    rows = jobs.select("job_id").join(n, "job_id", "left").join(failed, "job_id", "left")
    return rows.select(
        F.lit(run_id).alias("run_id"),
        "job_id",
        F.when(F.col("failed"), "failed").otherwise("success").alias("status"),
        F.when(F.col("failed"), 0).otherwise(F.coalesce("n", F.lit(0))).cast("long").alias("skill_count"),
    )


def merged_failures(old: DataFrame, new: DataFrame) -> DataFrame:
    """Failures of both with their attempts added up and the newest error."""
    both = old.select("run_id", "job_id", "stage", "attempts", "error", F.lit(0).alias("age")).union(
        new.select("run_id", "job_id", "stage", F.lit(1).cast("long"), "error", F.lit(1))
    )
    return both.groupBy("run_id", "job_id", "stage").agg(F.sum("attempts").alias("attempts"), F.max_by("error", "age").alias("error"))


def counters(rows: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Processed, succeeded, failed, with and without skills, in one pass."""
    good = F.col("status") == "success"
    return rows.groupBy(*(by or [])).agg(
        F.count("*").alias("processed"),
        F.count_if(good).alias("succeeded"),
        F.count_if(~good).alias("failed"),
        F.count_if(good & (F.col("skill_count") > 0)).alias("with_skills"),
        F.count_if(good & (F.col("skill_count") == 0)).alias("zero_skill"),
    )


def run_status(total: Column, processed: Column, succeeded: Column, failed: Column) -> Column:
    return (
        F.when((total == 0) | ((failed == 0) & (processed >= total)), "success").when(succeeded > 0, "partial").otherwise("failed")
    )


def out_of_sync(ontology: DataFrame, table: DataFrame) -> DataFrame:
    """``(canonical, side)`` of names that only one side has: a run may start when there is none."""
    a = ontology.select("canonical").join(table.select("canonical"), "canonical", "left_anti").withColumn("side", F.lit("ontology"))
    b = table.select("canonical").join(ontology.select("canonical"), "canonical", "left_anti").withColumn("side", F.lit("table"))
    return a.union(b)


def latest_run(runs: DataFrame) -> DataFrame:
    """One row: the newest matcher run with success, whole or in part."""
    usable = (F.col("run_type") == "matcher") & F.col("status").isin("success", "partial")
    return runs.where(usable).agg(F.max("run_id").alias("run_id"))
