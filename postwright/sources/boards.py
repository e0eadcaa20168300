"""Landed pages of job boards: raw rows, idempotent append, incremental selection."""

from __future__ import annotations

import traceback
import uuid
from datetime import datetime, timezone

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F

RAW_SCHEMA = "raw_job_id bigint, source string, source_id string, payload string, fetched_at timestamp"


def pages(spark: SparkSession, path: str) -> DataFrame:
    """Landed page files, one row each: ``page``, ``path``."""
    return spark.read.text(path, wholetext=True).select(F.col("value").alias("page"), F.input_file_name().alias("path"))


def adzuna_rows(landed: DataFrame, page: str = "page") -> DataFrame:
    """``(source, source_id, payload)`` of the results that have an id."""
    each = landed.select(F.explode(F.from_json(page, "results array<string>")["results"]).alias("payload"))
    return _with_id(each, "adzuna", F.get_json_object("payload", "$.id"))


def remoteok_rows(landed: DataFrame, page: str = "page") -> DataFrame:
    """As above; the first element is a legal notice, and what isn't an object is skipped."""
    each = landed.select(F.posexplode(F.from_json(page, "array<string>")).alias("pos", "payload"))
    each = each.where("pos > 0 and payload like '{%'").drop("pos")
    return _with_id(each, "remoteok", F.get_json_object("payload", "$.id"))


def jooble_rows(landed: DataFrame, page: str = "page") -> tuple[DataFrame, DataFrame]:
    """Rows and rejects: the id, else the SHA-256 of the link; a row with neither is a reject."""
    each = landed.select(F.explode(F.from_json(page, "jobs array<string>")["jobs"]).alias("payload"))
    own = F.nullif(F.trim(F.get_json_object("payload", "$.id")), F.lit(""))
    link = F.nullif(F.trim(F.get_json_object("payload", "$.link")), F.lit(""))
    each = each.select(
        F.lit("jooble").alias("source"), F.coalesce(own, F.sha2(link.cast("binary"), 256)).alias("source_id"), "payload"
    )
    rejects = each.where("source_id is null").select("source", "payload", F.lit("no id and no link").alias("reason"))
    return each.where("source_id is not null"), rejects


def _with_id(each: DataFrame, source: str, own: F.Column) -> DataFrame:
    rows = each.select(F.lit(source).alias("source"), own.alias("source_id"), "payload")
    return rows.where("source_id is not null")


def new_rows(batch: DataFrame, existing: DataFrame, order: str) -> DataFrame:
    """The rows of ``batch`` that ``existing`` hasn't: of several with one key the first by ``order``."""
    key = ["source", "source_id"]
    first = F.row_number().over(Window.partitionBy(*key).orderBy(order))
    return batch.withColumn("__n", first).where("__n = 1").drop("__n").join(existing.select(*key), key, "left_anti")


def append_new(batch: DataFrame, target: str, order: str) -> int:
    """Append the new rows of ``batch`` to the Parquet table ``target``; the number of rows added.

    Appending a batch again adds nothing. One writer at a time.
    """
    spark = batch.sparkSession
    try:
        existing = spark.read.parquet(target)
    except Exception as e:  # noqa: BLE001  the table isn't there yet
        if "PATH_NOT_FOUND" not in str(e) and "UNABLE_TO_INFER_SCHEMA" not in str(e):
            raise
        existing = batch.limit(0)
    inserted = Observation()
    new_rows(batch, existing, order).observe(inserted, F.count(F.lit(1)).alias("n")).write.mode("append").partitionBy("source").parquet(target)
    return observed(inserted)


def observed(rows: Observation) -> int:
    """What a finished write has counted; a batch that is known to be empty is optimised away, and its count with it."""
    try:
        return rows.get.get("n", 0)
    except Py4JJavaError as e:
        if "AssertionError" not in str(e.java_exception):
            raise
        return 0


RUN = "run_id string, source string, started_at timestamp, finished_at timestamp, status string, rows_fetched long, rows_inserted long, error string"


def ingest_run(batch: DataFrame, target: str, runs: str, source: str, order: str = "raw_job_id") -> str:
    """Append the new rows of ``batch`` to ``target`` and a row on the run to ``runs``; the id of the run.

    Rows are counted by the write itself, as they pass: those fetched before keys are compared, those inserted after.
    A run that fails leaves one row with the status ``failed`` and its traceback, whatever it had
    counted till then, and raises what it met. ``target`` shows all of a run's rows or, if it failed, none.
    """
    spark, run_id, started = batch.sparkSession, uuid.uuid4().hex, datetime.now(timezone.utc)
    fetched = Observation()
    counted = batch.observe(fetched, F.count(F.lit(1)).alias("n"))

    def record(status: str, n: int, inserted: int, error: str | None) -> None:
        row = (run_id, source, started, datetime.now(timezone.utc), status, n, inserted, error)
        spark.createDataFrame([row], RUN).coalesce(1).write.mode("append").parquet(runs)

    try:
        inserted = append_new(counted, target, order)
    except Exception:
        record("failed", 0, 0, traceback.format_exc())
        raise
    record("success", observed(fetched), inserted, None)
    return run_id


def run_audit(batch: DataFrame, existing: DataFrame, order: str) -> DataFrame:
    """A row for each source: ``rows_fetched``, ``rows_inserted``, ``status``."""
    fresh = new_rows(batch, existing, order).groupBy("source").agg(F.count("*").alias("rows_inserted"))
    return (
        batch.groupBy("source")
        .agg(F.count("*").alias("rows_fetched"))
        .join(fresh, "source", "left")
        .select("source", "rows_fetched", F.coalesce("rows_inserted", F.lit(0)).alias("rows_inserted"), F.lit("success").alias("status"))
    )


def unparsed(raw: DataFrame, linked: DataFrame, rejects: DataFrame, source: str | None = None) -> DataFrame:
    """Raw rows that no parse has taken or rejected, of one source or all, by id."""
    rows = raw if source is None else raw.where(F.col("source") == source)
    rows = rows.join(linked.select("raw_job_id"), "raw_job_id", "left_anti")
    return rows.join(rejects.select("raw_job_id"), "raw_job_id", "left_anti")


def for_reparse(raw: DataFrame, source: str) -> DataFrame:
    """All raw rows of a source, parsed or not: nothing is marked, so nothing is to be reset."""
    if not source:
        raise ValueError("a re-parse needs a source")
    return raw.where(F.col("source") == source)
