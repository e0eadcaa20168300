"""A catalogue of table constraints, and the rows that break each: one aggregate a table, a count by key, or an anti join."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Check:
    """A condition that rows must not make false; null passes, as in SQL."""

    table: str
    rule: str
    condition: str


@dataclass(frozen=True)
class Unique:
    """Columns that no two rows share; rows with a null among them pass."""

    table: str
    columns: tuple[str, ...]


@dataclass(frozen=True)
class Foreign:
    """A column whose values another table has (or the same one); null passes."""

    table: str
    column: str
    parent: str
    key: str


def _counts(table: str, *columns: str) -> list[Check]:
    return [Check(table, f"{c}_nonnegative", f"{c} >= 0") for c in columns]


# The constraints of the tables.
CATALOGUE: list[Check | Unique | Foreign] = [
    Unique("raw_jobs", ("source", "source_id")),
    Foreign("jobs", "company_id", "companies", "company_id"),
    Unique("jobs", ("job_id",)),
    Unique("skills", ("canonical",)),
    Foreign("skills", "parent_id", "skills", "skill_id"),
    Unique("job_sources", ("job_id", "raw_job_id")),
    Foreign("job_sources", "job_id", "jobs", "job_id"),
    Foreign("job_sources", "raw_job_id", "raw_jobs", "raw_job_id"),
    Check("runs", "run_type", "run_type IN ('matcher', 'llm_experiment')"),
    Check("runs", "status", "status IN ('running', 'success', 'partial', 'failed')"),
    *_counts("runs", "jobs_total", "jobs_processed", "jobs_succeeded", "jobs_failed", "jobs_with_skills", "zero_skill_jobs"),
    Unique("job_skills", ("run_id", "job_id", "skill_id", "method")),
    Check("job_skills", "method", "method IN ('matcher', 'llm')"),
    Check("job_skills", "evidence_field", "evidence_field IN ('title', 'description')"),
    Check("job_skills", "start_nonnegative", "start_char >= 0"),
    Check("job_skills", "end_after_start", "end_char >= start_char"),
    Check("job_skills", "confidence_range", "confidence >= 0 AND confidence <= 1"),
    Foreign("job_skills", "run_id", "runs", "run_id"),
    Foreign("job_skills", "job_id", "jobs", "job_id"),
    Foreign("job_skills", "skill_id", "skills", "skill_id"),
    Unique("ledger", ("run_id", "job_id")),
    Check("ledger", "status", "status IN ('success', 'failed')"),
    *_counts("ledger", "skill_count"),
    Foreign("ledger", "run_id", "runs", "run_id"),
    Foreign("ledger", "job_id", "jobs", "job_id"),
    Unique("failures", ("run_id", "job_id", "stage")),
    Check("failures", "attempts_positive", "attempts >= 1"),
    Foreign("failures", "run_id", "runs", "run_id"),
    Foreign("failures", "job_id", "jobs", "job_id"),
]


def violations(tables: dict[str, DataFrame], catalogue: list[Check | Unique | Foreign] = CATALOGUE) -> DataFrame:
    """``(table_name, rule, n)``: how many rows break each constraint; all constraints of the given ``tables`` have a row.

    All checks of a table are one aggregate over one scan. Of rows that share a unique key all but one count; keys
    are counted before they are shuffled, so a key with a third of the rows is no burden. Values of a foreign key are
    counted first as well, so the anti join meets each of them once, however often it occurs. A foreign
    key counts only if both tables are given; an empty table breaks nothing.
    """
    out: list[DataFrame] = []
    row = lambda d, table, rule: d.select(F.lit(table).alias("table_name"), F.lit(rule).alias("rule"), F.coalesce("n", F.lit(0)).alias("n"))
    for name, table in tables.items():
        checks = [c for c in catalogue if isinstance(c, Check) and c.table == name]
        if checks:
            n = table.agg(*[F.count_if(~F.coalesce(F.expr(c.condition), F.lit(True))).alias(c.rule) for c in checks])
            pairs = F.array(*[F.struct(F.lit(c.rule).alias("rule"), F.col(c.rule).alias("n")) for c in checks])
            out.append(n.select(F.lit(name).alias("table_name"), F.explode(pairs).alias("x")).select("table_name", "x.rule", "x.n"))
        for u in [c for c in catalogue if isinstance(c, Unique) and c.table == name]:
            keys = table.dropna(subset=list(u.columns)).groupBy(*u.columns).agg((F.count("*") - 1).alias("more"))
            out.append(row(keys.agg(F.sum("more").alias("n")), name, "unique_" + "_".join(u.columns)))
        for f in [c for c in catalogue if isinstance(c, Foreign) and c.table == name and c.parent in tables]:
            values = table.where(F.col(f.column).isNotNull()).groupBy(F.col(f.column).alias("value")).agg(F.count("*").alias("c"))
            known = tables[f.parent].select(F.col(f.key).alias("value"))
            out.append(row(values.join(known, "value", "left_anti").agg(F.sum("c").alias("n")), name, f"foreign_{f.column}"))
    result = out[0]
    for d in out[1:]:
        result = result.unionByName(d)
    return result
