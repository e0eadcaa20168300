"""Reports over jobs, skills and ledgers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from postwright.functions.session import tasks_for

# Seniority words, euro rates, currencies by country.
SENIORITY = {
    "junior": r"\bjunior\b|\bdebutant\b",
    "senior": r"\bsenior\b|\bexperienced\b",
    "lead": r"\blead\b|\btech lead\b",
    "manager": r"\bmanager\b|\bhead of\b",
    "internship": r"\bintern\b|\binternship\b|\bstage\b",
    "apprenticeship": r"\bapprentice\b|\balternance\b",
}
EURO_RATES = {"EUR": 1.0, "GBP": 1.17, "USD": 0.92}
COUNTRY_CURRENCY = {"gb": "GBP", "us": "USD"}
SALARY_FLOOR = 2000.0
TRIM_FROM = 20
UNKNOWN = "(unknown)"


def percent(part: Column, whole: Column, digits: int = 1) -> Column:
    return F.when(whole > 0, F.round(part * 100 / whole, digits)).otherwise(0.0)


def seniority(title: Column, level: str) -> Column:
    return title.rlike(f"(?iU){SENIORITY[level]}")


def filtered_jobs(jobs: DataFrame, country: str | None = None, level: str | None = None, contract: str | None = None, title: str | None = None) -> DataFrame:
    if country is not None:
        jobs = jobs.where(F.lower("country") == country.lower())
    if level is not None:
        jobs = jobs.where(seniority(F.col("title"), level))
    if contract is not None:
        jobs = jobs.where(F.col("contract_type") == contract)
    if title is not None:
        jobs = jobs.where(F.col("title").ilike(f"%{title}%"))
    return jobs


def with_total(rows: DataFrame, total: DataFrame) -> DataFrame:
    """``rows`` with the one row of ``total`` beside each."""
    one = F.lit(1)
    return rows.withColumn("__one", one).join(F.broadcast(total.withColumn("__one", one)), "__one").drop("__one")


def skill_demand(jobs: DataFrame, job_skills: DataFrame, skills: DataFrame, top: int | None = None) -> DataFrame:
    """Jobs that ask for each (skill, category), as a count and a share of the jobs that were processed.

    Named skills are dealt by job, into tasks of about as many rows each; jobs are compared and told apart within them.
    """
    tasks = tasks_for(job_skills)
    named = job_skills.select("job_id", "skill_id").join(skills.select("skill_id", "skill", "category"), "skill_id").select("job_id", "skill", "category").repartition(tasks, "job_id")
    counts = named.join(jobs.select("job_id").repartition(tasks, "job_id"), "job_id", "left_semi").groupBy("skill", "category").agg(F.count_distinct("job_id").alias("job_count"))
    total = jobs.agg(F.count_distinct("job_id").alias("considered"))
    out = with_total(counts, total).withColumn("percent", percent(F.col("job_count"), F.col("considered")))
    return out.orderBy(F.col("job_count").desc(), "skill", "category").limit(top) if top else out


def average_salary(jobs: DataFrame) -> DataFrame:
    """One row: the mean yearly salary in euros, rounded, and how many jobs it is of.

    Both bounds, a year's period and a known currency (its own or its country's)
    are needed, and bounds that aren't both zero. Salaries under the floor go; of 20 or
    more, those over the element at ``int(n * 0.99)`` go as well. The element is
    found in a histogram of values, so no task sorts all salaries.
    """
    currency = F.coalesce(F.upper("salary_currency"), F.element_at(F.create_map(*[F.lit(x) for kv in COUNTRY_CURRENCY.items() for x in kv]), F.lower("country")), F.lit("EUR"))
    rate = F.element_at(F.create_map(*[F.lit(x) for kv in EURO_RATES.items() for x in kv]), currency)
    use = jobs.where("salary_period = 'year' and salary_min is not null and salary_max is not null and not (salary_min = 0 and salary_max = 0)")
    values = use.select(((F.col("salary_min") + F.col("salary_max")) / 2 * rate).alias("v")).where(F.col("v") >= SALARY_FLOOR)
    bars = values.groupBy("v").agg(F.count("*").alias("n"))
    chunk = bars.withColumn("cell", F.floor(F.log(F.col("v")) * 64))  # a few hundred cells, each a window of its own
    cells = chunk.groupBy("cell").agg(F.sum("n").alias("cell_n"))
    before = Window.orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    cells = cells.select(F.col("cell").alias("c"), F.coalesce(F.sum("cell_n").over(before), F.lit(0)).alias("first"), F.sum("cell_n").over(Window.partitionBy(F.lit(0))).alias("total"))
    placed = chunk.join(F.broadcast(cells), chunk["cell"] == F.col("c"))
    up_to = F.col("first") + F.sum("n").over(Window.partitionBy("cell").orderBy("v"))
    at = F.least(F.col("total") - 1, F.floor(F.col("total") * 0.99))
    placed = placed.withColumn("up_to", up_to).withColumn("at", at)
    cut = placed.where(F.col("up_to") > F.col("at")).agg(F.min("v").alias("cut"), F.max("total").alias("total"))
    kept = with_total(bars, cut).where((F.col("total") < TRIM_FROM) | (F.col("v") <= F.col("cut")))
    return kept.agg(F.bround(F.sum(F.col("v") * F.col("n")) / F.sum("n"), 0).cast("long").alias("average_eur"), F.coalesce(F.sum("n"), F.lit(0)).alias("n"))


def run_report(ledger: DataFrame) -> DataFrame:
    """One row: how many jobs, skills a job, shares of failures and of jobs without skills."""
    good = F.col("status") == "success"
    n = F.when(good, F.col("skill_count"))
    return ledger.agg(
        F.count("*").alias("processed"),
        F.count_if(good).alias("succeeded"),
        F.count_if(~good).alias("failed"),
        F.count_if(good & (F.col("skill_count") == 0)).alias("zero_skill"),
        F.round(F.avg(n), 4).alias("mean_skills"),
        F.median(n).alias("median_skills"),
        F.round(F.avg(F.when(n > 0, n)), 4).alias("mean_nonzero"),
        F.round(F.count_if(good & (F.col("skill_count") == 0)) / F.greatest(F.count_if(good), F.lit(1)), 4).alias("zero_rate"),
        F.round(F.count_if(~good) / F.greatest(F.count("*"), F.lit(1)), 4).alias("failure_rate"),
    )


def breakdown(ledger: DataFrame, by: str) -> DataFrame:
    """Counters by a column; null is "(unknown)"."""
    good = F.col("status") == "success"
    return ledger.groupBy(F.coalesce(by, F.lit(UNKNOWN)).alias("key")).agg(
        F.count("*").alias("processed"),
        F.count_if(good).alias("succeeded"),
        F.count_if(~good).alias("failed"),
        F.count_if(good & (F.col("skill_count") > 0)).alias("with_skills"),
        F.count_if(good & (F.col("skill_count") == 0)).alias("zero_skill"),
    )


def top_skills(job_skills: DataFrame, top: int = 30) -> DataFrame:
    rows = job_skills.groupBy("skill").agg(F.count("*").alias("skill_rows"), F.count_distinct("job_id").alias("job_count"))
    return rows.orderBy(F.col("job_count").desc(), "skill").limit(top)


def failure_stages(failures: DataFrame) -> DataFrame:
    return failures.groupBy("stage").agg(F.count("*").alias("failures"), F.sum("attempts").alias("attempts"))


def frequency_report(ledger: DataFrame, found: DataFrame, sources: DataFrame, top: int = 30, highest: int = 25, tasks: int | None = None) -> DataFrame:
    """One long table of eight metrics: ``(metric, key, secondary_key, job_count, skill_rows, rate)``.

    ``ledger``: job_id, status, skill_count, country, source (primary); ``found``:
    job_id, skill, alias; ``sources``: all sources of each job. With ``tasks`` (see ``tasks_for``)
    all three are dealt by job into so many, and meet and are counted there.
    """
    if tasks is not None:
        ledger, found, sources = (d.repartition(tasks, "job_id") for d in (ledger, found, sources))

    def shape(df: DataFrame, metric: str, key: str, second: str | None = None, rows: str | None = None, rate: str | None = None, jobs: str = "job_count") -> DataFrame:
        return df.select(
            F.lit(metric).alias("metric"),
            F.col(key).cast("string").alias("key"),
            (F.col(second).cast("string") if second else F.lit(None).cast("string")).alias("secondary_key"),
            F.col(jobs).cast("long").alias("job_count"),
            (F.col(rows).cast("long") if rows else F.lit(None).cast("long")).alias("skill_rows"),
            (F.col(rate).cast("double") if rate else F.lit(None).cast("double")).alias("rate"),
        )

    def best(df: DataFrame, *keys: str) -> DataFrame:
        return df.groupBy(*keys).agg(F.count_distinct("job_id").alias("job_count"), F.count("*").alias("skill_rows"))

    by_count = lambda df, *keys: df.orderBy(F.col("job_count").desc(), *keys).limit(top)
    country = F.coalesce("country", F.lit(UNKNOWN))
    in_country = found.join(ledger.select("job_id", country.alias("country")), "job_id")
    in_source = found.join(sources, "job_id")
    good = ledger.where("status = 'success'")
    zero = lambda key: good.groupBy(F.coalesce(key, F.lit(UNKNOWN)).alias("key")).agg(
        F.count("*").alias("job_count"), F.round(F.avg((F.col("skill_count") == 0).cast("int")), 4).alias("rate")
    )
    parts = [
        shape(by_count(best(found, "skill"), "skill"), "top_skill", "skill", rows="skill_rows"),
        shape(by_count(best(found, "alias", "skill"), "alias", "skill"), "top_alias", "alias", "skill", "skill_rows"),
        shape(best(in_source, "source", "skill").orderBy("source", F.col("job_count").desc(), "skill").limit(top), "skill_by_source", "source", "skill", "skill_rows"),
        shape(best(in_country, "country", "skill").orderBy("country", F.col("job_count").desc(), "skill").limit(top), "skill_by_country", "country", "skill", "skill_rows"),
        shape(zero("source"), "zero_rate_by_source", "key", rate="rate"),
        shape(zero("country"), "zero_rate_by_country", "key", rate="rate"),
        shape(good.groupBy("skill_count").agg(F.count("*").alias("job_count")), "skill_count", "skill_count"),
        shape(good.orderBy(F.col("skill_count").desc(), "job_id").limit(highest).withColumn("job_count", F.lit(1)), "highest_job", "job_id", rows="skill_count"),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
