"""Data-quality audits: evidence, samples, reviews, constraints."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from postwright.functions.text import alias_key

FIELDS = ["title", "description"]
# Short words that are aliases and everyday words.
AMBIGUOUS = ["ai", "bi", "c", "ci", "go", "it", "ml", "nlp", "qa", "r", "chef", "jira", "monday", "notion", "tableau"]


def evidence_violations(found: DataFrame, jobs: DataFrame, skills: DataFrame) -> DataFrame:
    """``(row_id, violation)``: what is wrong with each row of evidence.

    ``found``: row_id, run_id, job_id, skill, method, alias, evidence_field, start, end, evidence.
    A row without its job, skill or field, or with wrong offsets, isn't judged further.
    """
    again = Window.partitionBy("run_id", "job_id", "skill", "method").orderBy("row_id")
    rows = found.withColumn("__twice", F.row_number().over(again) > 1)
    j = jobs.select("job_id", "title", "description", F.lit(True).alias("__job"))
    s = skills.select("skill", F.lit(True).alias("__skill")).dropDuplicates(["skill"])
    rows = rows.join(j, "job_id", "left").join(s, "skill", "left")
    field = F.when(F.col("evidence_field") == "title", F.coalesce("title", F.lit(""))).when(F.col("evidence_field") == "description", F.coalesce("description", F.lit("")))
    rows = rows.withColumn("__field", field)
    known = F.coalesce(F.col("__job") & F.col("__skill"), F.lit(False))
    right_field = F.coalesce(F.col("evidence_field").isin(FIELDS), F.lit(False))
    ordered = F.coalesce((F.col("start") >= 0) & (F.col("start") <= F.col("end")), F.lit(False))
    inside = F.coalesce(F.col("end") <= F.char_length("__field"), F.lit(False))
    text = F.substring("__field", (F.col("start") + 1).cast("int"), (F.col("end") - F.col("start")).cast("int"))
    flat = lambda c: F.lower(F.regexp_replace(c, r"\s+", " "))
    say = lambda cond, what: F.when(cond, F.lit(what))
    kinds = F.array(
        say(F.col("__twice"), "duplicate"),
        say(F.col("__job").isNull(), "missing_job"),
        say(F.col("__skill").isNull(), "missing_skill"),
        say(known & ~right_field, "invalid_evidence_field"),
        say(known & right_field & ~ordered, "invalid_offsets"),
        say(known & right_field & ordered & ~inside, "offset_out_of_range"),
        say(known & right_field & ordered & inside & ~text.eqNullSafe(F.col("evidence")), "evidence_text_mismatch"),
        say(known & right_field & ordered & inside & ~flat(F.col("evidence")).eqNullSafe(flat(F.col("alias"))), "matched_alias_mismatch"),
    )
    return rows.select("row_id", F.explode(F.filter(kinds, lambda k: k.isNotNull())).alias("violation"))


def sample_key(seed: str, id_col: Column) -> Column:
    """A hash order of ids: the same sample whatever the partitions."""
    return F.sha2(F.concat(F.lit(f"{seed}:"), id_col.cast("string")).cast("binary"), 256)


def sample(rows: DataFrame, id_col: str, n: int, seed: str) -> DataFrame:
    return rows.orderBy(sample_key(seed, F.col(id_col)), id_col).limit(n)


def sample_by_group(rows: DataFrame, group: str, id_col: str, n: int, seed: str) -> DataFrame:
    """At most ``n`` rows of each group, all groups in one pass."""
    order = Window.partitionBy(group).orderBy(sample_key(seed, F.col(id_col)), id_col)
    return rows.withColumn("__n", F.row_number().over(order)).where(F.col("__n") <= n).drop("__n")


def top_skill_review(found: DataFrame, top: int = 10, each: int = 10, seed: str = "review", force: str | None = "Artificial Intelligence") -> DataFrame:
    """A sample of jobs for each of the commonest skills (and the forced one)."""
    counts = found.groupBy("skill").agg(F.count_distinct("job_id").alias("jobs"))
    best = counts.orderBy(F.col("jobs").desc(), "skill").limit(top).select("skill")
    if force is not None:
        best = best.union(counts.where(F.col("skill") == force).select("skill")).distinct()
    return sample_by_group(found.select("skill", "job_id").distinct().join(F.broadcast(best), "skill"), "skill", "job_id", each, seed)


def zero_skill_review(ledger: DataFrame, n: int = 50, seed: str = "zero") -> DataFrame:
    return sample(ledger.where("status = 'success' and skill_count = 0"), "job_id", n, seed)


def high_count_review(ledger: DataFrame, found: DataFrame, n: int = 25) -> DataFrame:
    """The jobs with most skills, with their skills and a string of the evidence."""
    most = ledger.where("status = 'success'").orderBy(F.col("skill_count").desc(), "job_id").limit(n).select("job_id", "skill_count")
    rows = found.join(F.broadcast(most), "job_id").groupBy("job_id", "skill_count")
    listed = F.sort_array(F.collect_list(F.struct("skill", "alias")))
    return rows.agg(listed.alias("l")).select(
        "job_id",
        "skill_count",
        F.array_join(F.array_distinct(F.transform("l", lambda x: x["skill"])), ", ").alias("skills"),
        F.array_join(F.transform("l", lambda x: F.concat(x["skill"], F.lit("="), x["alias"])), "; ").alias("evidence"),
    )


def is_ambiguous(alias: Column) -> Column:
    """Short aliases, such with punctuation, short capitals and everyday words."""
    key = alias_key(alias)
    return (F.char_length(key) <= 3) | alias.rlike(r"(?U)[^\w\s]") | ((F.char_length(alias) <= 5) & (alias == F.upper(alias)) & (alias != F.lower(alias))) | key.isin(AMBIGUOUS)


def ambiguous_review(found: DataFrame, texts: DataFrame, n: int = 100, width: int = 80) -> DataFrame:
    """The first hits of ambiguous aliases with the text around them."""
    rows = found.where(is_ambiguous(F.col("alias"))).orderBy("job_id", "start", "alias").limit(n)
    left = F.greatest(F.col("start") - width, F.lit(0))
    around = F.substring("text", (left + 1).cast("int"), (F.col("end") + width - left).cast("int"))
    return rows.join(texts, "job_id").select("job_id", "alias", "start", excerpt(around, 10_000).alias("context"))


def excerpt(text: Column, size: int = 320) -> Column:
    return F.substring(F.trim(F.regexp_replace(text, r"\s+", " ")), 1, size)
