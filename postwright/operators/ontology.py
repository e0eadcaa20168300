"""The skills dimension: aliases, checks, versions, synchronisation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from postwright.functions.text import alias_key

# The categories of skills.
CATEGORIES = ["language", "framework", "tool", "platform", "database", "cloud", "methodology", "soft_skill", "domain"]
#: Categories that candidates' skills are bucketed by.
BUCKETS = ["language", "database", "framework", "cloud"]


def alias_index(skills: DataFrame) -> DataFrame:
    """``(canonical, alias, alias_ord, folded)``: the canonical name is alias 0."""
    names = F.concat(F.array("canonical"), F.coalesce("aliases", F.expr("cast(array() as array<string>)")))
    rows = skills.select("canonical", F.posexplode(names).alias("alias_ord", "alias"))
    return rows.withColumn("folded", alias_key(F.col("alias"))).where("folded <> ''")


def alias_conflicts(index: DataFrame) -> DataFrame:
    """Aliases that several skills claim."""
    return index.groupBy("folded").agg(F.count_distinct("canonical").alias("claims"), F.sort_array(F.collect_set("canonical")).alias("canonicals")).where("claims > 1")


def violations(skills: DataFrame, categories: list[str] = CATEGORIES) -> DataFrame:
    """``(canonical, problem)``: duplicate names, unknown categories, unknown parents."""
    twice = skills.groupBy("canonical").agg(F.count("*").alias("n")).where("n > 1").select("canonical", F.lit("duplicate").alias("problem"))
    category = skills.where(~F.col("category").isin(categories)).select("canonical", F.lit("unknown_category").alias("problem"))
    names = skills.select(F.col("canonical").alias("parent")).distinct()
    orphan = skills.where("parent is not null").join(names, "parent", "left_anti").select("canonical", F.lit("unknown_parent").alias("problem"))
    return twice.union(category).union(orphan)


def resolve(rows: DataFrame, raw: str, index: DataFrame, out: str = "canonical") -> DataFrame:
    """``rows`` with the skill that the alias in ``raw`` names, or null."""
    names = index.select(F.col("folded").alias("__folded"), F.col("canonical").alias(out)).dropDuplicates(["__folded"])
    return rows.join(names, alias_key(F.col(raw)) == F.col("__folded"), "left").drop("__folded")


def version(skills: DataFrame) -> DataFrame:
    """One row with the SHA-256 of the entries in order of their names: independent of row order."""
    entry = F.to_json(F.struct("canonical", "category", F.sort_array("aliases").alias("aliases"), F.coalesce("parent", F.lit("")).alias("parent")))
    return skills.select(entry.alias("e")).agg(F.sha2(F.array_join(F.sort_array(F.collect_list("e")), ",").cast("binary"), 256).alias("version"))


def sync_plan(ontology: DataFrame, table: DataFrame) -> DataFrame:
    """``(canonical, action)``: insert, update, keep, or extra (in the table alone, never deleted)."""
    a = ontology.select("canonical", F.struct("category", "parent").alias("want"), F.lit(1).alias("a"))
    b = table.select("canonical", F.struct("category", "parent").alias("have"), F.lit(1).alias("b"))
    action = F.when(F.col("b").isNull(), "insert").when(F.col("a").isNull(), "extra").when(~F.col("want").eqNullSafe(F.col("have")), "update").otherwise("keep")
    return a.join(b, "canonical", "full_outer").select("canonical", action.alias("action"))


def with_parent_ids(skills: DataFrame) -> DataFrame:
    """``parent_id`` of each skill by a self join on the name."""
    up = skills.select(F.col("canonical").alias("__p"), F.col("skill_id").alias("parent_id"))
    return skills.join(up, skills["parent"] == F.col("__p"), "left").drop("__p")


def buckets(profile_skills: DataFrame, skills: DataFrame) -> DataFrame:
    """Sorted skills of each profile by category, a column for each bucket."""
    rows = profile_skills.join(skills.select("canonical", "category"), "canonical")
    return rows.groupBy("profile_id").pivot("category", BUCKETS).agg(F.sort_array(F.collect_set("canonical")))


def specificity(canonical: Column, generic: list[str], specialised: list[str]) -> Column:
    return F.when(canonical.isin(generic), "generic").when(canonical.isin(specialised), "specialized").otherwise("standard")
