"""What a question names: country, contract, seniority, role and skills, by fixed words and the ontology."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from postwright.functions.text import alias_key

# Names of countries.
COUNTRIES = {
    "fr": ["fr", "france", "french", "français", "francais"],
    "de": ["de", "germany", "german", "deutschland", "allemagne"],
    "es": ["es", "spain", "spanish", "espagne", "españa"],
    "gb": ["gb", "uk", "u.k.", "united kingdom", "britain", "british", "england", "angleterre"],
    "it": ["it", "italy", "italian", "italie"],
    "nl": ["nl", "netherlands", "dutch", "holland", "pays-bas", "pays bas"],
}
COUNTRY_CODE = r"(?U)\b(?:country|pays)\s*(?:=|:|is|est)\s*([a-z]{2})\b"
# Names of contracts.
CONTRACTS = {
    "full_time": ["full_time", "full-time", "full time", "cdi", "permanent"],
    "part_time": ["part_time", "part-time", "part time"],
    "contract": ["contract", "contractor", "freelance", "cdd", "temporary"],
}
# Wording of career levels, in order.
SENIORITY = {
    "junior": r"\bjunior\b|\bdebutant\b",
    "senior": r"\bsenior\b|\bsr\b|\bconfirme\b|\bexperimente\b",
    "lead": r"\blead\b|tech lead|leader technique",
    "manager": r"\bmanager\b|responsable|head of|chef de projet",
    "internship": r"\bstage\b|stagiaire|internship|intern",
    "apprenticeship": r"alternance|apprenti|apprentice",
}
# Titles of roles.
ROLES = [
    "data scientist", "data engineer", "data analyst", "machine learning engineer", "ml engineer", "ai engineer", "software engineer", "software developer",
    "backend developer", "backend engineer", "frontend developer", "frontend engineer", "full stack developer", "fullstack developer", "devops engineer",
    "cloud engineer", "security engineer", "product manager", "project manager", "business analyst", "qa engineer", "data architect", "solutions architect",
]
#: Words of a question, as far as skills are written with them.
WORD = r"[\p{L}\p{N}_+.#/-]+"
#: Words of the longest skill that is looked for, and skills of a question.
WINDOW, MOST = 4, 3
#: Ontologies of more aliases are joined by shuffle.
BROADCAST_ALIASES = 200_000


def named(question: Column, names: dict[str, list[str]], shortest: int = 1) -> Column:
    """The value whose name stands in the question as a whole; the longest name decides, the earlier of equally long ones."""
    low = F.lower(question)
    pairs = sorted(((name, value) for value, own in names.items() for name in own if len(name) >= shortest), key=lambda p: -len(p[0]))
    return F.coalesce(*[F.when(low.rlike(rf"(?U)\b{re.escape(name)}\b"), F.lit(value)) for name, value in pairs])


def country(question: Column) -> Column:
    """By name, else by a code that is said to be one: a bare "it" or "de" is no country."""
    code = F.regexp_extract(F.lower(question), COUNTRY_CODE, 1)
    return F.coalesce(named(question, COUNTRIES, 3), F.when(code.isin(list(COUNTRIES)), code))


def seniority(question: Column) -> Column:
    return F.coalesce(*[F.when(F.lower(question).rlike(f"(?U){pattern}"), F.lit(level)) for level, pattern in SENIORITY.items()])


def contract(question: Column) -> Column:
    return named(question, CONTRACTS)


def role(question: Column) -> Column:
    low = F.lower(question)
    return F.coalesce(*[F.when(low.contains(r), F.lit(r)) for r in sorted(ROLES, key=len, reverse=True)])


def skill_hits(questions: DataFrame, index: DataFrame, key: str, text: str) -> DataFrame:
    """``(key, start, size, canonical)``: windows of up to ``WINDOW`` words that are an alias of ``index``."""
    words = F.regexp_extract_all(F.col(text), F.lit(WORD), F.lit(0))
    at = questions.select(key, words.alias("words")).select(key, "words", F.explode(F.sequence(F.lit(0), F.size("words") - 1)).alias("start")).where(F.size("words") > 0)
    sizes = F.sequence(F.lit(1), F.least(F.lit(WINDOW), F.size("words") - F.col("start")))
    windows = at.select(key, "start", "words", F.explode(sizes).alias("size"))
    phrase = F.array_join(F.slice("words", F.col("start") + 1, F.col("size")), " ")
    names = index.groupBy("folded").agg(F.min_by("canonical", F.struct("alias_ord", "canonical")).alias("canonical"))
    names = F.broadcast(names) if index.count() <= BROADCAST_ALIASES else names
    return windows.select(key, "start", "size", alias_key(phrase).alias("folded")).join(names, "folded").select(key, "start", "size", "canonical")


def chosen(hits: Column, most: int = MOST) -> Column:
    """Skills of a question from its windows ``(start, size, canonical)``: the longest first, then the first, none that meets a chosen one.

    A skill counts once, and a window that names a chosen skill again blocks nothing.
    At most ``most`` are kept, so that the choice is linear in the windows.
    """
    order = F.array_sort(F.transform(hits, lambda h: F.struct((-h["size"]).alias("first"), h["start"].alias("start"), h["size"].alias("size"), h["canonical"].alias("canonical"))))
    none = F.expr("cast(array() as array<struct<start:int,size:int,canonical:string>>)")
    clear = lambda got, h: ~F.exists(got, lambda g: (h["start"] < g["start"] + g["size"]) & (g["start"] < h["start"] + h["size"]) | (g["canonical"] == h["canonical"]))
    pick = lambda got, h: F.when((F.size(got) < most) & clear(got, h), F.concat(got, F.array(F.struct(h["start"].alias("start"), h["size"].alias("size"), h["canonical"].alias("canonical"))))).otherwise(got)
    return F.transform(F.aggregate(order, none, pick), lambda g: g["canonical"])


def entities(questions: DataFrame, index: DataFrame, text: str = "text") -> DataFrame:
    """``questions`` with country, seniority, contract_type, role_title, skill and skills (null and empty without any).

    ``index`` is an alias index of the ontology. Windows are joined to it without their question and come back by
    a row number, so repeated rows and null keys stay as they are. A null question names nothing.
    """
    own = questions.withColumn("__row", F.monotonically_increasing_id())
    asked = own.select("__row", F.coalesce(F.col(text), F.lit("")).alias("__text"))
    hits = skill_hits(asked, index, "__row", "__text").groupBy("__row").agg(chosen(F.collect_list(F.struct("start", "size", "canonical"))).alias("skills"))
    found = own.join(hits, "__row", "left").withColumn("skills", F.coalesce("skills", F.expr("cast(array() as array<string>)")))
    q = F.col(text)
    return found.select(
        *questions.columns, country(q).alias("country"), seniority(q).alias("seniority"), contract(q).alias("contract_type"), role(q).alias("role_title"),
        F.get("skills", 0).alias("skill"), "skills",
    )
