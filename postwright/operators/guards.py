"""Guards over tables of model outputs: nothing stays that the documents don't ground."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from postwright.functions.text import alias_key

INJECTION = ["ignore previous instructions", "system prompt", "developer message"]
NUMBERS = r"\d+(?:[.,]\d+)*"
# Prices in US dollars for a million tokens.
PRICE_IN, PRICE_OUT = Decimal("0.59"), Decimal("0.79")
MIN_CONFIDENCE = 0.70


def judged_candidates(candidates: DataFrame, documents: DataFrame, skills: DataFrame, known: DataFrame) -> DataFrame:
    """``candidates`` with ``status``: the first rule that one breaks, or accepted.

    ``candidates``: cand_id, doc_id, fact_type, confidence, canonical, skill_id, start,
    end, quote, page; ``documents``: doc_id, text, n_pages; ``known``: (doc_id, canonical)
    found before. Of accepted candidates of one skill the first by ``cand_id`` stays.
    """
    d = candidates.join(documents.select("doc_id", F.col("text").alias("__text"), "n_pages"), "doc_id", "left")
    d = d.join(skills.select("canonical", F.col("skill_id").alias("__id")), "canonical", "left")
    d = d.join(known.select("doc_id", "canonical", F.lit(True).alias("__known")).distinct(), ["doc_id", "canonical"], "left")
    text, quote = F.coalesce("__text", F.lit("")), F.col("quote")
    low = F.lower(F.concat_ws(" ", "quote", "canonical"))
    injected = F.lit(False)
    for term in INJECTION:
        injected = injected | low.contains(term)
    slice_ = F.substring(text, (F.col("start") + 1).cast("int"), (F.col("end") - F.col("start")).cast("int"))
    rules = [
        (F.col("canonical").isNull() | quote.isNull() | F.col("start").isNull() | F.col("end").isNull(), "rejected_schema"),
        (~F.col("fact_type").eqNullSafe("skill"), "rejected_unsupported_fact_type"),
        (~F.col("confidence").between(0, 1), "rejected_confidence"),
        (injected, "rejected_prompt_injection"),
        (F.col("__id").isNull(), "rejected_unknown_skill"),
        (F.col("skill_id").isNotNull() & (F.col("skill_id") != F.col("__id")), "rejected_unknown_skill"),
        ((F.col("start") < 0) | (F.col("end") < F.col("start")) | (F.col("end") > F.char_length(text)), "rejected_invalid_offset"),
        (~text.contains(quote), "rejected_no_evidence"),
        (slice_ != quote, "rejected_evidence_mismatch"),
        (F.col("page").isNotNull() & ~F.col("page").between(1, F.col("n_pages")), "rejected_invalid_offset"),
        (F.col("__known"), "rejected_duplicate"),
    ]
    d = d.withColumn("status", F.coalesce(*[F.when(F.coalesce(c, F.lit(False)), F.lit(s)) for c, s in rules], F.lit("accepted")))
    again = Window.partitionBy("doc_id", "canonical", "status").orderBy("cand_id")
    twice = (F.col("status") == "accepted") & (F.row_number().over(again) > 1)
    return d.withColumn("status", F.when(twice, "rejected_duplicate").otherwise(F.col("status"))).drop("__text", "__id", "__known", "n_pages")


def integrity(final: DataFrame, documents: DataFrame) -> DataFrame:
    """``(doc_id, canonical, violation)`` of a final set: duplicates, offsets, texts."""
    again = Window.partitionBy("doc_id", "canonical").orderBy("start")
    d = final.join(documents.select("doc_id", "text"), "doc_id", "left").withColumn("__n", F.row_number().over(again))
    inside = (F.col("start") >= 0) & (F.col("start") <= F.col("end")) & (F.col("end") <= F.char_length("text"))
    same = F.substring("text", (F.col("start") + 1).cast("int"), (F.col("end") - F.col("start")).cast("int")) == F.col("quote")
    kinds = F.array(F.when(F.col("__n") > 1, "duplicate"), F.when(~inside, "invalid_offsets"), F.when(inside & ~same, "text_mismatch"))
    return d.select("doc_id", "canonical", F.explode(F.filter(kinds, lambda k: k.isNotNull())).alias("violation"))


def numbers(text: Column) -> Column:
    return F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit(NUMBERS), F.lit(0)), lambda x: F.replace(x, F.lit(","), F.lit(""))))


def rewrite_verdict(old: Column, new: Column, new_skills: Column, own_skills: Column, allowed: Column, others: Column) -> Column:
    """Why a rewrite is dropped, or "kept": blank, new skills, new numbers, another employer."""
    low = F.lower(new)
    return (
        F.when(F.coalesce(F.trim(new), F.lit("")) == "", "blank")
        .when(F.size(F.array_except(F.array_except(new_skills, allowed), own_skills)) > 0, "ungrounded_skill")
        .when(F.size(F.array_except(numbers(new), numbers(old))) > 0, "new_number")
        .when(F.exists(others, lambda o: low.contains(F.lower(o))), "other_employer")
        .otherwise("kept")
    )


def n_words(text: Column) -> Column:
    return F.size(F.filter(F.split(text, r"\s+"), lambda x: x != ""))


def spelling_verdict(old: Column, new: Column, old_skills: Column, new_skills: Column) -> Column:
    """Why a correction is dropped, or "kept": blank, blanks only, a number, a skill, a rewrite in disguise."""
    flat = lambda x: F.trim(F.regexp_replace(F.regexp_replace(x, " ", " "), r"\s+", " "))
    same = lambda a, b: (F.size(F.array_except(a, b)) == 0) & (F.size(F.array_except(b, a)) == 0)
    allowed = F.greatest(F.lit(3), F.floor(n_words(old) / 3))
    return (
        F.when(flat(new) == "", "blank")
        .when(flat(new) == flat(old), "no_change")
        .when(~same(numbers(old), numbers(new)), "changed_number")
        .when(~same(old_skills, new_skills), "changed_skill")
        .when(F.abs(n_words(new) - n_words(old)) > allowed, "rewrite")
        .otherwise("kept")
    )


def grounded_experience(entries: DataFrame, documents: DataFrame, institutions: str = r"universit|ecole|school|lycee|college|institut") -> DataFrame:
    """Entries whose company the document has, institutions and blurbs out, each (title, company) once; ``start`` is where the quote or the name is."""
    d = entries.join(documents.select("doc_id", "text"), "doc_id")
    company = F.trim(F.coalesce("company", F.lit("")))
    ok = (company != "") & F.lower("text").contains(F.lower(company)) & ~alias_key(company).rlike(institutions) & (n_words(company) <= 8)
    first = Window.partitionBy("doc_id", alias_key(F.coalesce("title", F.lit(""))), alias_key(company)).orderBy("entry_id")
    d = d.where(ok).withColumn("__n", F.row_number().over(first)).where("__n = 1").drop("__n")
    return d.withColumn("start", locate(F.col("text"), F.col("quote"), company)).drop("text")


def locate(text: Column, quote: Column, name: Column) -> Column:
    """The offset of the quote, else of the name, in the text; null if neither is there."""
    at = lambda x: F.when((F.coalesce(x, F.lit("")) != "") & text.contains(x), F.instr(text, x) - 1)
    return F.coalesce(at(quote), at(name))


# Words for career levels.
CAREER_WORDS = {
    "internship": ["internship", "intern", "stage"], "apprenticeship": ["apprenticeship", "apprentice", "alternance"], "junior": ["junior", "jr", "entry level", "entry-level"],
    "mid": ["mid", "middle", "intermediate"], "senior": ["senior", "sr"], "lead": ["lead", "tech lead"], "principal": ["principal", "staff"], "manager": ["manager", "director", "executive", "chief"],
}


def canonical_career(x: Column) -> Column:
    n = alias_key(F.coalesce(x, F.lit("")))
    return F.coalesce(*[F.when(n.isin(words), F.lit(level)) for level, words in CAREER_WORDS.items()], F.lit("unknown"))


def canonical_mode(x: Column) -> Column:
    n = alias_key(F.coalesce(x, F.lit("")))
    return F.when(n.contains("remote"), "remote").when(n.rlike("hybride?"), "hybrid").when(n.isin("on site", "onsite", "on-site", "office", "in office"), "on_site").otherwise("unknown")


def token_cost(prompt: Column, completion: Column) -> Column:
    """US dollars to six digits, reckoned in decimals: halves go up whatever the size of the sum."""
    tokens = lambda x: x.cast("decimal(20,0)")
    return F.round((tokens(prompt) * F.lit(PRICE_IN) + tokens(completion) * F.lit(PRICE_OUT)) / 1_000_000, 6).cast("double")


# Topics with their phrases, in order.
TOPICS = {
    "cv_upload": ["upload my cv", "upload a cv", "upload cv", "extraction confidence", "how is my cv", "parse my cv", "extract my cv", "cv extraction"],
    "matching": ["job matching", "how does matching work", "how do matches work", "match score", "final score", "lexical", "semantic", "hybrid mode", "retrieval source"],
    "skill_gap": ["skill gap", "missing skills", "what skills am i missing", "recommended skills"],
    "cv_improve_quality": ["improve my cv", "cv improvement", "quality report", "cv score", "rewrite my cv"],
    "corpus_data_source": [
        "where does the data come from", "data source", "how many jobs are in the corpus", "how up to date", "how fresh", "job postings come from", "snapshot",
    ],
    "chat_assistant": ["what can you do", "what can this chatbot", "who are you", "what is this assistant", "help me understand this chat"],
}
# Wording that asks for figures, by intent.
SALARY_WORDS = r"\baverage\b|\bmean\b|\btypical salary\b|salary (of|for|in)|how much (does|do|is|are|can)|\bmoyenne\b|\bsalaire\b|combien gagne"
TOP_WORDS = (
    r"\btop \d*\s*skills\b|\bmost common\b|\bmost in-demand\b|\bmost requested\b|\bmost popular\b|\bmost needed\b|"
    r"plus demand[ée]e?s?|plus recherch[ée]e?s?|plus courantes?|plus populaires?|quelles? comp[ée]tences|top comp[ée]tences"
)
SHARE_WORDS = r"%|percent|percentage|proportion|fraction|share of|pourcentage|proportion de|part de"
COUNT_WORDS = r"\bhow many\b|\bnumber of\b|\bcount of\b|\btotal (number|count)\b|\bcombien\b|\bnombre de\b"
# Wording that asks for figures at all; salaries and ranks are asked for in other words than the intents have.
ANALYTICAL = [
    SHARE_WORDS,
    COUNT_WORDS,
    r"\baverage\b|\bmean\b|\btypical salary\b|salary (of|for|in)|how much (does|do|is|are|can)|\bmoyenne\b|salaire moyen|en moyenne|salaire (de|pour|en)",
    r"\btop \d*\s*skills\b|\bmost common\b|\bmost in-demand\b|\bmost requested\b|\bmost popular\b|\bmost needed\b",
    r"plus demand[ée]s?|plus courants?|plus recherch[ée]s?|plus populaires?",
    r"\bdistribution\b|\bbreakdown\b|\bsplit by\b|\bcompare\b|r[ée]partition\b|comparer\b",
]


def topic(question: Column, topics: dict[str, list[str]] = TOPICS) -> Column:
    """The topic with most phrases in the question, the earlier of equals; null without any."""
    low = F.lower(question)
    flag = lambda w: F.when(low.contains(w), 1).otherwise(0)

    def hits(words: list[str]) -> Column:
        n = F.lit(0)
        for w in words:
            n = n + flag(w)
        return n

    scored = F.array(*[F.struct(hits(ws).alias("n"), F.lit(-k).alias("k"), F.lit(t).alias("topic")) for k, (t, ws) in enumerate(topics.items())])
    best = F.array_max(scored)
    return F.when(best["n"] > 0, best["topic"])


def route(question: Column) -> Column:
    analytical = F.lower(question).rlike("|".join(ANALYTICAL))
    return F.when(topic(question).isNotNull(), "platform").when(analytical, "sql").otherwise("unresolved")


def intent(question: Column, skill: Column) -> Column:
    low = F.lower(question)
    about = low.rlike("skill|job|comp[ée]tence|offre|poste")
    return (
        F.when(low.rlike(SALARY_WORDS), "avg_salary")
        .when(low.rlike(TOP_WORDS), "top_skills")
        .when(low.rlike(SHARE_WORDS) & skill.isNotNull(), "skill_demand")
        .when(low.rlike(COUNT_WORDS), F.when(skill.isNotNull() & ~about, "skill_demand").otherwise("job_count"))
        .when(skill.isNotNull(), "skill_demand")
        .otherwise("job_count")
    )


def nearest_dates(roles: DataFrame, ranges: DataFrame, limit: int = 500) -> DataFrame:
    """The date range of each role that is nearest to one of its anchors, ``limit`` characters off at most.

    ``roles``: doc_id, role_id, anchor (offset); ``ranges``: doc_id, start, range. A join within each document.
    """
    near = roles.join(ranges, "doc_id").withColumn("gap", F.abs(F.col("anchor") - F.col("start"))).where(F.col("gap") <= limit)
    return near.groupBy("doc_id", "role_id").agg(F.min_by("range", F.struct("gap", "start")).alias("range"), F.min("gap").alias("gap"))


EDUCATION_RANK = {"phd/doctorat": 5, "engineering_degree": 4, "master/mba": 4, "bachelor/licence": 3, "baccalaureat": 1}


def best_education(entries: DataFrame) -> DataFrame:
    """The entry of the highest level, then of the latest year, for each profile."""
    rank = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in EDUCATION_RANK.items() for x in kv]), F.col("level")), F.lit(0))
    return entries.groupBy("profile_id").agg(F.max_by(F.struct("level", "year"), F.struct(rank, F.coalesce("year", F.lit(0)), "entry_id")).alias("best")).select("profile_id", "best.*")


def merged_profiles(text_side: DataFrame, entries: DataFrame) -> DataFrame:
    """Experience of each profile: months of its grounded entries, else what the text states; the larger of both counts."""
    g = entries.groupBy("profile_id").agg(
        F.sum("months").alias("entry_months"), F.count_if(F.col("entry_type") == "internship").alias("n_intern"), F.count_if(F.col("entry_type") == "job").alias("n_job")
    )
    d = text_side.join(g, "profile_id", "left")
    months = F.coalesce("entry_months", "total_months")
    return d.select(
        "profile_id", months.alias("total_months"), F.round(months / 12, 2).alias("total_years"),
        F.greatest("internship_count", F.coalesce("n_intern", F.lit(0))).alias("internship_count"), F.greatest("professional_count", F.coalesce("n_job", F.lit(0))).alias("professional_count"),
        F.when(F.coalesce("model_level", F.lit("unknown")) != "unknown", F.col("model_level")).otherwise(F.col("career_level")).alias("career_level"),
    )
