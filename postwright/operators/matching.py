"""Postings for whole tables of profiles: candidates, scores, ranks, gaps.

``profiles``: profile_id, skills (array), career_level, total_years, domains
(array), country, city, remote (boolean). ``jobs``: job_id, skills (array),
career_level, min_years, job_types (array), domains (array), country, city,
remote_mode, title. Scores are explained by their parts.
"""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from postwright.functions.text import alias_key

# Weights of the final score and of the skill score.
WEIGHTS = {"skills": 0.50, "experience": 0.15, "career_level": 0.15, "domain": 0.10, "job_type": 0.05, "location": 0.05}
SKILL_WEIGHTS = {"coverage": 0.55, "relevance": 0.20, "richness": 0.10, "specificity": 0.15}
POOL = 200
#: A skill that more than this share of the jobs ask for isn't joined posting by posting.
HEAVY_SHARE = 0.02
ALPHA = 0.60
MAX_PENALTY = 0.75
# Skills and domains by kind.
GENERIC = ["Artificial Intelligence", "Data Science", "Machine Learning", "Software Development", "Cloud Computing", "Backend Development"]
SPECIALISED = [
    "Retrieval-Augmented Generation", "Large Language Models", "Natural Language Processing", "Deep Learning", "Generative AI", "Computer Vision",
    "PostgreSQL", "MongoDB", "FastAPI", "scikit-learn", "Power BI", "AWS", "Azure", "GCP", "Kubernetes",
]
TECHNICAL_DOMAINS = [
    "AI", "Data Science", "Machine Learning", "NLP", "RAG", "Generative AI", "Computer Vision", "Software Engineering", "Backend", "Cloud",
    "DevOps", "Security", "Data Engineering",
]
BUSINESS_DOMAINS = [
    "Management", "Customer Service", "Customer Relationship Management", "Sales", "Insurance", "Communication", "Digital Transformation",
    "Commercial Support", "Administrative Operations", "Stock Management",
]
# Role families that aren't technical; words of technical titles, in folded form.
NON_TECHNICAL_ROLES = [
    "Sales", "Customer Service", "Management", "Marketing", "Business Development", "Human Resources", "Finance", "Insurance",
    "Customer Relationship Management", "Administrative Operations",
]
TECHNICAL_TITLE = (
    r"\b(data|developer|developpeur|full stack|software|logiciel|technical|technology|engineer|ingenieur|architect|architecture|"
    r"technico|integrateur|database|tester|testeur|sw|it)\b"
)
CAREER_RANK = {
    "student": 0, "internship": 0, "apprenticeship": 0, "junior": 1, "mid": 2, "consultant": 2, "senior": 3, "lead": 4, "principal": 4,
    "manager": 4, "unknown": -1,
}
RELATED = {
    "AI": ["Data Science", "Machine Learning", "Generative AI", "NLP", "RAG", "Computer Vision"],
    "Machine Learning": ["Data Science", "AI", "Deep Learning", "Computer Vision", "NLP"],
    "Data Science": ["Machine Learning", "AI", "Data Engineering"],
    "Generative AI": ["AI", "NLP", "RAG", "Machine Learning"],
    "NLP": ["AI", "Generative AI", "RAG", "Machine Learning"],
    "RAG": ["Generative AI", "NLP", "AI"],
    "Data Engineering": ["Data Science", "Cloud"],
    "Cloud": ["DevOps", "Data Engineering"],
}

_NONE = "cast(array() as array<string>)"


def _texts(values: list[str]) -> Column:
    return F.array(*[F.lit(v) for v in values])


def lexical_candidates(profile_skills: DataFrame, job_skills: DataFrame, pool: int = POOL, heavy_share: float = HEAVY_SHARE) -> DataFrame:
    """``(profile_id, job_id, overlap, lexical_rank)``: the ``pool`` jobs with most shared skills for each profile.

    Both sides are bridges of ``(id, skill)`` rows. Rare skills are joined posting by posting.
    Skills that more than ``heavy_share`` of the jobs ask for (so that there are skills a job / share of
    them at most) are never joined so: jobs are grouped by the set of heavy skills
    that they have, profiles by theirs, and each pair of sets is compared once. A job that shares heavy skills alone can only
    come into a pool with the ``pool`` first jobs of its set, and only from the levels of overlap that
    it takes to fill the pool; other levels are cut before any job of theirs is read. Ties go to the
    smaller job. Profiles without skills get no row (see ``fallback_candidates``).
    """
    p = profile_skills.select("profile_id", "skill").distinct()
    best = Window.partitionBy("profile_id").orderBy(F.col("overlap").desc(), "job_id")
    first = lambda rows: rows.withColumn("lexical_rank", F.row_number().over(best)).where(F.col("lexical_rank") <= pool)
    # rows are counted before their pairs: where no skill has many rows, none is asked for by many jobs
    most = job_skills.groupBy("skill").count().agg(F.max("count")).first()[0] or 0
    least = pool if most <= pool else max(pool, heavy_share * job_skills.select("job_id").distinct().count())
    j = job_skills.select("job_id", "skill").distinct()
    heavy = [] if most <= least else [r["skill"] for r in j.groupBy("skill").agg(F.count("*").alias("n")).where(F.col("n") > least).select("skill").collect()]
    if not heavy:
        # with few rows a skill, pairs are made distinct after the join, in the tasks that join them
        pairs = p.join(job_skills.select("job_id", "skill"), "skill").distinct() if most <= least else p.join(j, "skill")
        return first(pairs.groupBy("profile_id", "job_id").agg(F.count("*").alias("overlap")))
    is_heavy = F.col("skill").isin(heavy)
    own_sets = p.where(is_heavy).groupBy("profile_id").agg(F.sort_array(F.collect_set("skill")).alias("own"))
    job_sets = j.where(is_heavy).groupBy("job_id").agg(F.sort_array(F.collect_set("skill")).alias("has"))
    shared = F.coalesce(F.size(F.array_intersect("own", "has")), F.lit(0))
    rare = p.where(~is_heavy).join(own_sets, "profile_id", "left").join(j.where(~is_heavy).join(job_sets, "job_id", "left"), "skill")
    rare = rare.groupBy("profile_id", "job_id").agg((F.count("*") + F.max(F.when(F.col("own").isNotNull() & F.col("has").isNotNull(), shared).otherwise(0))).alias("overlap"))
    return first(rare.unionByName(_heavy_candidates(own_sets, job_sets, pool)).groupBy("profile_id", "job_id").agg(F.max("overlap").alias("overlap")))


def _heavy_candidates(own_sets: DataFrame, job_sets: DataFrame, pool: int) -> DataFrame:
    """``(profile_id, job_id, overlap)``: the ``pool`` jobs with most heavy skills of each profile, found once for each set of skills."""
    kinds = job_sets.groupBy("has").agg(F.count("*").alias("n"))
    pairs = own_sets.select("own").distinct().select("own", F.explode("own").alias("skill")).join(kinds.select("has", "n", F.explode("has").alias("skill")), "skill")
    pairs = pairs.groupBy("own", "has").agg(F.count("*").alias("overlap"), F.first("n").alias("n"))
    higher = Window.partitionBy("own").orderBy(F.col("overlap").desc()).rowsBetween(Window.unboundedPreceding, -1)
    levels = pairs.groupBy("own", "overlap").agg(F.sum("n").alias("n")).withColumn("before", F.coalesce(F.sum("n").over(higher), F.lit(0)))
    wanted = pairs.join(levels.where(F.col("before") < pool).select("own", "overlap"), ["own", "overlap"]).select("own", "overlap", "has")
    # a limit by group is taken before the shuffle as well: a task gives out ``pool`` jobs of a set at most
    firsts = job_sets.withColumn("nth", F.row_number().over(Window.partitionBy("has").orderBy("job_id"))).where(F.col("nth") <= pool).drop("nth")
    ranked = Window.partitionBy("own").orderBy(F.col("overlap").desc(), "job_id")
    tops = wanted.join(firsts, "has").withColumn("nth", F.row_number().over(ranked)).where(F.col("nth") <= pool)
    return own_sets.join(tops.select("own", "job_id", "overlap"), "own").select("profile_id", "job_id", "overlap")


def fallback_candidates(profiles: DataFrame, profile_skills: DataFrame, job_skills: DataFrame, pool: int = POOL) -> DataFrame:
    """For profiles without skills: the first ``pool`` jobs with skills, by id (``pool`` rows are broadcast)."""
    bare = profiles.select("profile_id").join(profile_skills.select("profile_id"), "profile_id", "left_anti")
    first = job_skills.select("job_id").distinct().orderBy("job_id").limit(pool)
    first = first.withColumn("lexical_rank", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy("job_id"))).withColumn("__one", F.lit(1))
    rows = bare.withColumn("__one", F.lit(1)).join(F.broadcast(first), "__one")
    return rows.select("profile_id", "job_id", F.lit(0).cast("long").alias("overlap"), "lexical_rank")


def union_candidates(lexical: DataFrame, semantic: DataFrame) -> DataFrame:
    """Candidates of both searches with ``retrieval_source``; a job outside the semantic pool has a null score, not zero."""
    a = lexical.select("profile_id", "job_id", "overlap", F.lit(1).alias("__l"))
    b = semantic.select("profile_id", "job_id", "semantic_score", F.lit(1).alias("__s"))
    found = F.when(F.col("__l").isNotNull() & F.col("__s").isNotNull(), "both").when(F.col("__s").isNotNull(), "semantic").otherwise("lexical")
    return a.join(b, ["profile_id", "job_id"], "full_outer").select("profile_id", "job_id", "overlap", "semantic_score", found.alias("retrieval_source"))


def bundles(jobs: DataFrame, job_skills: DataFrame, candidates: DataFrame | None = None) -> DataFrame:
    """Jobs with their sorted skills: those with skills, or all of ``candidates``, skills or none."""
    lists = job_skills.groupBy("job_id").agg(F.sort_array(F.collect_set("skill")).alias("skills"))
    if candidates is None:
        return jobs.join(lists, "job_id")
    kept = jobs.join(candidates.select("job_id").distinct(), "job_id", "left_semi").join(lists, "job_id", "left")
    return kept.withColumn("skills", F.coalesce("skills", F.expr(_NONE)))


def richness(n: Column) -> Column:
    return F.when(n <= 0, 0.0).when(n == 1, 0.60).when(n == 2, 0.75).when(n <= 5, 0.90).otherwise(1.0)


def specificity_value(skill: Column, generic: list[str] = GENERIC, specialised: list[str] = SPECIALISED) -> Column:
    return F.when(skill.isin(specialised), 1.0).when(skill.isin(generic), 0.35).otherwise(0.65)


def skill_score(coverage: Column, relevance: Column, rich: Column, specific: Column) -> Column:
    w = SKILL_WEIGHTS
    return F.least(F.lit(1.0), w["coverage"] * coverage + w["relevance"] * relevance + w["richness"] * rich + w["specificity"] * specific)


def experience_gap(need: Column, have: Column) -> Column:
    """Null without a requirement, the whole of it for an unknown candidate."""
    return F.when(need.isNull(), None).when(have.isNull(), need).when(have >= need, 0.0).otherwise(F.round(need - have, 2))


def experience_score(need: Column, have: Column) -> Column:
    gap = F.round(need - have, 2)
    return (
        F.when(need.isNull(), 0.9).when(have.isNull(), 0.55).when(have >= need, 1.0).otherwise(F.greatest(F.lit(0.15), 1 - gap / F.greatest(need, F.lit(1.0))))
    )


def career_score(candidate: Column, target: Column) -> Column:
    rank = F.create_map(*[F.lit(x) for kv in CAREER_RANK.items() for x in kv])
    gap = F.element_at(rank, target) - F.element_at(rank, candidate)
    return (
        F.when(target == "unknown", 0.85)
        .when(candidate == "unknown", 0.65)
        .when(target.isin("internship", "apprenticeship"), F.when(candidate.isin("student", "internship", "apprenticeship", "junior"), 1.0).otherwise(0.55))
        .when(gap <= 0, 1.0)
        .when(gap == 1, 0.7)
        .when(gap == 2, 0.35)
        .otherwise(0.1)
    )


def job_type_score(types: Column, level: Column, years: Column) -> Column:
    return (
        F.when(F.size(types) == 0, 0.65)
        .when(F.arrays_overlap(types, _texts(["stage", "apprenticeship"])), F.when(level.isin("student", "internship", "apprenticeship"), 1.0).otherwise(0.55))
        .when(F.array_contains(types, "freelance"), F.when(years.isNull() | (years < 2), 0.35).otherwise(0.85))
        .otherwise(0.75)
    )


def domain_score(job: Column, candidate: Column) -> Column:
    """Mean over the job's domains of the best match with the candidate's."""
    near = F.create_map(*[x for k, v in RELATED.items() for x in (F.lit(k), _texts(v))])
    best = lambda d: (
        F.when(F.array_contains(candidate, d), 1.0)
        .when(F.arrays_overlap(F.coalesce(F.element_at(near, d), F.expr(_NONE)), candidate), 0.75)
        .when((d == "AI") | F.array_contains(candidate, "AI"), 0.55)
        .otherwise(0.0)
    )
    total = F.aggregate(F.transform(job, best), F.lit(0.0), lambda a, x: a + x)
    return F.when(F.size(job) == 0, 0.45).when(F.size(candidate) == 0, 0.35).otherwise(F.round(total / F.size(job), 4))


def location(remote: Column, mode: Column, city: Column, job_city: Column, country: Column, job_country: Column) -> Column:
    """Struct of ``score`` and ``status``; places are compared in lower case."""
    made = lambda s, v: F.struct(F.lit(s).alias("score"), F.lit(v).alias("status"))
    same = lambda a, b: F.lower(a) == F.lower(b)
    return (
        F.when(F.coalesce(remote, F.lit(False)) & F.coalesce(mode.isin("remote", "hybrid"), F.lit(False)), made(0.90, "remote_compatible"))
        .when(same(city, job_city), made(1.00, "exact_match"))
        .when(same(country, job_country), made(0.75, "compatible"))
        .when(city.isNull() & country.isNull() & remote.isNull(), made(0.50, "unknown_candidate_preference"))
        .when(job_city.isNull() & job_country.isNull() & mode.isNull(), made(0.50, "unknown_job_location"))
        .otherwise(made(0.25, "mismatch"))
    )


def _penalty_rules(level: Column, years: Column, target: Column, need: Column, types: Column, gap: Column, mismatch: Column) -> list[tuple[Column, str, Column]]:
    rules = [
        ((level == "student") & target.isin("senior", "lead", "principal", "manager"), "student_senior_mismatch", F.lit(0.3)),
        (level.isin("student", "internship") & (need >= 5), "large_experience_requirement", F.lit(0.25)),
        (F.array_contains(types, "freelance") & (years.isNull() | (years < 2)), "freelance_low_experience", F.lit(0.25)),
        (mismatch, "business_profile_technical_role_mismatch", F.lit(0.45)),
        (need.isNotNull() & years.isNull(), "unknown_candidate_experience", F.lit(0.08)),
        (years.isNotNull() & (gap > 0), "experience_gap", F.least(F.lit(0.25), 0.06 * gap)),
    ]
    return [(F.coalesce(c, F.lit(False)), code, a.cast("double")) for c, code, a in rules]


def penalties(level: Column, years: Column, target: Column, need: Column, types: Column, gap: Column, mismatch: Column) -> Column:
    """Array of ``(code, amount)`` of the penalties that apply."""
    made = lambda code, amount: F.struct(F.lit(code).alias("code"), amount.alias("amount"))
    rules = _penalty_rules(level, years, target, need, types, gap, mismatch)
    return F.filter(F.array(*[F.when(c, made(code, a)) for c, code, a in rules]), lambda p: p.isNotNull())


def penalty_sum(level: Column, years: Column, target: Column, need: Column, types: Column, gap: Column, mismatch: Column) -> Column:
    """The sum of the amounts of ``penalties``, in their order, without the array."""
    rules = _penalty_rules(level, years, target, need, types, gap, mismatch)
    return reduce(lambda total, rule: total + F.when(rule[0], rule[2]).otherwise(0.0), rules, F.lit(0.0))


def _overlap(values: Column, known: list[str]) -> Column:
    """``arrays_overlap`` with a short list, without a set for each row."""
    return reduce(or_, [F.array_contains(values, v) for v in known])


def business(profile_domains: Column, profile_skills: Column) -> Column:
    """A business profile without technical skills."""
    return F.arrays_overlap(profile_domains, _texts(BUSINESS_DOMAINS)) & ~F.arrays_overlap(profile_skills, _texts(GENERIC + SPECIALISED + TECHNICAL_DOMAINS))


def business_mismatch(profile_domains: Column, profile_skills: Column, job_domains: Column) -> Column:
    """A business profile without technical skills against a technical job."""
    return business(profile_domains, profile_skills) & _overlap(job_domains, TECHNICAL_DOMAINS)


def suppressed() -> Column:
    """Whether a scored row isn't to be shown: a technical job for a business profile without technical skills.

    A job is technical by its domains (as for the mismatch penalty), its title or its skills.
    """
    technical = alias_key(F.coalesce("j_title", F.lit(""))).rlike(TECHNICAL_TITLE) | _overlap(F.col("j_skills"), GENERIC + SPECIALISED)
    return F.coalesce(F.col("p_business") & (_overlap(F.col("j_domains"), TECHNICAL_DOMAINS) | technical), F.lit(False))


def with_covered(profiles: DataFrame, index: DataFrame) -> DataFrame:
    """``profiles`` with ``covered``: the skills that their domains and roles name, by any alias of ``index``.

    ``index`` has ``folded`` and ``canonical``. Covered skills are no gaps; they don't count as matched.
    """
    labels = F.array_union("domains", "roles") if "roles" in profiles.columns else F.col("domains")
    named = profiles.select("profile_id", F.explode(labels).alias("label")).select("profile_id", alias_key(F.col("label")).alias("folded"))
    own = named.join(index.select("folded", "canonical"), "folded").groupBy("profile_id").agg(F.sort_array(F.collect_set("canonical")).alias("covered"))
    return profiles.join(own, "profile_id", "left").withColumn("covered", F.coalesce("covered", F.expr(_NONE)))


def of_contract(rows: DataFrame, wishes: DataFrame) -> DataFrame:
    """Rows whose contract is the one that the profile's wish names, letters of either case alike; no wish keeps all.

    Applied to scored rows it filters before the top is taken, to ranked rows after. ``wishes``: profile_id, contract_type.
    """
    w = wishes.select("profile_id", F.lower("contract_type").alias("__wish"))
    return rows.join(w, "profile_id", "left").where(F.col("__wish").isNull() | (F.lower("j_contract_type") == F.col("__wish"))).drop("__wish")


def scored(candidates: DataFrame, profiles: DataFrame, jobs: DataFrame, mode: str = "lexical", alpha: float = ALPHA, generic: list[str] = GENERIC, specialised: list[str] = SPECIALISED) -> DataFrame:
    """Candidates with all parts of their score; ``semantic_score`` may be absent or null.

    Jobs are joined first: rows then lie by profile, as ``ranked`` wants them, and aren't shuffled again.
    """
    p = profiles.select(*[F.col(c).alias(f"p_{c}" if c != "profile_id" else c) for c in profiles.columns])
    p = p.withColumn("p_business", business(F.col("p_domains"), F.col("p_skills")))
    j = jobs.select(*[F.col(c).alias(f"j_{c}" if c != "job_id" else c) for c in jobs.columns])
    d = candidates.join(j, "job_id").join(p, "profile_id")
    if "semantic_score" not in d.columns:
        d = d.withColumn("semantic_score", F.lit(None).cast("double"))
    if "p_confidence" not in d.columns:
        d = d.withColumn("p_confidence", F.lit(1.0))
    d = d.withColumn("matched", F.sort_array(F.array_intersect("p_skills", "j_skills")))
    known = F.array_union("p_skills", "p_covered") if "p_covered" in d.columns else F.col("p_skills")
    d = d.withColumn("missing", F.sort_array(F.array_except("j_skills", known)))
    nm, nj, np_ = F.size("matched"), F.size("j_skills"), F.size("p_skills")
    mean = F.aggregate("matched", F.lit(0.0), lambda a, s: a + specificity_value(s, generic, specialised)) / F.greatest(nm, F.lit(1))
    d = d.withColumns(
        {
            "coverage": F.when(nj > 0, nm / nj).otherwise(0.0),
            "relevance": F.when(np_ > 0, nm / np_).otherwise(0.0),
            "richness": richness(nj),
            "specificity": F.when(nm > 0, mean).otherwise(0.0),
            "specialized_count": F.size(F.filter("matched", lambda s: s.isin(specialised) if specialised else F.lit(False))),
            "experience_gap": experience_gap(F.col("j_min_years"), F.col("p_total_years")),
            "experience_score": experience_score(F.col("j_min_years"), F.col("p_total_years")),
            "career_score": career_score(F.col("p_career_level"), F.col("j_career_level")),
            "job_type_score": job_type_score(F.col("j_job_types"), F.col("p_career_level"), F.col("p_total_years")),
            "domain_score": domain_score(F.col("j_domains"), F.col("p_domains")),
            "location": location(*[F.col(c) for c in ("p_remote", "j_remote_mode", "p_city", "j_city", "p_country", "j_country")]),
        }
    )
    d = d.withColumn("skill_score", skill_score(F.col("coverage"), F.col("relevance"), F.col("richness"), F.col("specificity")))
    mismatch = F.col("p_business") & _overlap(F.col("j_domains"), TECHNICAL_DOMAINS)
    ruled = [*[F.col(c) for c in ("p_career_level", "p_total_years", "j_career_level", "j_min_years", "j_job_types", "experience_gap")], mismatch]
    d = d.withColumns({"penalties": penalties(*ruled), "penalty_total": F.least(F.lit(MAX_PENALTY), penalty_sum(*ruled))})
    w = WEIGHTS
    weighted = (
        w["skills"] * F.col("skill_score")
        + w["experience"] * F.col("experience_score")
        + w["career_level"] * F.col("career_score")
        + w["domain"] * F.col("domain_score")
        + w["job_type"] * F.col("job_type_score")
        + w["location"] * F.col("location.score")
    )
    d = d.withColumn("lexical_score", F.greatest(F.lit(0.0), weighted))
    semantic = F.when(F.col("semantic_score").isNotNull(), F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("semantic_score"))))  # least skips nulls
    share = {"lexical": F.lit(1.0), "semantic": F.lit(0.0), "hybrid": F.lit(alpha) * F.col("p_confidence")}[mode]
    blended = F.when(semantic.isNull() | F.lit(mode == "lexical"), F.col("lexical_score")).otherwise(share * F.col("lexical_score") + (1 - share) * semantic)
    return d.withColumn("final_score", F.round(F.greatest(F.lit(0.0), blended - F.col("penalty_total")) * 100, 2))


def ranked(rows: DataFrame, top: int) -> DataFrame:
    """The ``top`` jobs of each profile by eight keys, numbered from 1; suppressed ones don't rank."""
    keys = [F.col("final_score").desc(), F.round("coverage", 4).desc(), F.col("specialized_count").desc(), F.size("matched").desc(),
            F.size("j_skills").desc(), F.round("career_score", 4).desc(), F.round("experience_score", 4).desc(), F.col("job_id")]
    return rows.where(~suppressed()).withColumn("rank", F.row_number().over(Window.partitionBy("profile_id").orderBy(*keys))).where(F.col("rank") <= top)


def cautioned(rows: DataFrame, label: str = "p_quality_label", points: float = 15.0) -> DataFrame:
    """Low-confidence profiles lose points, with a penalty row that says so, and their jobs are numbered again by score and id."""
    low = F.col(label) == "low"
    note = F.array(F.struct(F.lit("low_extraction_confidence").alias("code"), F.lit(points / 100).alias("amount")))
    again = F.row_number().over(Window.partitionBy("profile_id").orderBy(F.col("final_score").desc(), "job_id"))
    lower = F.round(F.greatest(F.lit(0.0), F.col("final_score") - points), 2)
    out = rows.withColumn("final_score", F.when(low, lower).otherwise(F.col("final_score")))
    out = out.withColumn("penalties", F.when(low, F.concat("penalties", note)).otherwise(F.col("penalties")))
    return out.withColumn("rank", F.when(low, again).otherwise(F.col("rank"))) if "rank" in rows.columns else out


def in_scope(profiles: DataFrame, skills: DataFrame) -> DataFrame:
    """All profiles but those that are plainly not technical.

    Out are profiles with a business domain or a role that isn't technical, without a technical
    domain and without any skill but soft ones. Silence about domains and roles keeps a profile.
    """
    has = lambda c, values: F.coalesce(F.arrays_overlap(c, _texts(values)), F.lit(False))
    other = has("domains", BUSINESS_DOMAINS)
    if "roles" in profiles.columns:
        other = other | has("roles", NON_TECHNICAL_ROLES)
    hard = profiles.select("profile_id", F.explode("skills").alias("canonical")).join(skills.where("category <> 'soft_skill'").select("canonical"), "canonical")
    out = profiles.where(other & ~has("domains", TECHNICAL_DOMAINS)).select("profile_id").join(hard, "profile_id", "left_anti")
    return profiles.join(out, "profile_id", "left_anti")


def with_preferences(profiles: DataFrame, filters: DataFrame) -> DataFrame:
    """Profiles whose country, city and remote wish are overridden where a filter names them."""
    f = filters.select("profile_id", *[F.col(c).alias(f"f_{c}") for c in ("country", "city", "remote")])
    out = profiles.join(f, "profile_id", "left")
    for c in ("country", "city", "remote"):
        out = out.withColumn(c, F.coalesce(f"f_{c}", c)).drop(f"f_{c}")
    return out


def with_confirmed(profiles: DataFrame, confirmed: DataFrame, index: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``(profiles, rejects)``: profiles with what their candidates have confirmed in place of what was extracted.

    ``confirmed``: profile_id (unique), skills (as written), career_level, total_years, domains. Skills are named by any alias
    of ``index`` and kept once each, in order; all confirmed values replace extracted ones, null included, and
    ``total_months`` follows the years. A profile with a skill that the ontology doesn't know keeps what was extracted, and each such skill
    is a row ``(profile_id, skill, error)`` of the rejects. Profiles that confirmed nothing stay as they are.
    """
    names = index.groupBy("folded").agg(F.min_by("canonical", F.struct("alias_ord", "canonical")).alias("canonical"))
    each = confirmed.select("profile_id", F.explode("skills").alias("skill")).withColumn("folded", alias_key(F.col("skill"))).join(names, "folded", "left")
    rejects = each.where("canonical is null").select("profile_id", "skill", F.lit("not in the ontology").alias("error"))
    known = each.groupBy("profile_id").agg(F.sort_array(F.collect_set("canonical")).alias("__skills"), F.bool_or(F.col("canonical").isNull()).alias("__bad"))
    said = confirmed.select("profile_id", *[F.col(c).alias(f"__{c}") for c in ("career_level", "total_years", "domains")]).join(known, "profile_id", "left")
    said = said.where(~F.coalesce("__bad", F.lit(False))).select("*", F.lit(True).alias("confirmed")).drop("__bad")
    new = {"skills": F.coalesce("__skills", F.expr(_NONE)), "career_level": F.col("__career_level"), "total_years": F.col("__total_years"), "domains": F.sort_array(F.array_distinct("__domains"))}
    out = profiles.join(said, "profile_id", "left").withColumn("confirmed", F.coalesce("confirmed", F.lit(False)))
    out = out.withColumns({c: F.when(F.col("confirmed"), v).otherwise(F.col(c)) for c, v in new.items()})
    return out.withColumn("total_months", F.bround(F.col("total_years") * 12).cast("int")).drop("__skills", "__career_level", "__total_years", "__domains"), rejects


def shaped(rows: DataFrame) -> DataFrame:
    """What is shown of a match: the first five missing skills and a sentence."""
    said = F.format_string("%d of %d skills match; score %.2f.", F.size("matched"), F.size("j_skills"), F.col("final_score"))
    gap = F.when(F.col("experience_gap") > 0, F.format_string("Experience gap of %s years.", F.col("experience_gap").cast("string")))
    return rows.select("profile_id", "job_id", "rank", "final_score", F.slice("missing", 1, 5).alias("top_missing"), F.concat_ws(" ", said, gap).alias("explanation"))


def skill_gaps(matches: DataFrame, demand: DataFrame) -> DataFrame:
    """Missing skills of each profile's matches with the corpus's demand, in order of both."""
    lost = matches.select("profile_id", F.explode("missing").alias("skill")).groupBy("profile_id", "skill").agg(F.count("*").alias("missing_count"))
    best = Window.partitionBy("profile_id").orderBy(F.col("demand").desc(), F.col("missing_count").desc(), "skill")
    return lost.join(demand.select("skill", "demand"), "skill", "left").withColumn("demand", F.coalesce("demand", F.lit(0))).withColumn("rank", F.row_number().over(best))


def demand_of(job_skills: DataFrame, wanted: DataFrame) -> DataFrame:
    """Jobs that ask for each of the wanted skills; they are counted where the rows are, before skills are compared."""
    return job_skills.groupBy("skill").agg(F.count_distinct("job_id").alias("demand")).join(wanted.select("skill").distinct(), "skill", "left_semi")


def recommended_skills(gaps: DataFrame, matches: DataFrame) -> DataFrame:
    """Gaps with the share of the profile's matches that ask for them."""
    n = matches.groupBy("profile_id").agg(F.count("*").alias("n_matches"))
    share = F.when(F.col("n_matches") > 0, F.round(F.col("missing_count") * 100 / F.col("n_matches"), 1)).otherwise(0.0)
    return gaps.join(n, "profile_id", "left").withColumn("percent", share)


def hit_details(hits: DataFrame, jobs: DataFrame, job_skills: DataFrame) -> DataFrame:
    """Hits with their job and skills; a job outside the run keeps an empty list; 400 characters of description."""
    lists = job_skills.groupBy("job_id").agg(F.sort_array(F.collect_set("skill")).alias("skills"))
    rows = hits.join(jobs, "job_id", "left").join(lists, "job_id", "left")
    return rows.withColumn("skills", F.coalesce("skills", F.expr(_NONE))).withColumn("excerpt", F.substring("description", 1, 400)).drop("description")


def market_context(matches: DataFrame, titles: int = 5, skills: int = 8) -> DataFrame:
    """For each profile the titles of its best matches and the skills it matches most often."""
    first = matches.where(F.col("rank") <= titles).groupBy("profile_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("rank", "j_title"))), lambda x: x["j_title"]).alias("titles"))
    often = matches.select("profile_id", F.explode("matched").alias("skill")).groupBy("profile_id", "skill").agg(F.count("*").alias("n"))
    best = Window.partitionBy("profile_id").orderBy(F.col("n").desc(), "skill")
    top = often.withColumn("r", F.row_number().over(best)).where(F.col("r") <= skills)
    common = top.groupBy("profile_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("r", "skill"))), lambda x: x["skill"]).alias("common_skills"))
    return first.join(common, "profile_id", "left")
