"""Attributes of jobs and candidates from their texts, as column expressions."""

from __future__ import annotations

import re
from functools import partial, reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from postwright.functions.text import alias_key, once

# Patterns in order of precedence, over folded text.
LEVELS = [
    ("principal", r"\b(principal|staff)\b"),
    ("lead", r"\b(lead|tech lead|leader technique)\b"),
    ("manager", r"\b(manager|responsable|head of|chef de projet)\b"),
    ("senior", r"\b(senior|sr\.?|confirme|experimente)\b"),
    ("junior", r"\b(junior|debutant)\b"),
    ("internship", r"\b(stage|stagiaire|internship|intern)\b"),
    ("apprenticeship", r"\b(alternance|apprenti(?:e|s)?|apprentice)\b"),
    ("consultant", r"\bconsultant\b"),
]
JOB_TYPES = [
    ("freelance", r"\b(freelance|independant)\b"),
    ("stage", r"\b(stage|stagiaire|internship)\b"),
    ("apprenticeship", r"\b(alternance|apprenti(?:e|s)?|apprentice)\b"),
    ("cdi", r"\bcdi\b"),
    ("cdd", r"\bcdd\b"),
    ("hybrid", r"\b(hybrid|hybride)\b"),
    ("remote", r"\b(remote|teletravail|fully remote|full remote)\b"),
    ("on_site", r"\b(on[- ]?site|presentiel)\b"),
]
CONTRACT_TYPES = [("cdi", "cdi"), ("cdd", "cdd"), ("freelance", "freelance"), ("stage", "stage"), ("apprenticeship", "alternance")]
ROLES = [
    ("student", r"\b(student|etudiant|eleve ingenieur)\b"),
    ("Intern", r"\b(intern|internship|stagiaire|stage)\b"),
    ("Junior Data Scientist", r"\bjunior\s+data\s+scientist\b"),
    ("Data Scientist", r"\bdata\s+scientist\b"),
    ("Data Engineer", r"\bdata\s+engineer|ingenieur\s+data\b"),
    ("AI Engineer", r"\b(ai|ia)\s+engineer|ingenieur\s+ia\b"),
    ("Backend Developer", r"\bbackend\s+(developer|engineer)|developpeur\s+backend\b"),
]
EDUCATION = [
    ("PhD", r"\b(phd|doctorat|doctoral)\b"),
    ("Student", r"\b(student|etudiant|master|msc|bachelor|licence|ecole)\b"),
    ("Graduated", r"\b(graduated|diplome|graduate)\b"),
]
CITIES = [("Paris", r"\bparis\b"), ("Nantes", r"\bnantes\b"), ("Lyon", r"\blyon\b"), ("Marseille", r"\bmarseille\b"), ("Toulouse", r"\btoulouse\b")]
COUNTRIES = [("fr", r"\b(france|fr)\b"), ("us", r"\b(united states|usa|us)\b"), ("gb", r"\b(united kingdom|uk|gb)\b")]
DOMAIN_OF_SKILL = {
    "Artificial Intelligence": "AI",
    "Data Engineering": "Data Engineering",
    "Data Science": "Data Science",
    "Machine Learning": "Machine Learning",
    "Computer Vision": "Computer Vision",
    "Natural Language Processing": "NLP",
    "Retrieval-Augmented Generation": "RAG",
    "Generative AI": "Generative AI",
    "Backend Development": "Backend",
    "Cloud Computing": "Cloud",
    "DevOps": "DevOps",
    "Cybersecurity": "Security",
}
DOMAIN_TEXTS = [
    ("Data Science", r"\bdata science|data scientist|data analyst\b"),
    ("Data Engineering", r"\bdata engineering|data engineer|ingenieur data\b"),
    ("Machine Learning", r"\bmachine learning|\bml\b"),
    ("AI", r"\bai\b|\bia\b|intelligence artificielle"),
    ("Computer Vision", r"computer vision|vision par ordinateur"),
    ("NLP", r"\bnlp\b|natural language|traitement du langage"),
    ("RAG", r"\brag\b|retrieval"),
    ("Generative AI", r"generative ai|genai|ia generative"),
    ("Software Engineering", r"developer|developpeur|full stack|informatique|software|logiciel"),
    ("Backend", r"backend|back-end"),
    ("Cloud", r"cloud|aws|azure|gcp"),
    ("DevOps", r"devops|sre|ci/cd"),
    ("Security", r"security|securite|cybersecurity|cybersecurite"),
]
YEARS_RANGE = r"(?i)(\d+(?:[.,]\d+)?)\s*(?:-|a|to)\s*(\d+(?:[.,]\d+)?)\s*(?:years?|ans?|annees?)"
YEARS = r"(?i)(\d+(?:[.,]\d+)?)\s*\+?\s*(?:years?|ans?|annees?)"
MONTHS = r"(?i)(\d+)\s*(?:months?|mois)"

EMPTY = "cast(array() as array<string>)"


def _alternatives(pattern: str) -> list[str]:
    """The alternatives of a pattern of words and simple groups; what isn't plain letters is a NUL."""
    plain = re.sub(r"\((?:\?:)?[^()]*\)\?|\[[^\]]*\]\??|\\?.\?(?!:)|\\.\+?", "\0", pattern.replace("(?:", "("))
    return re.split(r"\|(?![^(]*\))", plain)


def signs(pattern: str) -> list[str]:
    """Plain strings of which each match of a pattern has one: the longest outside an alternative's groups, else those within."""
    out = set()
    for a in _alternatives(pattern):
        outside = re.sub(r"\([^)]*\)", "\0", a).strip("\0")
        out |= {max(part.split("\0"), key=len) for part in ([outside] if outside else re.split(r"[()|]", a)) if part.strip("\0")}
    return sorted(s for s in out if not any(t != s and t in s for t in out))


def soon(pattern: str) -> str:
    """The same pattern, which looks at the first letter before it looks for the edge of a word."""
    heads = [a.lstrip("\0") for a in _alternatives(pattern)]
    words = [w for h in heads for w in (h[1 : h.index(")")].split("|") if h.startswith("(") else [h])]
    return f"(?=[{''.join(sorted({w[0] for w in words}))}])(?:{pattern})" if all(w[:1].isalpha() for w in words) else pattern


def has(text: Column, pattern: str, flags: str = "(?U)") -> Column:
    """Whether the (folded) text has a match: one of its signs, which are soon looked for, and then the pattern."""
    some = reduce(lambda a, b: a | b, [text.contains(s) for s in signs(pattern)])
    return some if re.fullmatch(r"[a-z0-9 /-]+(\|[a-z0-9 /-]+)*", pattern) else some & text.rlike(flags + soon(pattern))


def count_of(text: Column, pattern: str) -> Column:
    """How many matches the (folded) text has."""
    return F.when(has(text, pattern), F.regexp_count(text, F.lit(f"(?U){soon(pattern)}"))).otherwise(F.when(text.isNotNull(), 0))


def first_of(text: Column, patterns: list[tuple[str, str]]) -> Column:
    """The value of the first pattern that the (folded) text has."""
    return F.coalesce(*[F.when(has(text, p), F.lit(v)) for v, p in patterns])


def _folded(*texts: Column) -> Column:
    """Array of the texts' keys; null texts are empty."""
    return F.array(*[alias_key(F.coalesce(x, F.lit(""))) for x in texts])


def career_level(title: Column, description: Column) -> Column:
    """Struct of level, source and evidence: the title goes before the description."""
    return once(_folded(title, description), _level)


def _level(keys: Column) -> Column:
    out = []
    for k, source in enumerate(("title", "description")):
        x = keys[k]
        for level, p in LEVELS:
            out.append(
                F.when(x.rlike(f"(?U){p}"), F.struct(F.lit(level).alias("value"), F.lit(source).alias("source"), F.regexp_extract(x, f"(?U){p}", 0).alias("evidence")))
            )
    unknown = F.struct(F.lit("unknown").alias("value"), F.lit(None).cast("string").alias("source"), F.lit(None).cast("string").alias("evidence"))
    return F.coalesce(*out, unknown)


def _float(x: Column) -> Column:
    return F.replace(x, F.lit(","), F.lit(".")).cast("double")


def required_years(text: Column) -> Column:
    """Struct of ``low`` and ``high``: the first range, else the least of all years."""
    low = F.nullif(F.regexp_extract(text, YEARS_RANGE, 1), F.lit(""))
    high = F.nullif(F.regexp_extract(text, YEARS_RANGE, 2), F.lit(""))
    least = F.array_min(F.transform(F.regexp_extract_all(text, F.lit(YEARS), F.lit(1)), _float))
    return F.struct(F.coalesce(_float(low), least).alias("low"), _float(high).alias("high"))


def job_types(title: Column, description: Column, contract: Column, is_remote: Column) -> Column:
    """Distinct ``(value, source, evidence)`` of all hits, the contract's name and the remote flag."""
    return once(_folded(title, description, contract), lambda keys: _types(keys, contract, is_remote))


def _types(keys: Column, contract: Column, is_remote: Column) -> Column:
    entry = lambda v, s, e: F.struct(F.lit(v).alias("value"), F.lit(s).alias("source"), e.alias("evidence"))
    none = F.expr("cast(array() as array<struct<value:string,source:string,evidence:string>>)")
    parts = []
    for k, source in enumerate(("title", "description")):
        for value, p in JOB_TYPES:
            parts.append(F.transform(F.regexp_extract_all(keys[k], F.lit(f"(?U){p}"), F.lit(0)), partial(entry, value, source)))
    for value, token in CONTRACT_TYPES:
        parts.append(F.when(keys[2].contains(token), F.array(entry(value, "metadata", contract))).otherwise(none))
    parts.append(
        F.when(is_remote, F.array(entry("remote", "metadata", F.lit("is_remote=True"))))
        .when(~is_remote, F.array(entry("on_site", "metadata", F.lit("is_remote=False"))))
        .otherwise(none)
    )
    return F.array_distinct(F.concat(*parts))


def remote_mode(text: Column, is_remote: Column, types: Column) -> Column:
    """Hybrid, then remote, then on site, then what the folded text says; ``types`` is an array of values."""
    has = lambda v: F.array_contains(types, v)
    return (
        F.when(has("hybrid"), "hybrid")
        .when(F.coalesce(is_remote, F.lit(False)) | has("remote"), "remote")
        .when(~F.coalesce(is_remote, F.lit(True)) | has("on_site"), "on_site")
        .when(text.rlike(r"(?U)\b(teletravail|remote)\b"), "remote")
    )


def domains(text: Column, skills: Column) -> Column:
    """Sorted domains of the skills and of the folded text."""
    from_text = F.filter(F.array(*[F.when(has(text, p), F.lit(d)) for d, p in DOMAIN_TEXTS]), lambda d: d.isNotNull())
    return with_domains_of(from_text, skills)


def with_domains_of(known: Column, skills: Column) -> Column:
    """Sorted domains: those known and those of the skills."""
    of = F.create_map(*[F.lit(x) for kv in DOMAIN_OF_SKILL.items() for x in kv])
    from_skills = F.filter(F.transform(F.coalesce(skills, F.expr(EMPTY)), lambda s: F.element_at(of, s)), lambda d: d.isNotNull())
    return F.sort_array(F.array_distinct(F.concat(from_skills, known)))


def job_attributes(title: Column, description: Column, contract: Column, is_remote: Column, country: Column, city: Column, skills: Column) -> Column:
    """Struct of what title, description and contract say; each is folded once, and each part found once."""
    text = F.concat_ws("\n\n", F.coalesce(title, F.lit("")), F.coalesce(description, F.lit("")), F.coalesce(contract, F.lit("")))

    def whole(x: Column) -> Column:
        level, years, types, values = (x[c] for c in ("level", "years", "types", "values"))
        return F.struct(
            level["value"].alias("career_level"),
            years["low"].alias("experience_min_years"),
            years["high"].alias("experience_max_years"),
            values.alias("job_types"),
            remote_mode(x["folded"], is_remote, values).alias("remote_mode"),
            country.alias("country"),
            city.alias("city"),
            domains(x["folded"], skills).alias("domains"),
            level.alias("career_level_provenance"),
            types.alias("job_type_provenance"),
        )

    def parts(keys: Column, types: Column) -> Column:
        values = F.sort_array(F.array_distinct(F.transform(types, lambda t: t["value"])))
        folded = F.array_join(F.filter(keys, lambda k: k != ""), " ")  # the key of the whole text
        return F.struct(_level(keys).alias("level"), required_years(text).alias("years"), types.alias("types"), values.alias("values"), folded.alias("folded"))

    return once(once(_folded(title, description, contract), lambda keys: once(_types(keys, contract, is_remote), lambda types: parts(keys, types))), whole)


def candidate_months(text: Column) -> Column:
    """The most of all months, and of all years times twelve, that the text names."""
    months = F.transform(F.regexp_extract_all(text, F.lit(MONTHS), F.lit(1)), lambda m: m.cast("long"))
    years = F.transform(F.regexp_extract_all(text, F.lit(YEARS), F.lit(1)), lambda y: F.bround(_float(y) * 12).cast("long"))
    return F.array_max(F.concat(months, years))


def candidate_attributes(text: Column, skills: Column) -> Column:
    """Struct of what the text says of a candidate; it is folded once."""
    body = F.coalesce(text, F.lit(""))
    return once(alias_key(body), lambda n: folded_candidate(n, body, skills))


def folded_candidate(n: Column, text: Column, skills: Column) -> Column:
    """``candidate_attributes`` of a text whose key is ``n``."""
    found = F.struct(n.alias("n"), first_of(n, ROLES).alias("role"), first_of(n, EDUCATION).alias("education"), candidate_months(text).alias("months"))
    return once(found, lambda x: _candidate(x, skills))


def _candidate(x: Column, skills: Column) -> Column:
    n, role, education, months = (x[c] for c in ("n", "role", "education", "months"))
    years = F.round(months / 12, 2)
    level = (
        F.when(has(n, r"\b(student|etudiant|eleve ingenieur)\b"), "student")
        .when(F.coalesce(role == "Intern", F.lit(False)) | has(n, r"\b(intern|stagiaire)\b"), "internship")
        .when(has(n, r"\bjunior\b"), "junior")
        .when(has(n, r"\bsenior\b"), "senior")
        .when(education == "Student", "student")
        .when(years.isNull(), "unknown")
        .when(years < 1, "junior")
        .when(years < 4, "mid")
        .otherwise("senior")
    )
    remote = F.when(has(n, r"\b(remote|teletravail)\b"), True).when(has(n, r"\b(on[- ]?site|presentiel)\b"), False)
    return F.struct(
        role.alias("current_role"),
        level.alias("career_level"),
        education.alias("education_status"),
        count_of(n, r"\b(stage|stagiaire|internship|intern)\b").alias("internship_count"),
        count_of(n, r"\b(professional experience|work experience|experience professionnelle)\b").alias("professional_count"),
        months.alias("total_months"),
        years.alias("total_years"),
        domains(n, skills).alias("preferred_domains"),
        first_of(n, COUNTRIES).alias("preferred_country"),
        first_of(n, CITIES).alias("preferred_city"),
        remote.alias("remote_preference"),
    )


def elapsed_days(posted_at: Column, as_of: Column) -> Column:
    """Whole days of 24 hours since the posting."""
    return F.floor((F.unix_timestamp(as_of) - F.unix_timestamp(posted_at)) / 86400)


def is_stale(posted_at: Column, as_of: Column, days: int = 120) -> Column:
    return elapsed_days(posted_at, as_of) >= days


def job_card(title: Column, company: Column, city: Column, country: Column, low: Column, high: Column, currency: Column, period: Column, is_remote: Column) -> Column:
    """Struct of the texts a job is shown by."""
    amount = lambda x: F.format_number(x, 0)
    span = F.when(low == high, amount(low)).otherwise(F.concat_ws(" - ", amount(low), amount(high)))
    pay = F.when(F.coalesce(low, high).isNull(), "not given").otherwise(F.concat_ws(" ", span, currency, F.concat(F.lit("per "), period)))
    return F.struct(
        title.alias("title"),
        company.alias("company"),
        F.coalesce(F.nullif(F.concat_ws(", ", city, F.upper(country)), F.lit("")), F.lit("not given")).alias("location"),
        pay.alias("salary"),
        F.when(is_remote, "yes").when(~is_remote, "no").otherwise("not given").alias("remote"),
    )
