"""Résumé texts: sections, dates, experience, education, quality, contact signals, report scores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, MapType, StringType, StructType

from postwright.functions.session import cut_off
from postwright.functions.text import alias_key, fold, once
from postwright.operators.attributes import folded_candidate, has, with_domains_of

# Headings of sections in folded form.
SECTIONS = {
    "profile": "profile", "summary": "profile", "profil": "profile", "resume": "profile", "education": "education", "formation": "education",
    "experience": "experience", "work experience": "experience", "experience professionnelle": "experience", "competences": "skills",
    "skills": "skills", "technical skills": "skills", "competences techniques": "skills", "projets": "projects", "projects": "projects",
    "certifications": "certifications", "languages": "languages", "langues": "languages", "activities": "activities",
    "vie associative": "activities", "interests": "interests", "centres d'interet": "interests",
}
#: What lines with a heading are: two words at most, and a colon.
FEW_WORDS = r"^\s*+(?:\S++\s*+){0,3}+$"
# Month names in folded form, English and French.
MONTHS = {
    "january": 1, "february": 2, "march": 3, "april": 4, "may": 5, "june": 6, "july": 7, "august": 8, "september": 9, "october": 10,
    "november": 11, "december": 12, "jan": 1, "feb": 2, "mar": 3, "apr": 4, "jun": 6, "jul": 7, "aug": 8, "sep": 9, "oct": 10, "nov": 11,
    "dec": 12, "janvier": 1, "fevrier": 2, "mars": 3, "avril": 4, "mai": 5, "juin": 6, "juillet": 7, "aout": 8, "septembre": 9,
    "octobre": 10, "novembre": 11, "decembre": 12,
}
PRESENT = "present|current|actuelle|actuel|aujourd'hui|a ce jour|en cours"
_DATE = r"\d{1,2}[/-]\d{1,2}[/-]\d{2,4}|\d{1,2}[/-]\d{4}|(?:" + "|".join(sorted(MONTHS, key=len, reverse=True)) + r")\s+\d{4}"
#: Of folded text: the start and the end of a date range.
DATE_RANGE = rf"({_DATE})\s*(?:[-/–—]|to|a)\s*({PRESENT}|{_DATE})"
#: What every date range has, and is soon looked for: the end of a date, the sign between the dates, a word or a number.
RANGE_SIGN = r"(?:\d[/-]\d{2,4}|[a-z]\s+\d{4})\s*(?:[-/–—]|to|a)\s*[a-z\d]"

#: Characters of the longest date range and more, where blanks are collapsed.
LONGEST_RANGE = 50

EDUCATION_LEVELS = [
    ("bachelor/licence", r"\b(bachelor|licence)\b"),
    ("master/mba", r"\b(master|mba)\b"),
    ("engineering_degree", r"\b(ingenieur|engineering degree)\b"),
    ("phd/doctorat", r"\b(phd|doctorat)\b"),
    ("baccalaureat", r"baccalaureat"),
]
EDUCATION_FIELDS = [
    ("management", r"management|gestion"),
    ("data science", r"data science"),
    ("software engineering", r"informatique|computer science|software"),
    ("marketing", r"marketing"),
    ("finance", r"finance|accounting|comptabil"),
]
ENROLLED = r"expected graduation|student in|en cours|present|1st year|premiere annee|2nd year|deuxieme annee|3rd year|troisieme annee|4th year|quatrieme annee|5th year|cinquieme annee"
# Business terms and role families with their words, folded.
BUSINESS_TERMS = {
    "Management": ["management", "gestion", "manager"],
    "Customer Service": ["customer service", "accueil client", "orientation des clients", "service client"],
    "Customer Relationship Management": ["relation client", "conseil client", "client advisory"],
    "Sales": ["sales", "vente", "vente de produits", "suivi des ventes", "encaissement"],
    "Business Development": ["business development", "developpement commercial"],
    "Communication": ["communication", "prise de parole en public", "public speaking"],
    "Leadership": ["leadership"],
    "Teamwork": ["teamwork", "travail d'equipe", "esprit d'equipe"],
    "Organization": ["organisation", "organization"],
    "Insurance": ["insurance", "assurance", "dossiers de souscription"],
    "Administrative Operations": ["administrative", "suivi des dossiers", "document processing", "controle des dossiers"],
    "Digital Transformation": ["digital transformation", "transformation digitale"],
    "Innovation Management": ["innovation"],
    "Sponsorship": ["sponsoring", "sponsorship"],
    "Media Production": ["medias", "media production"],
    "Stock Management": ["gestion des stocks", "stock management"],
    "Commercial Support": ["soutien commercial", "commercial support", "accompagnement des etudiants"],
    "Retail": ["retail", "boutique", "magasin"],
    "Marketing": ["marketing"],
    "Project Coordination": ["coordination de projet", "project coordination", "projet"],
}
ROLE_FAMILIES = {
    "Data / AI": ["data scientist", "machine learning", "ia", "ai", "python", "pytorch"],
    "Software Engineering": ["software", "developer", "developpeur", "java", "api"],
    "Management": ["management", "manager", "gestion"],
    "Sales": ["sales", "vente", "commercial"],
    "Customer Service": ["customer", "client", "accueil"],
    "Business Development": ["business development", "developpement commercial"],
    "Marketing": ["marketing"],
    "Finance": ["finance", "accounting", "comptabilite"],
    "Insurance": ["insurance", "assurance"],
    "Human Resources": ["human resources", "ressources humaines", "rh"],
    "Project Management": ["project management", "gestion de projet", "chef de projet"],
    "Operations": ["operations"],
}
# Patterns of contacts and of results in figures.
EMAIL = r"[A-Za-z0-9][A-Za-z0-9._%+-]*@[A-Za-z0-9.-]+\.[A-Za-z]{2,}"
PHONE = r"(?<!\d)(\+?\d[\d\s().-]{5,}\d)(?!\d)"
YEAR_RANGE = r"^\s*\d{4}\s*[-–—]\s*\d{4}\s*$"
LINKS = r"(?i)linkedin\.com/\S+|github\.com/\S+|\blinkedin\b|\bgithub\b"
METRIC = (
    r"(?i)\b\d+(?:[.,]\d+)?\s*%|\b\d+(?:[.,]\d+)?\s*(?:percent(?:age)?s?|hours?|hrs?|days?|weeks?|months?|years?|users?|customers?|clients?|projects?|tickets?|bugs?|errors?|requests?|"
    r"records?|reports?|teams?|people|employees|candidates|applications)\b|[$€£]\s*\d+(?:[.,]\d+)?\s*(?:k|m|b|thousand|million)?\b|"
    r"\b\d+\+\s*(?:users?|customers?|clients?|projects?|tickets?|bugs?|errors?|requests?|records?|reports?|teams?|people|employees|candidates|applications)\b"
)
# The most of each check of the report.
CHECK_MAX = {"impact": 25.0, "sections": 15.0, "contact": 10.0, "ats": 15.0, "gap": 20.0, "spelling": 15.0}


def clean_text(text: Column) -> Column:
    """Line feeds alone, plain blanks, ligatures as letters, letter-spaced words joined.

    A line's segments between runs of two blanks or more are joined where they have
    three tokens or more, four fifths of them single characters.
    """
    t = F.regexp_replace(F.regexp_replace(text, r"\r\n?", "\n"), " ", " ")
    t = F.replace(F.replace(t, F.lit("ﬁ"), F.lit("fi")), F.lit("ﬂ"), F.lit("fl"))

    def joined(segment: Column) -> Column:
        tokens = F.filter(F.split(segment, " "), lambda x: x != "")
        single = F.size(F.filter(tokens, lambda x: F.char_length(x) == 1))
        return F.when((F.size(tokens) >= 3) & (single * 5 >= F.size(tokens) * 4), F.array_join(tokens, "")).otherwise(segment)

    line = lambda x: F.when(x.rlike(r"\S \S "), F.array_join(F.transform(F.split(x, r" {2,}"), joined), " ")).otherwise(x)
    return F.array_join(F.transform(F.split(t, "\n", -1), line), "\n")


def sections(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """``(doc_id, heading, label, start, end)``: from behind a heading line to the next one or the end."""
    key = lambda line: F.regexp_replace(F.trim(F.regexp_replace(fold(F.replace(line, F.lit("’"), F.lit("'"))), r"\s*:?\s*$", "")), r"\s+", " ")
    table = F.create_map(*[F.lit(x) for kv in SECTIONS.items() for x in kv])
    # only lines of a few words are folded, and only headings leave their document
    label = lambda line: F.when(line.rlike(FEW_WORDS), F.element_at(table, key(line)))
    cut = F.transform(F.split(text, "\n", -1), lambda line: once(label(line), lambda known: F.struct(F.char_length(line).alias("length"), known.alias("label"), F.when(known.isNotNull(), F.trim(line)).alias("heading"))))
    lines = docs.select(F.col(id_col).alias("doc_id"), F.char_length(text).alias("size"), F.posexplode(cut).alias("pos", "line")).select("doc_id", "size", "pos", "line.*")
    order = Window.partitionBy("doc_id").orderBy("pos")
    placed = lines.withColumn("from", F.sum(F.col("length") + 1).over(order) - F.col("length") - 1)
    heads = placed.where("label is not null")
    return heads.select(
        "doc_id", "heading", "label", (F.col("from") + F.col("length")).cast("long").alias("start"),
        F.coalesce(F.lead("from").over(order), F.col("size")).cast("long").alias("end"),
    )


def _year(x: Column) -> Column:
    return F.nullif(F.regexp_extract(x, r"(20\d{2}|19\d{2})", 1), F.lit("")).cast("int")


def _month(x: Column) -> Column:
    digits = F.nullif(F.regexp_extract(x, r"^(\d{1,2})[/-]", 1), F.lit("")).cast("int")
    name = F.element_at(F.create_map(*[F.lit(v) for kv in MONTHS.items() for v in kv]), F.regexp_extract(x, r"^([a-z]+)", 1))
    return F.when(digits.isNotNull(), F.when(digits.between(1, 12), digits)).otherwise(name)


def duration_months(start: Column, end: Column, as_of: Column) -> Column:
    """Months of a range of folded dates, both ends included; an end in the present is ``as_of``. Null if it ends before it starts."""
    now = end.rlike(f"^({PRESENT})$")
    ey = F.when(now, F.year(as_of)).otherwise(_year(end))
    sm = F.coalesce(_month(start), F.lit(1))
    em = F.when(now, F.month(as_of)).otherwise(F.coalesce(_month(end), sm))
    months = (ey - _year(start)) * 12 + em - sm + 1
    return F.when(months >= 0, F.greatest(F.lit(1), months))


def experience_entries(docs: DataFrame, as_of: Column, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """``(doc_id, pos, entry_type, start_date, end_date, months, evidence)``: windows of three lines with a date range.

    Volunteer work is dropped; windows with the same first 120 characters count once.
    """
    lines = F.filter(F.transform(F.split(text, "\n"), lambda x: F.trim(x)), lambda x: x != "")
    rows = docs.select(F.col(id_col).alias("doc_id"), lines.alias("lines")).select("doc_id", "lines", F.transform("lines", alias_key).alias("keys"))
    # lines are folded once and meet in their row
    folded = lambda k: F.array_join(F.filter(F.slice("keys", k + 1, 3), lambda x: x != ""), " ")
    dated = lambda x: x.rlike(RANGE_SIGN) & x.rlike(DATE_RANGE)
    # a long line is searched once, and then its ends in each of its windows; as blanks are collapsed, no range is longer than an end
    ends = lambda x: F.when(F.char_length(x) > 4 * LONGEST_RANGE, F.struct(F.concat(F.left(x, F.lit(LONGEST_RANGE)), F.lit("\0"), F.right(x, F.lit(LONGEST_RANGE))).alias("ends"), dated(x).alias("dated"))).otherwise(F.struct(x.alias("ends"), F.lit(False).alias("dated")))
    rows = rows.withColumn("short", F.transform("keys", ends))
    meets = lambda near: F.exists(near, lambda x: x["dated"]) | dated(F.array_join(F.filter(F.transform(near, lambda x: x["ends"]), lambda x: x != ""), " "))
    windows = F.filter(F.transform("short", lambda _, k: F.struct(k.alias("pos"), meets(F.slice("short", k + 1, 3)).alias("dated"))), lambda w: w["dated"])
    rows = rows.select("doc_id", "lines", "keys", F.explode(F.transform(windows, lambda w: w["pos"])).alias("pos"))
    rows = rows.select("doc_id", "pos", folded(F.col("pos")).alias("folded"), F.array_join(F.slice("lines", F.col("pos") + 1, 3), " ").alias("context"))
    has = lambda p: F.col("folded").rlike(p)
    kind = F.when(has("internship|stage|stagiaire"), "internship").when(has("alternance"), "apprenticeship").when(has("volunteer|benevole|associative"), "volunteer").otherwise("job")
    start, end = (F.regexp_extract("folded", DATE_RANGE, k) for k in (1, 2))
    out = rows.select("doc_id", "pos", kind.alias("entry_type"), start.alias("start_date"), end.alias("end_date"), duration_months(start, end, as_of).alias("months"), F.substring("context", 1, 300).alias("evidence"))
    first = Window.partitionBy("doc_id", alias_key(F.substring("evidence", 1, 120))).orderBy("pos")
    return out.where("entry_type <> 'volunteer'").withColumn("__n", F.row_number().over(first)).where("__n = 1").drop("__n")


def education(text: Column) -> Column:
    """Struct of level, field, status, graduation year and confidence; all null without a trace of education."""
    return once(alias_key(text), lambda n: folded_education(n, text))


def folded_education(n: Column, text: Column) -> Column:
    """``education`` of a text whose key is ``n``; each part is found once."""
    pick = lambda table: F.coalesce(*[F.when(has(n, p, ""), v) for v, p in table])
    found = F.struct(pick(EDUCATION_LEVELS).alias("level"), pick(EDUCATION_FIELDS).alias("field"), has(n, ENROLLED, "").alias("enrolled"), has(n, "graduated|diplome", "").alias("done"))
    year = F.when(text.contains("202") | text.contains("203"), F.nullif(F.regexp_extract(text, r"\b(202[3-9]|203\d)\b", 1), F.lit("")).cast("int"))

    def whole(x: Column) -> Column:
        level, field = x["level"], x["field"]
        status = F.when(x["enrolled"], "currently_enrolled").when(x["done"] | (level.isNotNull() & ~x["enrolled"]), "graduated")
        known = level.isNotNull() | field.isNotNull()
        points = lambda c, v: F.when(c.isNotNull(), v).otherwise(0.0)
        confidence = F.least(F.lit(1.0), F.lit(0.35) + points(level, 0.25) + points(field, 0.2) + points(status, 0.1))
        return F.struct(
            level.alias("level"), field.alias("field"), F.when(known, status).alias("status"),
            F.when(known, year).alias("graduation_year"), F.when(known, F.round(confidence, 2)).alias("confidence"),
        )

    return once(found, whole)


def term_families(docs: DataFrame, families: dict[str, list[str]], id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """``(doc_id, family, evidence, confidence)``: the words of each family that the folded text has.

    Words of two letters must stand alone. Confidence is 0.35 and 0.15 for each word, 1 at most.
    """
    n = F.col("folded")
    entry = lambda f, ws: F.struct(
        F.lit(f).alias("family"),
        F.filter(F.array(*[F.when(n.rlike(rf"\b{w}\b") if len(w) <= 2 else n.contains(w), F.lit(w)) for w in ws]), lambda x: x.isNotNull()).alias("evidence"),
    )
    rows = docs.select(F.col(id_col).alias("doc_id"), alias_key(F.coalesce(text, F.lit(""))).alias("folded"))
    rows = rows.select("doc_id", F.explode(F.filter(F.array(*[entry(f, ws) for f, ws in families.items()]), lambda e: F.size(e["evidence"]) > 0)).alias("e"))
    return rows.select("doc_id", "e.family", F.sort_array("e.evidence").alias("evidence"), F.least(F.lit(1.0), F.round(0.35 + 0.15 * F.size("e.evidence"), 2)).alias("confidence"))


def extraction_quality(n_sections: Column, has_education: Column, has_experience: Column, has_domain: Column, n_skills: Column, text_quality: Column, ambiguous: Column) -> Column:
    """Struct of score, label and warnings. A profile without domain, education or experience is low whatever else it has."""
    p = lambda c, v: F.when(c, v).otherwise(0.0)
    doubtful = ambiguous & (n_skills <= 1)
    score = p(has_domain, 0.15) + p(has_education, 0.18) + p(has_experience, 0.2) + F.least(F.lit(0.18), n_skills * 0.045) + F.least(F.lit(1.0), n_sections / 5) * 0.14 + text_quality * 0.1 - p(doubtful, 0.12)
    score = F.greatest(F.lit(0.0), F.least(F.lit(1.0), score))
    score = F.when(~has_domain | ~has_education | ~has_experience | doubtful, F.least(score, F.lit(0.39))).otherwise(score)
    warn = lambda c, w: F.when(c, F.lit(w))
    warnings = F.filter(
        F.array(warn(ambiguous, "ambiguous_single_character_alias_detected"), warn(~has_domain, "no_domain_detected"), warn(~has_education, "no_education_detected"),
                warn(~has_experience, "no_experience_detected"), warn(n_skills <= 1, "too_few_reliable_skills")), lambda w: w.isNotNull())
    return F.struct(F.round(score, 4).alias("score"), F.when(score >= 0.75, "high").when(score >= 0.45, "medium").otherwise("low").alias("label"), warnings.alias("warnings"))


def contact_signals(text: Column) -> Column:
    """Struct of four flags; what was found isn't kept."""
    phones = F.regexp_extract_all(text, F.lit(PHONE), F.lit(1))
    digits = lambda x: F.char_length(F.regexp_replace(x, r"\D", ""))
    head = F.slice(F.filter(F.transform(F.split(text, "\n"), lambda x: F.trim(F.regexp_replace(x, r"\s+", " "))), lambda x: x != ""), 1, 6)
    first = lambda x: F.trim(F.get(F.split(x, r"\s*[|•·]\s*"), 0))
    excluded = ["experience", "education", "skills", "competences", "competencies", "summary", "profile", "contact", "languages", "certifications", "projects", "volunteer"]

    def name(x: Column) -> Column:
        c = first(x)
        low = F.regexp_replace(F.lower(c), ":$", "")
        n = F.regexp_count(c, F.lit(r"[A-Za-zÀ-ÖØ-öø-ÿ][A-Za-z'’-]*"))
        return ~low.isin(excluded) & ~c.rlike(r"\d|@") & ~low.rlike("http|linkedin|github") & n.between(2, 5) & (F.char_length(c) <= 60)

    return F.struct(
        text.rlike(EMAIL).alias("has_email"),
        F.exists(phones, lambda x: ~x.rlike(YEAR_RANGE) & digits(x).between(7, 15)).alias("has_phone"),
        text.rlike(LINKS).alias("has_link"),
        F.exists(head, name).alias("has_name"),
    )


def impact(entries: DataFrame) -> DataFrame:
    """For each document the share of its entries with a measurable result."""
    return entries.groupBy("doc_id").agg(F.count("*").alias("entries"), F.count_if(F.col("evidence").rlike(METRIC)).alias("quantified"))


def report_checks(quantified: Column, entries: Column, has_skills: Column, has_summary: Column, contact: Column, has_education: Column, label: Column, gaps: Column, issues: Column) -> Column:
    """Array of ``(check, score, max)``; spelling that wasn't checked (null issues) has no row."""
    flag = lambda c: F.when(c, 1).otherwise(0)
    found = flag(contact["has_email"]) + flag(contact["has_phone"]) + flag(contact["has_link"]) + flag(contact["has_name"])
    ready = flag(has_education) + flag(entries > 0) + flag(has_skills) + flag(label != "low")
    entry = lambda k, v: F.struct(F.lit(k).alias("check"), F.round(v.cast("double"), 1).alias("score"), F.lit(CHECK_MAX[k]).alias("max"))
    rows = [
        entry("impact", F.when(entries > 0, 25 * quantified / entries).otherwise(0.0)),
        entry("sections", F.when(has_skills, 10.0).otherwise(0.0) + F.when(F.coalesce(has_summary, F.lit(True)), 5.0).otherwise(0.0)),
        entry("contact", 10 * found / 4),
        entry("ats", 15 * ready / 4),
        entry("gap", F.greatest(F.lit(0.0), 20 - 4.0 * F.least(gaps, F.lit(5)))),
        F.when(issues.isNotNull(), entry("spelling", F.greatest(F.lit(0.0), 15 - 3.0 * issues))),
    ]
    return F.filter(F.array(*rows), lambda r: r.isNotNull())


def overall(checks: Column) -> Column:
    total = lambda k: F.aggregate(checks, F.lit(0.0), lambda a, x: a + x[k])
    return F.bround(100 * total("score") / total("max"), 0).cast("int")


def redacted(profiles: DataFrame, raw: tuple[str, ...] = ("text", "raw_text", "document_text")) -> DataFrame:
    """Profiles without the fields named in ``raw``, at any depth, before they are stored.

    The schema is followed through structs, arrays and maps (a map loses the entries with such a key); what holds
    no such field is left as it is. Null structs, arrays and maps stay null; a struct with no other field goes with it.
    """
    kept = [(f, _without(F.col(f"`{f.name}`"), f.dataType, raw)) for f in profiles.schema.fields if f.name not in raw and not _emptied(f.dataType, raw)]
    return profiles.select(*[c.alias(f.name) for f, c in kept])


def _emptied(kind: DataType, raw: tuple[str, ...]) -> bool:
    """A struct of raw fields only, or an array or map of such."""
    if isinstance(kind, StructType):
        return bool(kind.fields) and all(f.name in raw or _emptied(f.dataType, raw) for f in kind.fields)
    if isinstance(kind, ArrayType):
        return _emptied(kind.elementType, raw)
    return isinstance(kind, MapType) and _emptied(kind.valueType, raw)


def _holds(kind: DataType, raw: tuple[str, ...]) -> bool:
    if isinstance(kind, StructType):
        return any(f.name in raw or _holds(f.dataType, raw) for f in kind.fields)
    if isinstance(kind, ArrayType):
        return _holds(kind.elementType, raw)
    return isinstance(kind, MapType) and (isinstance(kind.keyType, StringType) or _holds(kind.keyType, raw) or _holds(kind.valueType, raw))


def _without(value: Column, kind: DataType, raw: tuple[str, ...]) -> Column:
    if not _holds(kind, raw):
        return value
    if isinstance(kind, StructType):
        fields = [_without(value.getField(f.name), f.dataType, raw).alias(f.name) for f in kind.fields if f.name not in raw and not _emptied(f.dataType, raw)]
        return F.when(value.isNotNull(), F.struct(*fields))
    if isinstance(kind, ArrayType):
        return F.transform(value, lambda x: _without(x, kind.elementType, raw))
    entries = F.map_filter(value, lambda k, _: ~k.isin(*raw)) if isinstance(kind.keyType, StringType) else value
    return F.transform_values(entries, lambda _, v: _without(v, kind.valueType, raw))


# What lets a single letter count as a language, and skills that make a profile technical.
LETTER_CONTEXT = [
    "r programming", "programming language r", "langage r", "python / r / sql", "python, r, sql", "r/python", "r / python", "rstudio",
    "statistical analysis using r", "c programming", "programming language c", "langage c", "c/c++", "c, c++",
]
TECHNICAL_SKILLS = ["Python", "Data Science", "Machine Learning", "Artificial Intelligence"]
TECHNICAL_DOMAINS = ["AI", "Data Science", "Machine Learning", "Software Engineering"]
LETTERS = ["R", "C"]
#: Matches of letters that are broadcast; more are joined by shuffle.
BROADCAST_LETTERS = 200_000


def profile_skills(docs: DataFrame, found: DataFrame, placed: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """``found`` (matches) with ``confidence``: 1.0 within a skills section, 0.82 in another section, 0.7 outside.

    R and C count within a skills section, or where the 60 characters around name a language. ``placed``: ``sections``.
    """
    s = placed.select(F.col("doc_id").alias("__d"), "label", F.col("start").alias("__from"), F.col("end").alias("__to"))
    inside = (F.col("doc_id") == F.col("__d")) & (F.col("start") >= F.col("__from")) & (F.col("start") < F.col("__to"))
    d = found.join(s, inside, "left").drop("__d", "__from", "__to")
    left = F.greatest(F.col("start") - 60, F.lit(0))
    window = F.lower(F.substring("__text", (left + 1).cast("int"), (F.col("end") + 60 - left).cast("int")))
    allowed = F.lit(False)
    for p in LETTER_CONTEXT:
        allowed = allowed | window.contains(p)
    skill = F.coalesce(F.col("label") == "skills", F.lit(False))
    # texts are looked into for letters outside a skills section alone, and where these are few they don't leave their place
    d = cut_off(d)
    doubtful = F.col("canonical").isin(LETTERS) & ~skill
    letters = d.where(doubtful)
    letters = F.broadcast(letters) if letters.count() <= BROADCAST_LETTERS else letters
    letters = letters.join(docs.select(F.col(id_col).alias("doc_id"), F.col(text).alias("__text")), "doc_id").where(allowed).drop("__text")
    return d.where(~doubtful).unionByName(letters).withColumn("confidence", F.when(skill, 1.0).when(F.col("label").isNotNull(), 0.82).otherwise(0.7))


def deterministic_profiles(docs: DataFrame, found: DataFrame, as_of: Column, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """One row for each résumé: skills with confidence, candidate attributes, experience, education, quality.

    Sections, matches, entries and attributes are computed once each and joined by document;
    grounded entries override what the text states, and technical domains need a technical skill.
    """
    placed = sections(docs, id_col, text)
    skills = profile_skills(docs, found, placed, id_col, text).groupBy("doc_id").agg(
        F.sort_array(F.collect_list(F.struct("start", "canonical", "confidence"))).alias("skills")
    )
    entries = experience_entries(docs, as_of, id_col, text).groupBy("doc_id").agg(
        F.sum("months").alias("entry_months"), F.count_if(F.col("entry_type") == "internship").alias("n_intern"), F.count_if(F.col("entry_type") == "job").alias("n_job"), F.count("*").alias("n_entries")
    )
    n_sections = placed.groupBy("doc_id").agg(F.count_distinct("label").alias("n_sections"))
    body = F.coalesce(F.col(text), F.lit(""))
    none = F.expr("cast(array() as array<string>)")
    said = once(alias_key(body), lambda n: F.struct(folded_education(n, body).alias("e"), folded_candidate(n, body, none).alias("c")))
    # what the text says is all that is shuffled of it
    d = docs.select(F.col(id_col).alias("doc_id"), said.alias("said")).select("doc_id", "said.*")
    d = d.join(skills, "doc_id", "left").join(entries, "doc_id", "left").join(n_sections, "doc_id", "left")
    names = F.coalesce(F.transform("skills", lambda s: s["canonical"]), F.expr("cast(array() as array<string>)"))
    d = d.withColumn("names", names).withColumn("preferred", with_domains_of(F.col("c.preferred_domains"), F.col("names")))
    technical = F.arrays_overlap("names", F.array(*[F.lit(s) for s in TECHNICAL_SKILLS]))
    domains = F.when(technical, F.col("preferred")).otherwise(F.array_except(F.col("preferred"), F.array(*[F.lit(x) for x in TECHNICAL_DOMAINS])))
    graduated, has_entries = F.coalesce(F.col("e.status") == "graduated", F.lit(False)), F.coalesce(F.col("n_entries") > 0, F.lit(False))
    level = F.when((graduated & has_entries) | ((F.col("c.career_level") == "unknown") & F.col("e.level").isNotNull()), "junior").otherwise(F.col("c.career_level"))
    months = F.coalesce("entry_months", "c.total_months")
    quality = extraction_quality(F.coalesce("n_sections", F.lit(0)), F.col("e.level").isNotNull() | F.col("e.field").isNotNull(), has_entries, F.size(domains) > 0, F.size("names"), F.lit(1.0), F.lit(False))
    return d.select(
        "doc_id", "skills", level.alias("career_level"), months.alias("total_months"), F.round(months / 12, 2).alias("total_years"),
        F.greatest("c.internship_count", F.coalesce("n_intern", F.lit(0))).alias("internship_count"), F.greatest("c.professional_count", F.coalesce("n_job", F.lit(0))).alias("professional_count"),
        domains.alias("domains"), F.col("e").alias("education"), quality.alias("quality"),
    )
