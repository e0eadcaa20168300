"""Board payloads to parsed postings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from postwright.functions import text as T

# Country names of the boards and their ISO codes.
ADZUNA_COUNTRIES = {
    "uk": "gb", "united kingdom": "gb", "gb": "gb", "france": "fr", "fr": "fr", "germany": "de", "de": "de",
    "deutschland": "de", "netherlands": "nl", "nederland": "nl", "nl": "nl", "spain": "es", "españa": "es",
    "espana": "es", "es": "es", "italy": "it", "italia": "it", "it": "it", "ireland": "ie", "ie": "ie",
    "belgium": "be", "be": "be", "switzerland": "ch", "ch": "ch", "austria": "at", "at": "at", "usa": "us",
    "us": "us", "united states": "us",
}
JOOBLE_COUNTRIES = {
    "france": "fr", "germany": "de", "netherlands": "nl", "spain": "es", "deutschland": "de", "nederland": "nl",
    "españa": "es", "espana": "es", "united kingdom": "gb", "uk": "gb", "great britain": "gb", "italy": "it",
    "italia": "it", "italian republic": "it", "kingdom of spain": "es",
}
# Contract names of the boards.
ADZUNA_CONTRACTS = {
    "full_time": "full_time", "part_time": "part_time", "permanent": "full_time", "contract": "contract",
    "internship": "internship", "temporary": "contract",
}
JOOBLE_CONTRACTS = {
    "full-time": "full_time", "full time": "full_time", "part-time": "part_time", "part time": "part_time",
    "contract": "contract", "internship": "internship", "temporary": "contract",
}

PARSED = [
    "raw_job_id", "source", "company_name", "title", "description", "location_raw", "country", "city", "is_remote",
    "contract_type", "salary_min", "salary_max", "salary_currency", "salary_period", "salary_is_predicted", "posted_at", "url",
]


def _value(path: str) -> Column:
    """A field of the payload as text; objects and arrays stay JSON."""
    return F.get_json_object("payload", f"$.{path}")


def _string(v: Column, path: str) -> Column:
    """A field that is a JSON string, trimmed; numbers, objects and blanks are null."""
    own = F.try_variant_get(v, f"$.{path}", "variant")
    return F.when(F.schema_of_variant(own) == "STRING", T.optional(F.try_variant_get(v, f"$.{path}", "string")))


def _number(v: Column, path: str) -> Column:
    """A field that is a JSON number."""
    own = F.try_variant_get(v, f"$.{path}", "variant")
    return F.when(F.schema_of_variant(own).rlike("^(BIGINT|DOUBLE|DECIMAL|FLOAT)"), F.try_variant_get(v, f"$.{path}", "double"))


def _fields(raw: DataFrame, strings: list[str], numbers: list[str] = [], values: list[str] = []) -> DataFrame:
    """``raw`` with the named fields of its payloads as columns (a dot becomes ``_``).

    A payload is parsed once, and its fields come out of a generator: what later columns
    and filters name of them is never worked out again.
    """
    name = lambda path: path.replace(".", "_")
    made = lambda v: F.struct(
        *[_string(v, p).alias(name(p)) for p in strings], *[_number(v, p).alias(name(p)) for p in numbers], *[_value(p).alias(name(p)) for p in values]
    )
    return raw.select("raw_job_id", "source", F.inline(F.transform(F.array(F.try_parse_json(F.col("payload"))), made)))


def adzuna(raw: DataFrame) -> DataFrame:
    """A row for each raw row, with ``reason`` where it can't be parsed."""
    raw = _fields(
        raw, ["company.display_name", "title", "description", "location.display_name", "contract_time", "contract_type", "created", "redirect_url"],
        ["salary_min", "salary_max"], ["location.area", "salary_is_predicted"],
    )
    area = F.from_json(F.coalesce(F.col("location_area"), F.lit("[]")), "array<string>")
    pay = T.whole_salary(F.col("salary_min"), F.col("salary_max"), F.lit(None).cast("string"), F.lit("year"))
    any_pay = pay["salary_min"].isNotNull()
    contract = F.coalesce(F.col("contract_time"), F.col("contract_type"))
    return raw.select(
        "raw_job_id",
        "source",
        F.coalesce(F.col("company_display_name"), F.lit("Unknown")).alias("company_name"),
        F.col("title").alias("title"),
        T.plain_text(F.coalesce(F.col("description"), F.lit(""))).alias("description"),
        F.col("location_display_name").alias("location_raw"),
        T.iso_country(F.get(area, 0), ADZUNA_COUNTRIES).alias("country"),
        F.get(area, 1).alias("city"),
        F.lit(None).cast("boolean").alias("is_remote"),
        T.lookup(F.lower(contract), ADZUNA_CONTRACTS).alias("contract_type"),
        pay["salary_min"].alias("salary_min"),
        pay["salary_max"].alias("salary_max"),
        F.lit(None).cast("string").alias("salary_currency"),
        F.when(any_pay, "year").alias("salary_period"),
        F.coalesce(F.col("salary_is_predicted") == "1", F.lit(False)).alias("salary_is_predicted"),
        T.iso_time(F.col("created")).alias("posted_at"),
        F.col("redirect_url").alias("url"),
        F.when(F.col("title").isNull(), "missing title").alias("reason"),
    )


def remoteok(raw: DataFrame) -> DataFrame:
    raw = _fields(raw, ["position", "title", "company", "description", "location", "date", "url", "apply_url"], values=["salary_min", "salary_max", "epoch"])
    title = T.clean(F.coalesce(F.col("position"), F.col("title")))
    company = T.clean(F.col("company"))
    low, high = T.number(F.col("salary_min")), T.number(F.col("salary_max"))
    any_pay = F.coalesce(low, high).isNotNull()
    return raw.select(
        "raw_job_id",
        "source",
        company.alias("company_name"),
        title.alias("title"),
        T.plain_text(F.coalesce(F.col("description"), F.lit(""))).alias("description"),
        T.clean(F.col("location")).alias("location_raw"),
        F.lit(None).cast("string").alias("country"),
        F.lit(None).cast("string").alias("city"),
        F.lit(True).alias("is_remote"),
        F.lit(None).cast("string").alias("contract_type"),
        F.coalesce(low, high).alias("salary_min"),
        F.coalesce(high, low).alias("salary_max"),
        F.when(any_pay, "USD").alias("salary_currency"),
        F.when(any_pay, "year").alias("salary_period"),
        F.lit(False).alias("salary_is_predicted"),
        F.coalesce(T.epoch_time(F.col("epoch")), T.iso_time(F.col("date"))).alias("posted_at"),
        F.coalesce(F.col("url"), F.col("apply_url")).alias("url"),
        F.when(title.isNull(), "missing title").when(company.isNull(), "missing company").alias("reason"),
    )


def jooble(raw: DataFrame) -> DataFrame:
    raw = _fields(raw, ["company", "title", "snippet", "location", "type", "updated", "link", "salary"])
    place = split_location(F.col("location"))
    pay = T.salary_text(F.col("salary"))
    return raw.select(
        "raw_job_id",
        "source",
        F.coalesce(F.col("company"), F.lit("Unknown")).alias("company_name"),
        F.col("title").alias("title"),
        T.plain_text(F.coalesce(F.col("snippet"), F.lit(""))).alias("description"),
        F.col("location").alias("location_raw"),
        T.iso_country(place["country"], JOOBLE_COUNTRIES).alias("country"),
        place["city"].alias("city"),
        F.lit(None).cast("boolean").alias("is_remote"),
        T.lookup(F.lower(F.col("type")), JOOBLE_CONTRACTS).alias("contract_type"),
        *[v.alias(k) for k, v in pay.items()],
        F.lit(False).alias("salary_is_predicted"),
        T.iso_time(F.col("updated")).alias("posted_at"),
        F.col("link").alias("url"),
        F.when(F.col("title").isNull(), "missing title").alias("reason"),
    )


def split_location(x: Column) -> dict[str, Column]:
    """Of the parts between commas the last is the country, and the first the city if there are two."""
    parts = F.filter(F.transform(F.split(x, ","), lambda p: F.trim(p)), lambda p: p != "")
    return {"country": F.try_element_at(parts, F.lit(-1)), "city": F.when(F.size(parts) > 1, F.get(parts, 0))}


PARSERS = {"adzuna": adzuna, "remoteok": remoteok, "jooble": jooble}


def parse(raw: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``(parsed, rejects)`` of raw rows of all boards: a row that fails never stops the others."""
    tried = None
    for source, parser in PARSERS.items():
        rows = parser(raw.where(F.col("source") == source))
        tried = rows if tried is None else tried.unionByName(rows)
    assert tried is not None
    return tried.where("reason is null").select(*PARSED), tried.where("reason is not null").select("raw_job_id", "source", "reason")


def parse_summary(parsed: DataFrame, rejects: DataFrame) -> DataFrame:
    """``parsed_count`` and ``failed_count`` of each source."""
    both = parsed.select("source", F.lit(1).alias("ok")).union(rejects.select("source", F.lit(0)))
    return both.groupBy("source").agg(
        F.count_if(F.col("ok") == 1).alias("parsed_count"), F.count_if(F.col("ok") == 0).alias("failed_count")
    )
