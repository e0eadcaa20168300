"""Queries over texts, vectors and questions, with their SQL where it can express them."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from postwright.functions import text as T
from postwright.functions.session import cut_off
from postwright.operators import analytics as A
from postwright.operators import attributes, audit, curation, enrich, evaluation, guards, matching, ontology, parse, questions, resumes, skillmatch
from postwright.operators import vectors as V
from postwright.plans import roles as R
from postwright.sources import boards, exports

QUERIES, SQL = {}, {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql is not None:
            SQL[name] = sql
        return f

    return add


#: A small ontology of words that the given texts use.
WORDS = [
    ("Tion", "language", ["the tion", "tion"], None),
    ("Edges", "framework", ["edges", "eding the"], "Tion"),
    ("Andor", "database", ["andor", "of and", "and of the"], None),
    ("Onthe", "cloud", ["onthe"], "Edges"),
    ("Der und", "soft", ["der und", "und der"], None),
    ("De la", "other", ["de la", "de la de"], None),
    ("Que el", "data", ["que el", "el que"], None),
    ("Rest in", "ml_ai", ["rest in", "in rest"], "Andor"),
]
_SKILLS = "canonical string, category string, aliases array<string>, parent string"


def words(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(WORDS, _SKILLS)


def _aliases() -> str:
    rows = [(c, a.lower(), k) for c, _, aliases, _ in WORDS for k, a in enumerate([c, *aliases])]
    return "(VALUES " + ", ".join(f"('{c}', '{a}', {k})" for c, a, k in rows) + ") a(canonical, alias, ord)"


# Blanks are what separates the words of an alias, letters and digits what must not touch it.
_HITS = f"""t AS (SELECT doc_id, regexp_replace(strip_accents(lower(text)), '[^\\P{{L}}\\x00-\\x7F]', '_', 'g') AS t FROM documents),
h AS (SELECT doc_id, canonical, alias, ord, (regexp_extract_all(' ' || t || ' ', '[^a-z0-9_]' || replace(alias, ' ', '\\s+') || '[^a-z0-9_]'))[1] AS hit, t FROM t, {_aliases()}),
f AS (SELECT doc_id, canonical, alias, ord, instr(' ' || t || ' ', hit) - 1 AS start, length(hit) - 2 AS size FROM h WHERE hit IS NOT NULL)"""


@query("dictionary_match", f"""WITH {_HITS} SELECT doc_id, canonical, alias, start, start + size AS "end" FROM f QUALIFY row_number() OVER (PARTITION BY doc_id, canonical ORDER BY ord, start) = 1""")
def dictionary_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = skillmatch.matches(R.table(spark, sf_dir, "documents"), words(spark))
    return m.select("doc_id", "canonical", F.lower("alias").alias("alias"), F.col("start").cast("long"), F.col("end").cast("long"))


@query("dictionary_match_all")
def dictionary_match_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hits with their evidence."""
    return skillmatch.matches(R.table(spark, sf_dir, "documents"), words(spark))


@query("posting_matches", f"""WITH {R.POSTINGS_SQL}, p AS (SELECT job_id AS doc_id, title || chr(10) || chr(10) || description AS text, length(title) AS cut FROM postings), {_HITS.replace("FROM documents", "FROM p")},
m AS (SELECT f.*, p.cut, p.text FROM f JOIN p USING (doc_id) QUALIFY row_number() OVER (PARTITION BY doc_id, canonical ORDER BY ord, start) = 1),
x AS (SELECT *, CASE WHEN start + size <= cut THEN 'title' WHEN start >= cut + 2 THEN 'description' END AS evidence_field FROM m)
SELECT doc_id AS job_id, canonical, alias, evidence_field, start - CASE evidence_field WHEN 'title' THEN 0 ELSE cut + 2 END AS start, start + size - CASE evidence_field WHEN 'title' THEN 0 ELSE cut + 2 END AS "end", substr(text, start + 1, size) AS evidence
FROM x WHERE doc_id NOT IN (SELECT doc_id FROM x WHERE evidence_field IS NULL)""")
def posting_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = skillmatch.posting_matches(R.postings(spark, sf_dir), words(spark))[0]
    return found.select("job_id", "canonical", F.lower("alias").alias("alias"), "evidence_field", F.col("start").cast("long"), F.col("end").cast("long"), "evidence")


# Every third title ends with the first word of a skill and its description begins with the second; the next one's title has both.
@query("match_failures", "SELECT doc_id AS job_id, 'match' AS stage, 'evidence crosses title and description' AS error FROM documents WHERE doc_id % 3 = 0")
def match_failures(spark: SparkSession, sf_dir: str) -> DataFrame:
    skills = spark.createDataFrame([("Edge Case", "domain", [], None)], _SKILLS)
    k = F.col("job_id") % 3
    title = F.concat(F.coalesce("title", F.lit("")), F.when(k == 0, " edge").when(k == 1, " Edge  case").otherwise(" hedge"))
    description = F.concat(F.when(k == 2, "case ").otherwise("Case "), F.coalesce("description", F.lit("")))
    return skillmatch.posting_matches(R.postings(spark, sf_dir).withColumns({"title": title, "description": description}), skills)[1]


@query("matcher_ledger")
def matcher_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    jobs = R.postings(spark, sf_dir)
    found, failed = skillmatch.posting_matches(jobs, words(spark))
    return enrich.ledger(1, jobs, found, failed)


@query("evidence_integrity", f"""WITH {R.POSTINGS_SQL}, e AS (SELECT job_id, CASE job_id % 5 WHEN 0 THEN 'title' WHEN 4 THEN 'body' ELSE 'description' END AS evidence_field, job_id % 3 - 1 AS start, job_id % 3 + 9 AS stop,
  CASE WHEN job_id % 2 = 0 THEN substr(description, CAST(job_id % 3 AS INTEGER), 10) ELSE 'other' END AS evidence, title, description FROM postings),
c AS (SELECT *, CASE evidence_field WHEN 'title' THEN title WHEN 'description' THEN description END AS field FROM e),
v AS (SELECT job_id AS row_id, CASE WHEN evidence_field = 'body' THEN 'invalid_evidence_field' WHEN start < 0 THEN 'invalid_offsets' WHEN stop > length(field) THEN 'offset_out_of_range' END AS first_,
  CASE WHEN evidence_field <> 'body' AND start >= 0 AND stop <= length(field) AND substr(field, CAST(start + 1 AS INTEGER), 10) IS DISTINCT FROM evidence THEN 'evidence_text_mismatch' END AS second_,
  CASE WHEN evidence_field <> 'body' AND start >= 0 AND stop <= length(field) AND lower(regexp_replace(evidence, '\\s+', ' ', 'g')) <> 'other' THEN 'matched_alias_mismatch' END AS third_ FROM c)
SELECT row_id, violation FROM (SELECT row_id, first_ AS violation FROM v UNION ALL SELECT row_id, second_ FROM v UNION ALL SELECT row_id, third_ FROM v) WHERE violation IS NOT NULL""")
def evidence_integrity(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = R.postings(spark, sf_dir)
    found = p.selectExpr(
        "job_id AS row_id", "1 AS run_id", "job_id", "'s' AS skill", "'matcher' AS method", "'other' AS alias",
        "CASE job_id % 5 WHEN 0 THEN 'title' WHEN 4 THEN 'body' ELSE 'description' END AS evidence_field", "job_id % 3 - 1 AS start", "job_id % 3 + 9 AS end",
        "CASE WHEN job_id % 2 = 0 THEN CASE WHEN job_id % 3 = 0 THEN substring(description, 1, 9) ELSE substring(description, int(job_id % 3), 10) END ELSE 'other' END AS evidence",
    )
    return audit.evidence_violations(found, p.select("job_id", "title", "description"), spark.range(1).selectExpr("'s' AS skill"))


@query("ambiguous_review")
def ambiguous_review(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = R.table(spark, sf_dir, "documents")
    short = spark.createDataFrame([("In", "other", ["in", "is"], None), ("Le", "other", ["le", "la"], None)], _SKILLS)
    found = skillmatch.matches(docs, short).withColumnRenamed("doc_id", "job_id")
    return audit.ambiguous_review(found, docs.select(F.col("doc_id").alias("job_id"), "text"))


@query("excerpts", "SELECT doc_id, substr(trim(regexp_replace(text, '\\s+', ' ', 'g')), 1, 320) AS excerpt FROM documents")
def excerpts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.table(spark, sf_dir, "documents").select("doc_id", audit.excerpt(F.col("text")).alias("excerpt"))


@query("alias_conflicts", """WITH i AS (SELECT p_type AS canonical, lower(p_name) AS folded FROM part) SELECT folded, count(DISTINCT canonical) AS claims, list_aggregate(list_sort(list_distinct(list(canonical))), 'string_agg', ',') AS canonicals FROM i GROUP BY folded HAVING count(DISTINCT canonical) > 1""")
def alias_conflicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = R.table(spark, sf_dir, "part").select(F.col("p_type").alias("canonical"), F.array("p_name").alias("aliases"))
    i = ontology.alias_index(p).where("alias_ord > 0")
    return ontology.alias_conflicts(i).withColumn("canonicals", F.array_join("canonicals", ","))


@query("ontology_violations", """WITH s AS (SELECT p_name AS canonical, p_type AS category, CASE WHEN p_partkey % 3 = 0 THEN p_brand END AS parent FROM part)
SELECT canonical, 'duplicate' AS problem FROM s GROUP BY canonical HAVING count(*) > 1 UNION ALL SELECT canonical, 'unknown_category' FROM s WHERE category NOT IN ('ECONOMY', 'SMALL')
UNION ALL SELECT canonical, 'unknown_parent' FROM s WHERE parent IS NOT NULL AND parent NOT IN (SELECT canonical FROM s)""")
def ontology_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = R.table(spark, sf_dir, "part").selectExpr("p_name AS canonical", "p_type AS category", "CASE WHEN p_partkey % 3 = 0 THEN p_brand END AS parent")
    return ontology.violations(s, ["ECONOMY", "SMALL"])


@query("alias_resolution", """SELECT e.event_id, p.p_type AS canonical FROM events e LEFT JOIN (SELECT DISTINCT lower(event_type) AS f, CASE WHEN event_type IN ('view', 'click') THEN 'Interest' ELSE 'Action' END AS p_type FROM events WHERE event_type <> 'error') p ON lower(trim(e.event_type)) = p.f""")
def alias_resolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = R.table(spark, sf_dir, "events")
    s = e.where("event_type <> 'error'").select(F.when(F.col("event_type").isin("view", "click"), "Interest").otherwise("Action").alias("canonical"), F.upper("event_type").alias("a")).groupBy("canonical").agg(F.collect_set("a").alias("aliases"))
    raw = e.select("event_id", F.concat(F.lit(" "), F.initcap("event_type"), F.lit(" ")).alias("raw"))
    return ontology.resolve(raw, "raw", ontology.alias_index(s)).select("event_id", "canonical")


@query("ontology_version")
def ontology_version(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = R.table(spark, sf_dir, "part").groupBy(F.col("p_name").alias("canonical")).agg(F.min("p_type").alias("category"), F.collect_set("p_brand").alias("aliases"))
    return ontology.version(p.withColumn("parent", F.lit(None).cast("string")))


@query("ontology_sync", """WITH a AS (SELECT p_partkey AS k, p_name || ' ' || p_partkey AS canonical, p_type AS category FROM part WHERE p_partkey % 5 <> 0), b AS (SELECT p_name || ' ' || p_partkey AS canonical, CASE WHEN p_partkey % 7 = 0 THEN 'old' ELSE p_type END AS category FROM part WHERE p_partkey % 3 <> 0)
SELECT coalesce(a.canonical, b.canonical) AS canonical, CASE WHEN b.canonical IS NULL THEN 'insert' WHEN a.canonical IS NULL THEN 'extra' WHEN a.category <> b.category THEN 'update' ELSE 'keep' END AS action FROM a FULL JOIN b ON a.canonical = b.canonical""")
def ontology_sync(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = R.table(spark, sf_dir, "part").selectExpr("p_partkey AS k", "p_name || ' ' || p_partkey AS canonical", "p_type AS category", "cast(null AS string) AS parent")
    old = p.where("k % 3 <> 0").withColumn("category", F.when(F.col("k") % 7 == 0, "old").otherwise(F.col("category")))
    return ontology.sync_plan(p.where("k % 5 <> 0"), old)


@query("ontology_out_of_sync", """SELECT p_name || ' ' || p_partkey AS canonical, CASE WHEN p_partkey % 3 = 0 THEN 'ontology' ELSE 'table' END AS side FROM part WHERE (p_partkey % 5 <> 0) <> (p_partkey % 3 <> 0)""")
def ontology_out_of_sync(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = R.table(spark, sf_dir, "part").selectExpr("p_partkey AS k", "p_name || ' ' || p_partkey AS canonical")
    return enrich.out_of_sync(p.where("k % 5 <> 0"), p.where("k % 3 <> 0"))


@query("skill_parents", """SELECT a.p_partkey AS skill_id, coalesce(b.p_partkey, -1) AS parent_id FROM part a LEFT JOIN part b ON b.p_partkey = CASE WHEN a.p_partkey % 4 = 0 THEN a.p_partkey // 2 END""")
def skill_parents(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = R.table(spark, sf_dir, "part").selectExpr("p_partkey AS skill_id", "cast(p_partkey AS string) AS canonical", "CASE WHEN p_partkey % 4 = 0 THEN cast(p_partkey div 2 AS string) END AS parent")
    return ontology.with_parent_ids(p).select("skill_id", F.coalesce("parent_id", F.lit(-1)).alias("parent_id"))


@query("skill_buckets", """WITH b AS (SELECT DISTINCT l_suppkey AS profile_id, p_brand AS canonical, CASE CAST(substr(p_brand, 7) AS INTEGER) % 5 WHEN 0 THEN 'language' WHEN 1 THEN 'database' WHEN 2 THEN 'framework' WHEN 3 THEN 'cloud' ELSE 'soft' END AS category FROM lineitem JOIN part ON l_partkey = p_partkey)
SELECT profile_id, string_agg(canonical, ',' ORDER BY canonical) FILTER (WHERE category = 'language') AS language, string_agg(canonical, ',' ORDER BY canonical) FILTER (WHERE category = 'database') AS database,
 string_agg(canonical, ',' ORDER BY canonical) FILTER (WHERE category = 'framework') AS framework, string_agg(canonical, ',' ORDER BY canonical) FILTER (WHERE category = 'cloud') AS cloud FROM b GROUP BY profile_id""")
def skill_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    li, p = R.table(spark, sf_dir, "lineitem"), R.table(spark, sf_dir, "part")
    kind = F.element_at(F.array(*[F.lit(x) for x in ("language", "database", "framework", "cloud", "soft")]), (F.substring("p_brand", 7, 3).cast("int") % 5 + 1))
    s = p.select(F.col("p_brand").alias("canonical"), kind.alias("category")).distinct()
    ps = li.join(p, li.l_partkey == p.p_partkey).select(F.col("l_suppkey").alias("profile_id"), F.col("p_brand").alias("canonical")).distinct()
    b = ontology.buckets(ps, s)
    return b.select("profile_id", *[F.nullif(F.array_join(c, ","), F.lit("")).alias(c) for c in ontology.BUCKETS])


@query("html_to_text")
def html_to_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages; SQL can't resolve their entities, so a test holds fixed pages against Python's ``html.unescape``."""
    return R.table(spark, sf_dir, "pages").select("page_id", T.plain_text(F.col("html")).alias("text"))


@query("html_to_text_all")
def html_to_text_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.table(spark, sf_dir, "pages").select("page_id", T.plain_text(F.col("html")).alias("text"))


@query("mojibake")
def mojibake(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text read once more as Latin-1 where that can be, and mended."""
    d = R.table(spark, sf_dir, "documents")
    broken = F.decode(F.encode("text", "UTF-8"), "ISO-8859-1")
    return d.select("doc_id", F.md5(T.mend_mojibake(broken).cast("binary")).alias("mended_md5"), (T.mend_mojibake(F.col("text")) == F.col("text")).alias("untouched"))


SQL["mojibake"] = "SELECT doc_id, md5(text) AS mended_md5, true AS untouched FROM documents"


@query("board_payloads")
def board_payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents wrapped as payloads of three boards, parsed again."""
    return parse.parse(_payloads(spark, sf_dir))[0]


def _payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = R.postings(spark, sf_dir)
    k = F.col("job_id") % 3
    adzuna = F.to_json(F.struct(
        F.col("job_id").alias("id"), F.when(F.col("job_id") % 10 != 0, F.col("title")).alias("title"), F.col("description"),
        F.struct(F.col("source").alias("display_name")).alias("company"),
        F.struct(F.lit("Paris, France").alias("display_name"), F.array(F.lit("France"), F.lit("Paris")).alias("area")).alias("location"),
        (F.col("job_id") * 100).alias("salary_min"), F.lit("1").alias("salary_is_predicted"), F.lit("full_time").alias("contract_time"), F.lit("2024-03-01T10:00:00Z").alias("created")))
    remote = F.to_json(F.struct(F.col("job_id").alias("id"), F.col("title").alias("position"), F.col("source").alias("company"), F.col("description"), F.lit("80,000").alias("salary_min"), F.lit("1710000000").alias("epoch")))
    jooble = F.to_json(F.struct(F.col("title"), F.col("source").alias("company"), F.lit("Berlin, Germany").alias("location"), F.col("description").alias("snippet"), F.lit("€70,000 - €90,000").alias("salary"), F.lit("Full-time").alias("type"), F.lit("2024-03-01T10:00:00").alias("updated"), F.concat(F.lit("http://x/"), F.col("job_id")).alias("link")))
    return d.select(
        F.col("job_id").alias("raw_job_id"), F.when(k == 0, "adzuna").when(k == 1, "remoteok").otherwise("jooble").alias("source"), F.col("job_id").cast("string").alias("source_id"),
        F.when(k == 0, adzuna).when(k == 1, remote).otherwise(jooble).alias("payload"),
    )


@query("parse_summary", f"""WITH {R.POSTINGS_SQL}, p AS (SELECT CASE job_id % 3 WHEN 0 THEN 'adzuna' WHEN 1 THEN 'remoteok' ELSE 'jooble' END AS source, trim(title) <> '' AND (job_id % 3 <> 0 OR job_id % 10 <> 0) AS ok FROM postings)
SELECT source, count(*) FILTER (WHERE ok) AS parsed_count, count(*) FILTER (WHERE NOT ok) AS failed_count FROM p GROUP BY source""")
def parse_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parse.parse_summary(*parse.parse(_payloads(spark, sf_dir)))


@query("parsed_values", f"""WITH {R.POSTINGS_SQL} SELECT job_id AS raw_job_id, CASE job_id % 3 WHEN 0 THEN 'fr' WHEN 2 THEN 'de' END AS country, CASE job_id % 3 WHEN 0 THEN 'Paris' WHEN 2 THEN 'Berlin' END AS city,
  CASE job_id % 3 WHEN 0 THEN job_id * 100.0 WHEN 1 THEN 80000.0 ELSE 70000.0 END AS salary_min, CASE job_id % 3 WHEN 0 THEN job_id * 100.0 WHEN 1 THEN 80000.0 ELSE 90000.0 END AS salary_max,
  CASE job_id % 3 WHEN 1 THEN 'USD' WHEN 2 THEN 'EUR' END AS salary_currency, CASE WHEN job_id % 3 <> 1 THEN 'full_time' END AS contract_type, job_id % 3 = 0 AS salary_is_predicted,
  CASE WHEN job_id % 3 = 1 THEN TIMESTAMP '2024-03-09 16:00:00' ELSE TIMESTAMP '2024-03-01 10:00:00' END AS posted_at
FROM postings WHERE trim(title) <> '' AND (job_id % 3 <> 0 OR job_id % 10 <> 0)""")
def parsed_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = parse.parse(_payloads(spark, sf_dir))[0]
    return p.select("raw_job_id", "country", "city", "salary_min", "salary_max", "salary_currency", "contract_type", "salary_is_predicted", F.col("posted_at").cast("timestamp_ntz").alias("posted_at"))


@query("board_pages", """SELECT source, source_id FROM (SELECT 'adzuna' AS source, CAST(user_id AS VARCHAR) AS source_id, event_id FROM events UNION ALL SELECT 'jooble', sha256('http://x/' || event_id), event_id FROM events)""")
def board_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = R.table(spark, sf_dir, "events")
    a = e.select(F.to_json(F.struct(F.array(F.struct(F.col("user_id").alias("id")), F.struct(F.lit(None).cast("long").alias("id"))).alias("results"))).alias("page"))
    j = e.select(F.to_json(F.struct(F.array(F.struct(F.lit(" ").alias("id"), F.concat(F.lit(" http://x/"), F.col("event_id")).alias("link")), F.struct(F.lit("").alias("id"), F.lit(" ").alias("link"))).alias("jobs"))).alias("page"))
    return boards.adzuna_rows(a).union(boards.jooble_rows(j)[0]).select("source", "source_id")


@query("report_json", """SELECT '{"n":' || count(*) || ',"source":"' || source || '"}' AS report FROM documents GROUP BY source""")
def report_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exports.report_json(R.table(spark, sf_dir, "documents").groupBy("source").agg(F.count("*").alias("n")))


_UNIT = "list_transform(embedding, lambda x: CAST(x AS DOUBLE) / sqrt(list_sum(list_transform(embedding, lambda y: CAST(y AS DOUBLE) * y))))"


@query("vector_norms", "SELECT vec_id, len(embedding) = 64 AS valid, round(sqrt(list_sum(list_transform(embedding, lambda y: CAST(y AS DOUBLE) * y))), 4) AS norm FROM embeddings")
def vector_norms(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = R.table(spark, sf_dir, "embeddings")
    return e.select("vec_id", V.is_valid(F.col("embedding"), 64).alias("valid"), F.round(V.norm(F.col("embedding")), 4).alias("norm"))


@query("knn_exact", """WITH q AS (SELECT vec_id AS query_id, embedding AS q FROM embeddings WHERE vec_id % 100 = 0),
s AS (SELECT query_id, vec_id, list_cosine_similarity(CAST(q AS DOUBLE[]), CAST(embedding AS DOUBLE[])) AS c FROM q, embeddings), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(c, 12) DESC, vec_id) AS rank FROM s)
SELECT query_id, vec_id, round(greatest(0, least(1, c)), 5) AS score, rank FROM r WHERE rank <= 10""")
def knn_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Queries are the rows whose id is divisible by 100, against all rows."""
    e = R.table(spark, sf_dir, "embeddings")
    q = e.where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), "embedding")
    return V.nearest(q, e, 10).withColumn("score", F.round("score", 5))


@query("knn_approximate")
def knn_approximate(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = R.table(spark, sf_dir, "embeddings")
    q = e.where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), "embedding")
    # these vectors lie in all directions alike: a query's neighbours are spread over many cells
    return V.approximate_nearest(q, e, 10, probes=0.65)


@query("pending_vectors", f"""WITH {R.JOBS_SQL}, {R.JOB_SKILLS_SQL}, {R.LEDGER_SQL} SELECT l.job_id FROM ledger l LEFT JOIN embeddings e ON l.job_id = e.vec_id WHERE l.status = 'success' AND (e.vec_id IS NULL OR e.label <> 3)""")
def pending_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = R.table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("job_id"), F.lit("m").alias("model"), F.col("label").cast("string").alias("version"), "embedding")
    return V.pending(R.ledger(spark, sf_dir), v, "m", "3")


@query("job_texts")
def job_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _texts(spark, sf_dir)


def _texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = R.postings(spark, sf_dir)
    none = F.expr("cast(array() as array<string>)")
    t = V.job_text(F.col("title"), F.lit("unknown"), F.array("source"), none, F.lit(None).cast("string"), F.lit(None).cast("string"), F.col("description"))
    return p.select("job_id", t.alias("text"))


@query("encoded_texts")
def encoded_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.encode(_texts(spark, sf_dir), V.hashed_words).select("job_id", F.round(V.norm(F.col("embedding")), 3).alias("norm"), "error")


@query("job_attributes")
def job_attributes(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = R.jobs(spark, sf_dir)
    none = F.expr("cast(array() as array<string>)")
    a = attributes.job_attributes(F.col("title"), F.concat(F.lit("We ask for 3 to 5 years, remote. "), F.col("contract_type")), F.col("contract_type"), F.lit(None).cast("boolean"), F.col("country"), F.lit(None).cast("string"), none)
    return p.select("job_id", a.alias("a")).select("job_id", "a.*")


@query("job_levels", f"""WITH {R.JOBS_SQL} SELECT job_id, CASE substr(contract_type, 1, 1) WHEN '1' THEN 'senior' WHEN '2' THEN 'junior' WHEN '3' THEN 'lead' WHEN '4' THEN 'consultant' ELSE 'internship' END AS career_level,
  2.5 AS low, 4.0 AS high, CASE substr(contract_type, 1, 1) WHEN '5' THEN 'Backend,Cloud' WHEN '1' THEN 'Cloud,Data Engineering' WHEN '2' THEN 'Cloud,Data Science' WHEN '3' THEN 'Cloud,Software Engineering' ELSE 'Cloud' END AS domains, 'hybrid' AS remote_mode FROM jobs""")
def job_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = R.jobs(spark, sf_dir)
    none = F.expr("cast(array() as array<string>)")
    a = attributes.job_attributes(F.col("title"), F.lit("From 2,5 to 4 years on AWS, hybride or télétravail."), F.lit(None).cast("string"), F.lit(None).cast("boolean"), F.col("country"), F.lit(None).cast("string"), none)
    return p.select("job_id", a.alias("a")).select("job_id", "a.career_level", F.col("a.experience_min_years").alias("low"), F.col("a.experience_max_years").alias("high"), F.array_join("a.domains", ",").alias("domains"), "a.remote_mode")


@query("stale_jobs", f"""WITH {R.JOBS_SQL} SELECT job_id, CAST(floor(epoch(TIMESTAMP '2000-01-01 12:00:00' - posted_at) / 86400) AS BIGINT) AS days, floor(epoch(TIMESTAMP '2000-01-01 12:00:00' - posted_at) / 86400) >= 120 AS stale FROM jobs""")
def stale_jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    at, posted = F.lit("2000-01-01 12:00:00").cast("timestamp"), F.col("posted_at").cast("timestamp")
    return R.jobs(spark, sf_dir).select("job_id", attributes.elapsed_days(posted, at).alias("days"), attributes.is_stale(posted, at).alias("stale"))


@query("job_cards", f"""WITH {R.JOBS_SQL} SELECT job_id, title, company_name AS company, coalesce(upper(country), 'not given') AS location, 'not given' AS remote FROM jobs""")
def job_cards(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = attributes.job_card(F.col("title"), F.col("company_name"), F.lit(None).cast("string"), F.col("country"), F.col("salary_min"), F.col("salary_max"), F.col("salary_currency"), F.col("salary_period"), F.lit(None).cast("boolean"))
    return R.jobs(spark, sf_dir).select("job_id", c.alias("c")).select("job_id", "c.title", "c.company", "c.location", "c.remote")


@query("hit_details")
def hit_details(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = R.table(spark, sf_dir, "embeddings")
    q = e.where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), "embedding")
    hits = V.nearest(q, e, 5).withColumnRenamed("vec_id", "job_id")
    js = R.job_skills(spark, sf_dir).select("job_id", F.col("skill_id").cast("string").alias("skill"))
    return matching.hit_details(hits, R.postings(spark, sf_dir).select("job_id", "title", "description"), js)


@query("question_routes")
def question_routes(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = R.table(spark, sf_dir, "conversations").where("role = 'user'")
    asked = F.concat(F.get(F.array(*[F.lit(x) for x in ("How many jobs: ", "What is the average salary, ", "Most common skills? ", "Upload my cv: ", "")]), ((F.col("conv_id") + F.col("turn")) % 5).cast("int")), F.col("text"))
    return c.select("conv_id", "turn", guards.route(asked).alias("route"), guards.topic(asked).alias("topic"), guards.intent(asked, F.lit(None).cast("string")).alias("intent"))


def _apart(pattern: str) -> str:
    """A pattern's word boundaries as what Java takes them for: no letter, digit or underscore beside."""
    return re.sub(r"\\b", r"(?:$|[^\\p{L}\\p{Nd}_])", re.sub(r"\\b(?=[\w(])", r"(?:^|[^\\p{L}\\p{Nd}_])", pattern))


_PHRASES = ", ".join(f"({k}, '{t}', '{w}')" for k, (t, words) in enumerate(guards.TOPICS.items()) for w in words)

# Texts may name topics and figures as well as the openings do.
SQL["question_routes"] = f"""WITH c AS (SELECT row_number() OVER () AS id, conv_id, turn, lower(['How many jobs: ', 'What is the average salary, ', 'Most common skills? ', 'Upload my cv: ', ''][(conv_id + turn) % 5 + 1] || text) AS q FROM conversations WHERE role = 'user'),
n AS (SELECT id, k, topic, count(*) AS n FROM c JOIN (VALUES {_PHRASES}) p(k, topic, phrase) ON contains(q, phrase) GROUP BY ALL),
t AS (SELECT id, topic FROM n QUALIFY row_number() OVER (PARTITION BY id ORDER BY n DESC, k) = 1)
SELECT conv_id, turn, CASE WHEN topic IS NOT NULL THEN 'platform' WHEN regexp_matches(q, '{_apart("|".join(guards.ANALYTICAL))}') THEN 'sql' ELSE 'unresolved' END AS route, topic,
  CASE WHEN regexp_matches(q, '{_apart(guards.SALARY_WORDS)}') THEN 'avg_salary' WHEN regexp_matches(q, '{_apart(guards.TOP_WORDS)}') THEN 'top_skills' ELSE 'job_count' END AS intent
FROM c LEFT JOIN t USING (id)"""


#: Openings of questions, one for each turn in turn; what they name is told again in the SQL's own words.
OPENINGS = [
    "How many senior data scientist jobs in France? ", "Average salary in the United Kingdom, freelance: ", "country=IT, it works? ", "junior ML Engineer or intern, full time ",
    "Part-time in Pays-Bas, head of data; contractor ", "Straße in Deutschland, debutant: the  tion ", "", "Is it de or fr? Chef de projet, product manager. ", "British or spanish CDI, alternance ", "sr. software engineers (permanent) in holland ",
]


def asked(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = R.table(spark, sf_dir, "conversations").where("role = 'user'")
    opening = F.element_at(F.array(*[F.lit(x) for x in OPENINGS]), ((F.col("conv_id") + F.col("turn")) % len(OPENINGS) + 1).cast("int"))
    return c.select("conv_id", "turn", F.concat(opening, F.col("text")).alias("question"))


#: The ontology of questions: one name has a letter that stands for two.
ASKED_WORDS = [*WORDS, ("Straße", "domain", ["strasse"], None)]


def _cases(pairs: list[tuple[str, str]]) -> str:
    """The value of the first name that stands in ``q`` with no letter, digit or underscore beside it."""
    return "CASE " + " ".join(f"WHEN regexp_matches(q, '(^|[^\\p{{L}}\\p{{N}}_])({name})($|[^\\p{{L}}\\p{{N}}_])') THEN '{value}'" for name, value in pairs) + " END"


# The longest names first, as the SQL reads them in order.
_SQL_COUNTRIES = [
    ("united kingdom", "gb"), ("deutschland|netherlands", "_"), ("allemagne", "de"), ("angleterre", "gb"), ("pays-bas|pays bas", "nl"), ("français|francais", "fr"), ("germany", "de"), ("spanish|espagne", "es"),
    ("britain|british|england", "gb"), ("italian", "it"), ("holland", "nl"), ("france|french", "fr"), ("german", "de"), ("españa", "es"), ("italie", "it"), ("spain", "es"), ("italy", "it"), ("dutch", "nl"),
]
_SQL_CONTRACTS = [("contractor", "contract"), ("permanent", "full_time"), ("freelance", "contract"), ("full_time|full-time|full time|part_time|part-time|part time", "_"), ("temporary", "contract"), ("contract", "contract"), ("cdi", "full_time"), ("cdd", "contract")]
_SQL_LEVELS = [("junior|debutant", "junior"), ("senior|sr|confirme|experimente", "senior")]

SQL["question_entities"] = f"""WITH RECURSIVE o AS (SELECT conv_id, turn, [{", ".join("'" + x.replace("'", "''") + "'" for x in OPENINGS)}][(conv_id + turn) % {len(OPENINGS)} + 1] || text AS question FROM conversations WHERE role = 'user'),
n AS (SELECT *, lower(question) AS q FROM o),
w AS (SELECT conv_id, turn, regexp_extract_all(question, '[\\p{{L}}\\p{{N}}_+.#/-]+') AS w FROM n),
x AS (SELECT conv_id, turn, CAST(a AS BIGINT) AS start, CAST(s AS BIGINT) AS size, replace(strip_accents(lower(array_to_string(w[a + 1 : a + s], ' '))), 'ß', 'ss') AS phrase
  FROM w, range(0, len(w)) AS t(a), range(1, 5) AS u(s) WHERE a + s <= len(w)),
al AS (SELECT alias, min(canonical) AS canonical FROM (SELECT canonical, alias FROM {_aliases()} UNION SELECT 'Straße', 'strasse') GROUP BY alias),
h AS (SELECT conv_id, turn, start, size, canonical, row_number() OVER (PARTITION BY conv_id, turn ORDER BY size DESC, start) AS r FROM x JOIN al ON phrase = alias),
pick(conv_id, turn, r, got) AS (
  SELECT conv_id, turn, CAST(0 AS BIGINT), CAST([] AS STRUCT(start BIGINT, size BIGINT, canonical VARCHAR)[]) FROM n
  UNION ALL
  SELECT p.conv_id, p.turn, h.r, CASE WHEN len(got) < 3 AND len(list_filter(got, lambda g: (h.start < g.start + g.size AND g.start < h.start + h.size) OR g.canonical = h.canonical)) = 0
    THEN list_append(got, {{'start': h.start, 'size': h.size, 'canonical': h.canonical}}) ELSE got END
  FROM pick p JOIN h ON h.conv_id = p.conv_id AND h.turn = p.turn AND h.r = p.r + 1
), last AS (SELECT conv_id, turn, list_transform(arg_max(got, r), lambda g: g.canonical) AS skills FROM pick GROUP BY conv_id, turn)
SELECT n.conv_id, n.turn,
  coalesce(CASE {_cases(_SQL_COUNTRIES)} WHEN '_' THEN CASE WHEN q LIKE '%deutschland%' THEN 'de' ELSE 'nl' END ELSE {_cases(_SQL_COUNTRIES)} END,
    nullif(regexp_extract(q, '\\b(country|pays)\\s*(=|:|is|est)\\s*(fr|de|es|gb|it|nl)\\b', 3), '')) AS country,
  coalesce({_cases(_SQL_LEVELS)}, CASE WHEN regexp_matches(q, '(^|[^\\p{{L}}\\p{{N}}_])lead($|[^\\p{{L}}\\p{{N}}_])|tech lead|leader technique') THEN 'lead'
    WHEN regexp_matches(q, '(^|[^\\p{{L}}\\p{{N}}_])manager($|[^\\p{{L}}\\p{{N}}_])|responsable|head of|chef de projet') THEN 'manager'
    WHEN regexp_matches(q, '(^|[^\\p{{L}}\\p{{N}}_])stage($|[^\\p{{L}}\\p{{N}}_])|stagiaire|intern') THEN 'internship' WHEN regexp_matches(q, 'alternance|apprenti') THEN 'apprenticeship' END) AS seniority,
  CASE {_cases(_SQL_CONTRACTS)} WHEN '_' THEN CASE WHEN regexp_matches(q, 'full[_ -]time') THEN 'full_time' ELSE 'part_time' END ELSE {_cases(_SQL_CONTRACTS)} END AS contract_type,
  list_filter(['machine learning engineer', 'full stack developer', 'fullstack developer', 'solutions architect', 'software developer', 'frontend developer', 'software engineer', 'backend developer', 'frontend engineer',
    'security engineer', 'backend engineer', 'product manager', 'project manager', 'business analyst', 'devops engineer', 'data scientist', 'cloud engineer', 'data engineer', 'data architect', 'data analyst', 'ml engineer',
    'ai engineer', 'qa engineer'], lambda t: contains(q, t))[1] AS role_title, skills[1] AS skill, array_to_string(skills, '|') AS skills
FROM n JOIN last USING (conv_id, turn)"""


@query("question_entities")
def question_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = ontology.alias_index(spark.createDataFrame(ASKED_WORDS, _SKILLS))
    return questions.entities(asked(spark, sf_dir), index, "question").drop("question").withColumn("skills", F.array_join("skills", "|"))


#: Words with letters that stand for two, planted after a part of each text; what follows them is at an offset of the text, not of its folding.
@query("folded_match", """WITH t AS (SELECT doc_id, left(text, CAST(doc_id % 50 AS INTEGER)) || ' STRAßE mit ﬁnance; Python ' || substr(text, CAST(doc_id % 50 + 1 AS INTEGER)) AS t FROM documents WHERE text IS NOT NULL)
SELECT doc_id, 'Road' AS canonical, 'straße' AS alias, instr(t, 'STRAßE') - 1 AS start, instr(t, 'STRAßE') + 5 AS "end", 'STRAßE' AS evidence FROM t
UNION ALL SELECT doc_id, 'Finance', 'Finance', instr(t, 'ﬁnance') - 1, instr(t, 'ﬁnance') + 5, 'ﬁnance' FROM t UNION ALL SELECT doc_id, 'Python', 'Python', instr(t, '; Python ') + 1, instr(t, '; Python ') + 7, 'Python' FROM t""")
def folded_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    skills = spark.createDataFrame([("Road", "domain", ["straße"], None), ("Finance", "domain", [], None), ("Python", "language", [], None)], _SKILLS)
    at = (F.col("doc_id") % 50).cast("int")
    text = F.concat(F.left("text", at), F.lit(" STRAßE mit ﬁnance; Python "), F.substring("text", at + 1, F.char_length("text")))
    m = skillmatch.matches(R.table(spark, sf_dir, "documents").select("doc_id", text.alias("text")), skills)
    return m.select("doc_id", "canonical", "alias", F.col("start").cast("long"), F.col("end").cast("long"), "evidence")


@query("guarded_candidates", f"""WITH {_HITS}, m AS (SELECT * FROM f QUALIFY row_number() OVER (PARTITION BY doc_id, canonical ORDER BY ord, start) = 1)
SELECT doc_id, canonical, CASE (doc_id + length(canonical)) % 6 WHEN 0 THEN 'rejected_unsupported_fact_type' WHEN 1 THEN 'rejected_confidence' WHEN 2 THEN 'rejected_invalid_offset' WHEN 3 THEN 'rejected_no_evidence' ELSE 'accepted' END AS status FROM m""")
def guarded_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = R.table(spark, sf_dir, "documents")
    k = (F.col("doc_id") + F.char_length("canonical")) % 6
    c = skillmatch.matches(docs, words(spark)).select(
        F.xxhash64("doc_id", "canonical").alias("cand_id"), "doc_id", F.when(k == 0, "title").otherwise("skill").alias("fact_type"), F.when(k == 1, 1.5).otherwise(0.9).alias("confidence"), "canonical",
        F.lit(None).cast("long").alias("skill_id"), F.when(k == 2, -1).otherwise(F.col("start")).alias("start"), "end", F.when(k == 3, "§").otherwise(F.col("evidence")).alias("quote"), F.lit(1).alias("page"),
    )
    s = words(spark).select("canonical", F.xxhash64("canonical").alias("skill_id"))
    known = c.where("false").select("doc_id", "canonical")
    return guards.judged_candidates(c, docs.select("doc_id", "text", F.lit(1).alias("n_pages")), s, known).select("doc_id", "canonical", "status")


@query("rewrite_guard", """SELECT item_id, CASE item_id % 4 WHEN 0 THEN 'new_number' WHEN 1 THEN 'ungrounded_skill' WHEN 2 THEN 'other_employer' ELSE 'kept' END AS verdict FROM benchmark""")
def rewrite_guard(spark: SparkSession, sf_dir: str) -> DataFrame:
    b, k = R.table(spark, sf_dir, "benchmark"), F.col("item_id") % 4
    new = F.concat("text", F.when(k == 0, " 987654").when(k == 2, " at ACME Corp").otherwise(""))
    none = F.expr("cast(array() as array<string>)")
    v = guards.rewrite_verdict(F.col("text"), new, F.when(k == 1, F.array(F.lit("Python"))).otherwise(none), none, F.array(F.lit("SQL")), F.array(F.lit("Acme Corp")))
    return b.select("item_id", v.alias("verdict"))


@query("spelling_guard", """SELECT item_id, CASE item_id % 4 WHEN 0 THEN 'no_change' WHEN 1 THEN 'changed_number' WHEN 2 THEN 'rewrite' ELSE 'kept' END AS verdict FROM benchmark""")
def spelling_guard(spark: SparkSession, sf_dir: str) -> DataFrame:
    b, k = R.table(spark, sf_dir, "benchmark"), F.col("item_id") % 4
    new = F.when(k == 0, F.concat(F.lit("  "), "text")).when(k == 1, F.concat("text", F.lit(" 12"))).when(k == 2, F.concat_ws(" ", "text", "text")).otherwise(F.concat("text", F.lit("s")))
    none = F.expr("cast(array() as array<string>)")
    return b.select("item_id", guards.spelling_verdict(F.col("text"), new, none, none).alias("verdict"))


_SAMPLED = """k AS (SELECT doc_id, source, text, length(text) AS n, CASE WHEN doc_id % 17 = 0 THEN 'nl' WHEN doc_id % 19 = 0 THEN 'IT' ELSE lang END AS country, lower(split_part(text, chr(10), 1)) AS title FROM documents),
o AS (SELECT *, source = 'src0' AS own, coalesce(lower(country) IN ('nl', 'it'), false) AS special, coalesce(n >= 3000 OR source = 'src1' AND regexp_matches(strip_accents(title), 'developer|engineer|software|data|devops|cloud|security|backend|frontend|full stack|machine learning|ai|ml|python|java|platform|sre|architect|qa|analyst'), false) AS full_ FROM k)"""


def _sample_sql(size: int) -> str:
    """The strata one after the other, each from what is left."""
    target = round(size * 0.7)
    pick = lambda name, seed, where, quota: f"{name} AS (SELECT doc_id FROM (SELECT doc_id, row_number() OVER (ORDER BY sha256('{20260724 + seed}:' || doc_id), doc_id) AS r FROM o WHERE {where}) WHERE r <= {quota})"
    out = lambda *names: " ".join(f"AND doc_id NOT IN (SELECT doc_id FROM {n})" for n in names)
    n = lambda *names: " - ".join(["", *[f"(SELECT count(*) FROM {x})" for x in names]])
    q = f"q{size}_"
    a, b, c, d, e = (q + x for x in "abcde")
    return ", ".join([
        pick(a, 1, "own AND special", min(15, target)), pick(b, 2, "own AND NOT special", f"{target}{n(a)}"), pick(c, 5, f"own {out(a, b)}", f"{target}{n(a, b)}"),
        pick(d, 3, f"full_ {out(a, b, c)}", size - target), pick(e, 4, f"true {out(a, b, c, d)}", f"{size}{n(a, b, c, d)}"),
        f"{q}all AS (SELECT {size} AS size, doc_id AS job_id, 'truncated' AS stratum, 'nl_it_diagnostic' AS diagnostic_group FROM {a} UNION ALL SELECT {size}, doc_id, 'truncated', 'standard' FROM {b} UNION ALL SELECT {size}, doc_id, 'truncated', 'standard' FROM {c}"
        f" UNION ALL SELECT {size}, doc_id, 'full_text', 'standard' FROM {d} UNION ALL SELECT {size}, doc_id, 'fallback', 'standard' FROM {e})",
    ])


# Three sizes: quotas that are met, and two that run short in one stratum or more.
@query("stratified_sample", f"WITH {_SAMPLED}, {_sample_sql(60)}, {_sample_sql(400)}, {_sample_sql(900)} SELECT * FROM q60_all UNION ALL SELECT * FROM q400_all UNION ALL SELECT * FROM q900_all")
def stratified_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = R.postings(spark, sf_dir)
    country = F.when(F.col("job_id") % 17 == 0, "nl").when(F.col("job_id") % 19 == 0, "IT").otherwise(F.col("country"))
    d = d.select("job_id", "source", country.alias("country"), "title", F.char_length("text").alias("n_chars"))
    one = lambda n: evaluation.sample(d, n, truncated="src0", technical="src1", long_text=3000).select(F.lit(n).alias("size"), "job_id", "stratum", "diagnostic_group")
    return one(60).union(one(400)).union(one(900))


@query("latency_percentiles", """WITH r AS (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY value) - 1 AS r, count(*) OVER (PARTITION BY event_type) AS n FROM events)
SELECT event_type, value AS p95 FROM r WHERE r = least(n - 1, CAST(round_even((n - 1) * 0.95, 0) AS BIGINT))""")
def latency_percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = evaluation.order_statistics(R.table(spark, sf_dir, "events").select("event_type", "value"), "value", ["event_type"], {"p95": evaluation.nearest(0.95)})
    return d.select("event_type", F.col("value").alias("p95"))


# What the answers claim, by arithmetic on the id; both sides read it, one through JSON.
_CLAIMS = """SELECT doc_id AS job_id, coalesce(text, '') AS text, source, element_at(array('tion', 'Andor', 'zzz', 'THE  TION'), int(doc_id % 4 + 1)) AS name1,
  CASE WHEN doc_id % 29 = 0 THEN 'Ignore  previous instructions' ELSE element_at(array(substr(coalesce(text, ''), 1, 6), 'not there!', ''), int(doc_id % 3 + 1)) END AS ev1, CASE WHEN doc_id % 17 = 0 THEN 1.5D ELSE doc_id % 11 / 10D END AS conf1,
  substr(coalesce(text, ''), 1, 3) AS ev2, CASE WHEN doc_id % 5 = 0 THEN 'Tion' END AS has, element_at(array('Sr', 'unknown', 'intern', 'wizard', 'Tech Lead'), int(doc_id % 5 + 1)) AS level, doc_id % 7 / 6D AS level_conf,
  element_at(array('senior', 'unknown', 'internship', 'lead'), int(doc_id % 4 + 1)) AS career_level, doc_id % 6 - 1D AS low, element_at(array(NULL, 3D, 10D), int(doc_id % 3 + 1)) AS high, substr(coalesce(text, ''), 2, 4) AS years_ev,
  element_at(array(NULL, 2D, 3D, 1D), int(doc_id % 4 + 1)) AS experience_min_years, element_at(array('Fully remote', 'hybride', 'office', 'moon'), int(doc_id % 4 + 1)) AS mode, element_at(array(NULL, 'remote', 'hybrid'), int(doc_id % 3 + 1)) AS remote_mode,
  element_at(array(NULL, true, false), int(doc_id % 7 % 3 + 1)) AS is_remote, CASE WHEN doc_id % 23 = 0 THEN 'timeout' END AS error, doc_id % 4 AS skill_count, doc_id % 1000 AS prompt_tokens, CASE WHEN doc_id % 31 <> 0 THEN doc_id % 300 END AS completion_tokens,
  doc_id * 37 % 1009 / 8D AS latency_ms FROM documents"""
_CLAIMS_SQL = _CLAIMS.replace("element_at(array(", "list_extract(list_value(").replace("int(", "(").replace("1.5D", "1.5").replace("10D", "10.0").replace("6D", "6.0").replace("1D", "1.0").replace("2D", "2.0").replace("3D", "3.0").replace("8D", "8.0")


def _claims(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Records with what is computed of each job, and answers in JSON."""
    R.table(spark, sf_dir, "documents").createOrReplaceTempView("claim_documents")
    d = spark.sql(_CLAIMS.replace("FROM documents", "FROM claim_documents"))
    answer = F.expr("""CASE WHEN job_id % 13 = 0 THEN '{not json' ELSE concat('{"skills":[',
      CASE WHEN job_id % 19 = 0 THEN to_json(struct(name1 AS name, ev1 AS evidence, conf1 AS confidence, 1 AS note)) ELSE to_json(struct(name1 AS name, ev1 AS evidence, conf1 AS confidence, true AS explicit)) END, ',',
      to_json(struct('the tion' AS name, ev2 AS evidence, 0.9 AS confidence)), '],"career_level":', to_json(struct(level AS value, ev1 AS evidence, level_conf AS confidence)),
      ',"experience_requirement":', to_json(struct(low AS minimum_years, coalesce(cast(high AS string), 'not specified') AS maximum_years, years_ev AS evidence, 0.8 AS confidence)),
      ',"work_mode":', to_json(struct(mode AS value, ev2 AS evidence, 1 AS confidence)), '}') END""")
    none = F.expr("cast(array() as array<string>)")
    return d.withColumn("skills", F.when(F.col("has").isNotNull(), F.array("has")).otherwise(none)), d.select("job_id", answer.alias("answer"), "error")


def _ground(evidence: str, confidence: str) -> str:
    return f"CASE WHEN {confidence} < 0.7 THEN 'low_confidence' WHEN {evidence} = '' OR NOT contains(text, {evidence}) THEN 'hallucinated_evidence' END"


_ITEMS_SQL = f"""c AS MATERIALIZED ({_CLAIMS_SQL}),
st AS (SELECT *, CASE WHEN error IS NOT NULL THEN 'call' WHEN job_id % 13 = 0 OR job_id % 17 = 0 OR job_id % 19 = 0 THEN 'json' WHEN job_id % 29 = 0 THEN 'response' ELSE 'read' END AS state FROM c),
rd AS (SELECT * FROM st WHERE state = 'read'),
s0 AS (SELECT job_id, 0 AS pos, name1 AS value, ev1 AS ev, conf1 AS conf, text, has FROM rd UNION ALL SELECT job_id, 1, 'the tion', ev2, 0.9, text, has FROM rd),
s1 AS (SELECT *, CASE lower(regexp_replace(value, '\\s+', ' ', 'g')) WHEN 'tion' THEN 'Tion' WHEN 'the tion' THEN 'Tion' WHEN 'andor' THEN 'Andor' END AS canonical FROM s0),
s2 AS (SELECT *, CASE WHEN canonical IS NULL THEN 'unknown_ontology_skill' WHEN ev = '' OR NOT contains(text, ev) THEN 'hallucinated_evidence' WHEN conf < 0.7 THEN 'low_confidence' WHEN canonical = has THEN 'already_deterministic' END AS r FROM s1),
s3 AS (SELECT *, CASE WHEN r IS NULL AND min(pos) FILTER (WHERE r IS NULL) OVER (PARTITION BY job_id, canonical) < pos THEN 'duplicate_skill' ELSE r END AS reason FROM s2),
l0 AS (SELECT *, CASE level WHEN 'Sr' THEN 'senior' WHEN 'intern' THEN 'internship' WHEN 'Tech Lead' THEN 'lead' END AS lv, CASE mode WHEN 'Fully remote' THEN 'remote' WHEN 'hybride' THEN 'hybrid' WHEN 'office' THEN 'on_site' END AS md,
  CASE WHEN is_remote THEN 'remote' WHEN NOT is_remote THEN 'on_site' END AS said FROM rd),
l1 AS (SELECT job_id, 'career_level' AS field, lv AS value, coalesce({_ground("ev1", "level_conf")}, CASE WHEN career_level <> 'unknown' AND career_level <> lv THEN 'deterministic_conflict' END) AS reason FROM l0 WHERE lv IS NOT NULL
  UNION ALL SELECT job_id, 'experience', CAST(CAST(low AS DOUBLE) AS VARCHAR), CASE WHEN high < low THEN 'contradictory_experience' WHEN low < 0 THEN 'invalid_experience' ELSE coalesce({_ground("years_ev", "0.8")}, CASE WHEN experience_min_years <> low THEN 'deterministic_conflict' END) END FROM l0
  UNION ALL SELECT job_id, 'work_mode', md, coalesce({_ground("ev2", "1")}, CASE WHEN said <> md THEN 'metadata_conflict' END, CASE WHEN remote_mode <> md THEN 'deterministic_conflict' END) FROM l0 WHERE md IS NOT NULL),
items AS (SELECT job_id, state AS field, '' AS value, NULL AS canonical, 'rejected' AS verdict, CASE state WHEN 'call' THEN error WHEN 'json' THEN 'invalid_json_schema' ELSE 'prompt_injection' END AS reason FROM st WHERE state <> 'read'
  UNION ALL SELECT job_id, 'skill', value, canonical, CASE WHEN canonical IS NULL THEN 'unmapped' WHEN reason IS NULL THEN 'accepted' ELSE 'rejected' END, reason FROM s3
  UNION ALL SELECT job_id, field, value, CASE WHEN reason IS NULL THEN value END, CASE WHEN reason IS NULL THEN 'accepted' WHEN reason LIKE '%_conflict' THEN 'conflict' ELSE 'rejected' END, reason FROM l1)"""


@query("answer_validation", f"WITH {_ITEMS_SQL} SELECT * FROM items")
def answer_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    jobs, answers = _claims(spark, sf_dir)
    return evaluation.validated(answers, jobs, ontology.alias_index(words(spark)))


_FIGURES_SQL = {
    "jobs": "count(*)", "calls": "count(*) FILTER (WHERE prompt_tokens <> 0 OR coalesce(completion_tokens, 0) <> 0 OR latency_ms > 0)", "successful": "count(*) FILTER (WHERE error IS NULL)", "failed": "count(error)",
    "valid_json_rate": "avg(CASE WHEN bad THEN 0.0 ELSE 1.0 END)", "acceptance_rate": "coalesce(sum(acc) / nullif(sum(acc + rej + unm), 0), 0)", "rejection_rate": "coalesce(sum(rej + unm) / nullif(sum(acc + rej + unm), 0), 0)",
    "accepted": "sum(acc)", "rejected_or_unmapped": "sum(rej + unm)", "unmapped": "sum(unm)", "mean_accepted": "avg(acc)", "jobs_with_additions": "count(*) FILTER (WHERE acc > 0)", "median_accepted": "median(acc)",
    "matcher_mean_skills": "avg(skill_count)", "combined_mean_skills": "avg(skill_count + acc)", "accepted_zero_skill": "coalesce(sum(acc) FILTER (WHERE skill_count = 0), 0)", "accepted_nonzero_skill": "coalesce(sum(acc) FILTER (WHERE skill_count > 0), 0)",
    "jobs_zero_skill_accepted": "count(*) FILTER (WHERE skill_count = 0 AND acc > 0)", "jobs_nonzero_skill_accepted": "count(*) FILTER (WHERE skill_count > 0 AND acc > 0)",
    "career_agreement": "avg(CASE WHEN career IS NULL OR career = career_level THEN 1.0 ELSE 0.0 END)", "experience_agreement": "avg(CASE WHEN years IS NULL OR coalesce(years = experience_min_years, false) THEN 1.0 ELSE 0.0 END)",
    "mode_agreement": "avg(CASE WHEN mode_ok IS NULL OR coalesce(mode_ok = remote_mode, false) THEN 1.0 ELSE 0.0 END)", "new_levels": "count(*) FILTER (WHERE career_level = 'unknown' AND career IS NOT NULL)", "mean_latency_ms": "avg(latency_ms)",
    "prompt_tokens": "sum(prompt_tokens)", "completion_tokens": "coalesce(sum(completion_tokens), 0)", "cost_usd": "{c}", "cost_usd_1000": "{c} / count(*) * 1000", "cost_usd_corpus": "{c} / count(*) * 35968",
}
# Decimals, as doubles leave to chance which way halves of the last digit go.
_COST_SQL = "CAST(round(CAST(sum(prompt_tokens) AS DECIMAL(20, 0)) * 0.00000059 + CAST(coalesce(sum(completion_tokens), 0) AS DECIMAL(20, 0)) * 0.00000079, 6) AS DOUBLE)"


@query("evaluation_metrics", f"""WITH {_ITEMS_SQL}, own AS (SELECT job_id, count(*) FILTER (WHERE field = 'skill' AND verdict = 'accepted') AS acc, count(*) FILTER (WHERE verdict = 'unmapped') AS unm, count(*) FILTER (WHERE verdict IN ('rejected', 'conflict')) AS rej,
  bool_or(field IN ('call', 'json')) AS bad, max(value) FILTER (WHERE field = 'career_level' AND verdict = 'accepted') AS career, max(value) FILTER (WHERE field = 'work_mode' AND verdict = 'accepted') AS mode_ok,
  TRY_CAST(max(value) FILTER (WHERE field = 'experience' AND verdict = 'accepted') AS DOUBLE) AS years FROM items GROUP BY job_id),
rec AS (SELECT c.*, source AS stratum, coalesce(acc, 0) AS acc, coalesce(unm, 0) AS unm, coalesce(rej, 0) AS rej, coalesce(bad, false) AS bad, career, mode_ok, years FROM c LEFT JOIN own USING (job_id)),
two AS (SELECT * EXCLUDE (stratum), unnest([stratum, NULL]) AS stratum FROM rec),
lat AS (SELECT stratum, latency_ms, row_number() OVER (PARTITION BY stratum ORDER BY latency_ms) - 1 AS k, count(*) OVER (PARTITION BY stratum) - 1 AS n FROM two)
SELECT stratum, unnest([{", ".join(f"'{k}'" for k in _FIGURES_SQL)}]) AS metric, unnest([{", ".join(f"CAST({v.format(c=_COST_SQL)} AS DOUBLE)" for v in _FIGURES_SQL.values())}]) AS value FROM two GROUP BY stratum
UNION ALL SELECT stratum, 'p50_latency_ms', latency_ms FROM lat WHERE k = CAST(round_even(n * 0.5, 0) AS BIGINT) UNION ALL SELECT stratum, 'p95_latency_ms', latency_ms FROM lat WHERE k = CAST(round_even(n * 0.95, 0) AS BIGINT)
UNION ALL SELECT stratum, 'rejected:' || reason, CAST(count(*) AS DOUBLE) FROM items JOIN two USING (job_id) WHERE reason IS NOT NULL GROUP BY ALL""")
def evaluation_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    jobs, answers = _claims(spark, sf_dir)
    items = cut_off(evaluation.validated(answers, jobs, ontology.alias_index(words(spark))))  # read three times
    return evaluation.metrics(jobs.withColumnRenamed("source", "stratum"), items)


def _resumes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with the headings, dates and contact lines of a résumé around them."""
    k = F.col("doc_id") % 4
    head = F.concat(F.lit("Anna Maria Muster\n"), F.when(k == 0, "anna@example.org, +33 6 12 34 56 78\n").otherwise("2020 - 2023\n"))
    job = F.concat(F.lit("Experience\nAnalyst at X, "), F.when(k == 1, "janvier 2020 - présent").when(k == 2, "03/2021 - 05/2022").otherwise("May 2019 to June 2019"), F.lit("\nReduced costs by 12 %\n"))
    return R.table(spark, sf_dir, "documents").select("doc_id", F.concat(head, job, F.lit("Éducation :\nMaster in data science, 2024\nSkills\n"), F.regexp_replace(F.coalesce("text", F.lit("")), r"\n", " ")).alias("text"))


@query("resume_sections", """WITH h AS (SELECT doc_id, 18 + CASE WHEN doc_id % 4 = 0 THEN 36 ELSE 12 END AS a, CASE doc_id % 4 WHEN 1 THEN 22 WHEN 2 THEN 17 ELSE 21 END AS d, length(coalesce(text, '')) AS n FROM documents)
SELECT doc_id, 'experience' AS label, CAST(a + 10 AS BIGINT) AS start, CAST(a + 10 + 15 + d + 22 + 1 AS BIGINT) AS "end" FROM h UNION ALL SELECT doc_id, 'education', a + 48 + d + 11, a + 48 + d + 11 + 30 FROM h
UNION ALL SELECT doc_id, 'skills', a + 48 + d + 41 + 6, a + 48 + d + 41 + 7 + n FROM h""")
def resume_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resumes.sections(_resumes(spark, sf_dir)).select("doc_id", "label", "start", "end")


@query("resume_experience", """SELECT doc_id, 'job' AS entry_type, CASE doc_id % 4 WHEN 1 THEN 'janvier 2020' WHEN 2 THEN '03/2021' ELSE 'may 2019' END AS start_date, CASE doc_id % 4 WHEN 1 THEN 'present' WHEN 2 THEN '05/2022' ELSE 'june 2019' END AS end_date,
  CASE doc_id % 4 WHEN 1 THEN 54 WHEN 2 THEN 15 ELSE 2 END AS months FROM documents""")
def resume_experience(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = resumes.experience_entries(_resumes(spark, sf_dir), F.lit("2024-06-15").cast("date")).where("evidence like 'Analyst%'")
    return e.select("doc_id", "entry_type", "start_date", "end_date", "months")


@query("resume_education", "SELECT doc_id, 'master/mba' AS level, 'data science' AS field, 2024 AS graduation_year FROM documents")
def resume_education(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = F.regexp_extract("text", r"(Master in [^\n]*)", 1)
    return _resumes(spark, sf_dir).select("doc_id", resumes.education(line).alias("e")).select("doc_id", "e.level", "e.field", "e.graduation_year")


@query("resume_contacts", "SELECT doc_id, doc_id % 4 = 0 AS has_email, doc_id % 4 = 0 AS has_phone, true AS has_name FROM documents")
def resume_contacts(spark: SparkSession, sf_dir: str) -> DataFrame:
    top = F.array_join(F.slice(F.split("text", "\n"), 1, 2), "\n")
    return _resumes(spark, sf_dir).select("doc_id", resumes.contact_signals(top).alias("c")).select("doc_id", "c.has_email", "c.has_phone", "c.has_name")


@query("resume_report")
def resume_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = _resumes(spark, sf_dir)
    n = resumes.impact(resumes.experience_entries(r, F.lit("2024-06-15").cast("date")))
    yes = F.lit(True)
    d = r.join(n, "doc_id", "left").fillna(0, ["entries", "quantified"])
    checks = resumes.report_checks(F.col("quantified"), F.col("entries"), yes, F.lit(None).cast("boolean"), resumes.contact_signals(F.col("text")), yes, F.lit("high"), F.col("doc_id") % 7, F.lit(None).cast("int"))
    return d.select("doc_id", checks.alias("checks")).select("doc_id", resumes.overall(F.col("checks")).alias("overall"), "checks")


@query("resume_families")
def resume_families(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resumes.term_families(_resumes(spark, sf_dir), resumes.ROLE_FAMILIES).union(resumes.term_families(_resumes(spark, sf_dir), resumes.BUSINESS_TERMS))


@query("resume_clean_text")
def resume_clean_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.table(spark, sf_dir, "documents").select("doc_id", F.md5(resumes.clean_text(F.concat(F.lit("S k i l l s  and\r\n"), F.col("text"))).cast("binary")).alias("md5"))


@query("candidate_attributes")
def candidate_attributes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _resumes(spark, sf_dir).select("doc_id", attributes.candidate_attributes(F.col("text"), F.expr("cast(array() as array<string>)")).alias("a")).select("doc_id", "a.*")


@query("near_duplicate_groups")
def near_duplicate_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return curation.near_duplicate_groups(R.table(spark, sf_dir, "documents"))


@query("skill_totals", "SELECT count(*) AS jobs, count(DISTINCT lang) AS countries FROM documents")
def skill_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = R.postings(spark, sf_dir)
    return A.with_total(p.agg(F.count("*").alias("jobs")), p.agg(F.count_distinct("country").alias("countries")))


@query("resume_profiles")
def resume_profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = _resumes(spark, sf_dir)
    s = spark.createDataFrame([("Data Science", "data", [], None), ("Machine Learning", "ml_ai", ["rest in"], None), ("R", "language", [], None)], _SKILLS)
    return resumes.deterministic_profiles(r, skillmatch.matches(r, s), F.lit("2024-06-15").cast("date"))


@query("work_modes", f"""WITH {R.POSTINGS_SQL}, m AS (SELECT job_id, concat_ws(' ', title, concat(description, CASE job_id % 4 WHEN 0 THEN ' Full Remote' WHEN 1 THEN ' hybrid role' WHEN 2 THEN ' on-site, présentiel' ELSE '' END)) AS t FROM postings)
SELECT job_id, t ILIKE '%remote%' OR t ILIKE '%télétravail%' OR t ILIKE '%teletravail%' AS remote, t ILIKE '%hybrid%' AS hybrid, t ILIKE '%on-site%' OR t ILIKE '%on site%' OR t ILIKE '%présentiel%' AS on_site FROM m""")
def work_modes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Titles and whole descriptions, with the words of a mode put at the end of most."""
    k = F.col("job_id") % 4
    mode = F.when(k == 0, " Full Remote").when(k == 1, " hybrid role").when(k == 2, " on-site, présentiel").otherwise("")
    d = F.concat(F.coalesce("description", F.lit("")), mode)
    return R.postings(spark, sf_dir).select("job_id", *[V.mode_filter(m, F.col("title"), d).alias(m) for m in ("remote", "hybrid", "on_site")])


@query("candidate_union", """WITH l AS (SELECT DISTINCT l_suppkey AS p, l_partkey AS j FROM lineitem WHERE l_quantity > 25), s AS (SELECT l_suppkey AS p, l_partkey AS j, max(l_discount) AS d FROM lineitem WHERE l_quantity < 30 GROUP BY ALL)
SELECT coalesce(l.p, s.p) AS profile_id, coalesce(l.j, s.j) AS job_id, CASE WHEN l.p IS NOT NULL AND s.p IS NOT NULL THEN 'both' WHEN s.p IS NOT NULL THEN 'semantic' ELSE 'lexical' END AS retrieval_source, coalesce(s.d, -1) AS semantic_score FROM l FULL JOIN s ON l.p = s.p AND l.j = s.j""")
def candidate_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = R.table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("profile_id"), F.col("l_partkey").alias("job_id"), "l_quantity", "l_discount")
    a = li.where("l_quantity > 25").select("profile_id", "job_id", F.lit(1).alias("overlap")).distinct()
    b = li.where("l_quantity < 30").groupBy("profile_id", "job_id").agg(F.max("l_discount").alias("semantic_score"))
    return matching.union_candidates(a, b).select("profile_id", "job_id", "retrieval_source", F.coalesce("semantic_score", F.lit(-1.0)).alias("semantic_score"))


@query("fallback_candidates", """WITH first_ AS (SELECT job_id, row_number() OVER (ORDER BY job_id) AS lexical_rank FROM (SELECT DISTINCT l_orderkey AS job_id FROM lineitem ORDER BY 1 LIMIT 200))
SELECT s_suppkey AS profile_id, job_id, 0 AS overlap, lexical_rank FROM supplier, first_ WHERE s_suppkey % 10 = 0""")
def fallback_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = R.table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("profile_id"))
    js = R.job_skills(spark, sf_dir).select("job_id", F.col("skill_id").alias("skill"))
    return matching.fallback_candidates(p, p.where("profile_id % 10 <> 0"), js)


@query("preference_overlay", f"""WITH {R.JOB_SKILLS_SQL}, {R.PROFILES_SQL} SELECT profile_id, CASE WHEN profile_id % 2 = 0 THEN 'fr' ELSE country END AS country FROM profiles""")
def preference_overlay(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = R.profiles(spark, sf_dir)
    f = p.where("profile_id % 2 = 0").select("profile_id", F.lit("fr").alias("country"), F.lit(None).cast("string").alias("city"), F.lit(None).cast("boolean").alias("remote"))
    return matching.with_preferences(p, f).select("profile_id", "country")


@query("profiles_in_scope", f"""WITH {R.JOB_SKILLS_SQL}, {R.PROFILES_SQL} SELECT profile_id FROM profiles p WHERE profile_id % 3 <> 1 OR EXISTS (SELECT 1 FROM profile_skills s JOIN part ON s.skill = p_partkey WHERE s.profile_id = p.profile_id AND p_type <> 'ECONOMY')""")
def profiles_in_scope(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = R.skills(spark, sf_dir).select(F.col("skill_id").cast("string").alias("canonical"), F.when(F.col("category") == "ECONOMY", "soft_skill").otherwise("tool").alias("category"))
    return matching.in_scope(R.profiles(spark, sf_dir), s).select("profile_id")


@query("job_bundles", f"""WITH {R.JOBS_SQL}, {R.JOB_SKILLS_SQL} SELECT j.job_id, count(DISTINCT s.skill_id) AS n FROM jobs j LEFT JOIN job_skills s ON j.job_id = s.job_id WHERE j.job_id % 2 = 0 GROUP BY j.job_id""")
def job_bundles(spark: SparkSession, sf_dir: str) -> DataFrame:
    j = R.jobs(spark, sf_dir).select("job_id")
    js = R.job_skills(spark, sf_dir).select("job_id", F.col("skill_id").cast("string").alias("skill"))
    return matching.bundles(j, js, j.where("job_id % 2 = 0")).select("job_id", F.size("skills").cast("long").alias("n"))


@query("answer_costs", """SELECT event_type, round(sum(user_id) / 1000000.0 * 0.59 + sum(event_id) / 1000000.0 * 0.79, 6) AS cost FROM events GROUP BY event_type""")
def answer_costs(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = R.table(spark, sf_dir, "events").groupBy("event_type").agg(F.sum("user_id").alias("p"), F.sum("event_id").alias("c"))
    return e.select("event_type", guards.token_cost(F.col("p"), F.col("c")).alias("cost"))


@query("canonical_values", """SELECT event_id, CASE event_type WHEN 'view' THEN 'senior' WHEN 'click' THEN 'principal' WHEN 'error' THEN 'internship' ELSE 'unknown' END AS career, CASE event_type WHEN 'view' THEN 'remote' WHEN 'click' THEN 'hybrid' WHEN 'signup' THEN 'on_site' ELSE 'unknown' END AS mode FROM events""")
def canonical_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = lambda m: F.element_at(F.create_map(*[F.lit(x) for kv in m.items() for x in kv]), F.col("event_type"))
    career, mode = at({"view": " Sr", "click": "STAFF", "error": "Stage"}), at({"view": "Fully remote", "click": "Hybride", "signup": "On-site"})
    return R.table(spark, sf_dir, "events").select("event_id", guards.canonical_career(career).alias("career"), guards.canonical_mode(mode).alias("mode"))
