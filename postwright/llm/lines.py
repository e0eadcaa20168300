"""Line dedup by site-relative frequency (operator 1), with DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from postwright.llm.common import NOT_BLANK, materialize, table, unused

#: A line on more than this share of a host's pages is boilerplate ...
RATIO_PERCENT = 10
#: ... if it is on so many pages at least (a host of two pages has no statistics).
MIN_PAGES = 3
#: The boilerplate table is broadcast up to so many rows (16 MB of hashes) and joined by document beyond.
BROADCAST_ROWS = 1_000_000


def boilerplate_lines(
    docs: DataFrame, host: str = "source", text: str = "text", ratio_percent: int = RATIO_PERCENT, min_pages: int = MIN_PAGES
) -> DataFrame:
    """``(host, line_hash, pages, host_pages)`` of the lines whose share of the host's pages is over the ratio.

    A line is what stands between line feeds, without blanks around it; lines
    without other characters never count. A page counts once for a line that
    it repeats. A null host is a host of its own; a null text is a page
    without lines. Pages of each host are counted before any shuffle, so a
    hot host costs a few rows a task; a host has at most (lines a page) * 100 /
    ratio boilerplate lines, whatever its size.
    """
    pages = docs.select(F.col(f"`{host}`").alias("host"), _lines(F.col(f"`{text}`")).alias("lines"))
    totals = pages.groupBy("host").agg(F.count("*").alias("host_pages"))
    seen = (
        pages.select("host", F.explode(F.array_distinct(_hashes(F.col("lines")))).alias("line_hash"))
        .where("line_hash is not null")
        .groupBy("host", "line_hash")
        .agg(F.count("*").alias("pages"))
        .where(F.col("pages") >= min_pages)
    )
    return (
        seen.join(totals.withColumnRenamed("host", "h"), F.col("host").eqNullSafe(F.col("h")))
        .where(F.col("pages") * 100 > F.col("host_pages") * ratio_percent)
        .select("host", "line_hash", "pages", "host_pages")
    )


def drop_boilerplate(
    docs: DataFrame,
    host: str = "source",
    text: str = "text",
    id_col: str = "doc_id",
    ratio_percent: int = RATIO_PERCENT,
    min_pages: int = MIN_PAGES,
) -> DataFrame:
    """``docs`` with the boilerplate lines cut from ``text``, and ``n_lines``, ``n_dropped`` added.

    ``n_lines`` counts lines with a character besides blanks. Texts that lose
    nothing stay as they are, null included; a text that loses lines keeps its
    other lines in order, line feeds between them. Columns of the same names
    as the added ones are replaced. Repeated rows are pages of their own.
    An empty table gives an empty table.
    """
    at_host, at_id, at_hash, cuts, all_lines, kept = unused(docs, "host_", "id_", "hash_", "cut_", "lines_", "kept_")
    known = materialize(boilerplate_lines(docs, host, text, ratio_percent, min_pages))
    out = [c for c in docs.columns if c not in ("n_lines", "n_dropped")]
    by_host = known.groupBy("host").agg(F.collect_list("line_hash").alias(cuts)).withColumnRenamed("host", at_host)
    if known.count() <= BROADCAST_ROWS:
        with_cut = docs.join(F.broadcast(by_host), F.col(f"`{host}`").eqNullSafe(F.col(at_host)), "left")
    else:  # join what each document holds, so that no host's rows meet in one task
        held = docs.select(
            F.col(f"`{id_col}`").alias(at_id),
            F.col(f"`{host}`").alias(at_host),
            F.explode(F.array_distinct(_hashes(_lines(F.col(f"`{text}`"))))).alias(at_hash),
        )
        cut = (
            held.join(known, held[at_host].eqNullSafe(known["host"]) & (held[at_hash] == known["line_hash"]))
            .groupBy(at_id, at_host)
            .agg(F.collect_set("line_hash").alias(cuts))
        )
        with_cut = docs.join(
            cut, F.col(f"`{id_col}`").eqNullSafe(cut[at_id]) & F.col(f"`{host}`").eqNullSafe(cut[at_host]), "left"
        )
    lines = F.split(F.col(f"`{text}`"), "\n", -1)
    cut = F.coalesce(cuts, F.expr("cast(array() as array<bigint>)"))
    marked = with_cut.select(
        *[F.col(f"`{c}`") for c in out],
        lines.alias(all_lines),
        F.filter(lines, lambda x: ~F.coalesce(F.array_contains(cut, _hash(x)), F.lit(False))).alias(kept),
    )
    new_text = F.when(F.size(kept) < F.size(all_lines), F.array_join(kept, "\n")).otherwise(F.col(f"`{text}`"))
    return marked.select(
        *[(new_text if c == text else F.col(f"`{c}`")).alias(c) for c in out],
        F.coalesce(F.regexp_count(F.col(f"`{text}`"), F.lit(r"[^\n]*[^\x20\x09-\x0D][^\n]*")), F.lit(0))
        .cast("long")
        .alias("n_lines"),
        (F.coalesce(F.size(all_lines) - F.size(kept), F.lit(0))).cast("long").alias("n_dropped"),
    )


def _lines(text):
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def _hash(line):
    """Null for a line of blanks."""
    return F.when(line.rlike(NOT_BLANK), F.xxhash64(F.regexp_replace(line, r"^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$", "")))


def _hashes(lines):
    return F.transform(lines, _hash)


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    cleaned = drop_boilerplate(table(spark, sf_dir, "documents"))
    return cleaned.select("doc_id", "source", "n_lines", "n_dropped", "text")


OP1_SQL = f"""
WITH lines AS (
  SELECT doc_id, source, line, pos, trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS body
  FROM (SELECT doc_id, source, unnest(string_split(text, chr(10))) AS line,
               generate_subscripts(string_split(text, chr(10)), 1) AS pos
        FROM documents WHERE text IS NOT NULL)
), totals AS (SELECT source, count(*) AS host_pages FROM documents GROUP BY source),
cut AS (
  SELECT l.source, l.body FROM (SELECT source, body, count(DISTINCT doc_id) AS pages FROM lines WHERE body <> '' GROUP BY ALL) l
  JOIN totals t ON l.source IS NOT DISTINCT FROM t.source
  WHERE pages >= {MIN_PAGES} AND pages * 100 > host_pages * {RATIO_PERCENT}
), marked AS (
  SELECT l.*, c.body IS NOT NULL AS dropped
  FROM lines l LEFT JOIN cut c ON l.source IS NOT DISTINCT FROM c.source AND l.body = c.body
)
SELECT d.doc_id, d.source,
  CAST(coalesce(n_lines, 0) AS BIGINT) AS n_lines, CAST(coalesce(n_dropped, 0) AS BIGINT) AS n_dropped,
  CASE WHEN coalesce(n_dropped, 0) = 0 THEN d.text ELSE coalesce(kept, '') END AS text
FROM documents d LEFT JOIN (
  SELECT doc_id, count(*) FILTER (WHERE body <> '') AS n_lines, count(*) FILTER (WHERE dropped) AS n_dropped,
         string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT dropped) AS kept
  FROM marked GROUP BY doc_id) m USING (doc_id)
"""
