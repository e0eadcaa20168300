"""Quality rules with adaptive thresholds (operator 6), with DataFrame functions only.

Every metric of a document is an integer: parts per ten thousand. A group's
quantile sketch is the histogram of its values over bins of seven significant
bits (a relative error of 1/64 at most). Sketches merge by adding counts, so
those of a language are the sums of those of its sources, and the order of
rows or tasks never changes a threshold.

A limit is an upper quantile of the group plus FENCE times its distance from
the median, and nothing else: there are no fixed cutoffs besides the base
rules. The upper quantile is the first of UPPER that lies over the median, so
a metric that most documents don't have is judged by those that have it. Quantile
and distance of a source are drawn towards those of its language, and these
towards those of all documents, with the weight of PRIOR documents. No distance
is taken to be less than the sketch's error at the median.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from postwright.llm.common import BLANKS, NOT_BLANK, let, materialize, shingle_hashes, table, words

MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
#: Documents that the parent level weighs in a group's quantiles: a small group follows its language, a large one itself.
PRIOR = 300
#: A limit is so many distances between an outer quantile and the median beyond that quantile.
FENCE = 15
#: Percents of the upper quantiles; the first over the median counts, the last if none is.
UPPER = [75, 90, 95, 99]
LOWER = 25
SYMBOLS = "[#*$%&|<>]"
#: ASCII characters that are neither letters nor blanks.
MARKS = r"[\x21-\x40\x5B-\x60\x7B-\x7E]"
#: ``word_length`` has a lower limit as well.
METRICS = ["symbols", "dup_lines", "repeats", "word_length", "marks"]
BROADCAST_GROUPS = 200_000

COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def repeat_words(word_list: Column, n: int = 3) -> Column:
    """Words that some ``n``-word window found twice or more in the list covers, each counted once."""

    def covered(s: Column) -> Column:
        same = lambda x, j: F.coalesce(F.get(s, j)["h"] == x["h"], F.lit(False))
        found = F.filter(s, lambda x, j: same(x, j - 1) | same(x, j + 1))
        start = F.struct(F.lit(-n).alias("at"), F.lit(0).alias("n"))
        step = lambda acc, p: F.struct(p.alias("at"), (acc["n"] + F.least(F.lit(n), p - acc["at"])).alias("n"))
        return F.aggregate(F.sort_array(F.transform(found, lambda x: x["i"])), start, step, lambda acc: acc["n"])

    def count(w: Column) -> Column:
        pairs = F.sort_array(F.transform(w, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        return F.when(F.size(F.array_distinct(w)) == F.size(w), F.lit(0)).otherwise(let(pairs, covered))

    return let(word_list, lambda w: F.when(F.size(w) <= n, F.lit(0)).otherwise(let(shingle_hashes(w, n), count)))


def counts(text: Column) -> Column:
    """Struct of the five counts of a whole text; null counts as a text without words."""
    t = F.coalesce(text, F.lit(""))
    lines = F.filter(F.split(t, "\n", -1), lambda x: x.rlike(NOT_BLANK))
    return let(
        words(t),
        lambda w: F.struct(
            F.size(w).cast("long").alias("n_words"),
            F.char_length(F.array_join(w, "")).cast("long").alias("word_chars"),
            F.regexp_count(t, F.lit(SYMBOLS)).cast("long").alias("n_symbols"),
            F.regexp_count(t, F.lit(MARKS)).cast("long").alias("n_marks"),
            let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"),
            F.greatest(F.size(F.split(F.trim(t), "\n")), F.lit(1)).cast("long").alias("n_lines"),
            repeat_words(w).cast("long").alias("n_repeat_words"),
        ),
    )


def _metrics() -> dict[str, Column]:
    of = lambda a, b: F.floor(F.col(a) * 10000 / F.greatest(F.col(b), F.lit(1))).cast("long")
    return {
        "symbols": of("n_symbols", "n_words"),
        "dup_lines": of("n_dup_lines", "n_lines"),
        "repeats": of("n_repeat_words", "n_words"),
        "word_length": of("word_chars", "n_words"),
        "marks": of("n_marks", "word_chars"),
    }


def _failed() -> Column:
    return (F.col("n_words") < MIN_WORDS) | (F.col("n_repeat_words") * 100 > F.col("n_words") * MAX_REPEAT_PERCENT)


def thresholds(counted: DataFrame) -> DataFrame:
    """``(lang, source, max_ of each metric, min_word_length)`` for every language and source of ``counted``.

    ``counted`` has ``lang``, ``source`` and the counts. Documents that the base
    rules fail don't shape the quantiles. A row for each group, however many
    documents it has: the histograms are added up task by task before they are
    dealt out, so a hot source costs a few hundred rows a task. Limits are null
    where no document passes the base rules.
    """
    floor_bin = F.when(F.col("m") < 128, F.col("m")).otherwise(
        F.expr("shiftleft(shiftright(m, greatest(length(bin(m)) - 7, 0)), greatest(length(bin(m)) - 7, 0))")
    )
    long = (
        counted.where(~_failed())
        .select("lang", "source", F.explode(F.create_map(*[x for k, v in _metrics().items() for x in (F.lit(k), v)])).alias("metric", "m"))
        .select("lang", "source", "metric", floor_bin.alias("bin"))
    )
    own = materialize(long.groupBy("lang", "source", "metric", "bin").agg(F.count("*").alias("n")))
    groups = counted.groupBy("lang", "source").agg(F.count("*").alias("docs"))
    out = groups.select("lang", "source", F.explode(F.array(*[F.lit(m) for m in METRICS])).alias("metric"))
    levels = [("a", []), ("l", ["lang"]), ("s", ["lang", "source"])]
    for name, by in levels:
        out = _left(out, _quantiles(own, by, name), [*by, "metric"])
    for k, (name, _) in enumerate(levels):
        for x in ("hi", "up", "lo", "down"):
            mine = F.col(f"{name}_{x}")
            if k:
                above = F.col(f"{levels[k - 1][0]}_{x}")
                drawn = F.expr(f"({name}_n * {name}_{x} + {PRIOR} * {levels[k - 1][0]}_{x}) div ({name}_n + {PRIOR})")
                mine = F.when(F.col(f"{name}_n").isNull(), above).otherwise(drawn)
            out = out.withColumn(f"{name}_{x}", mine)
    top = F.col("s_hi") + FENCE * F.col("s_up")
    bottom = F.col("s_lo") - FENCE * F.col("s_down")
    return out.groupBy("lang", "source").agg(
        *[F.max(F.when(F.col("metric") == m, top)).alias(f"max_{m}") for m in METRICS],
        F.max(F.when(F.col("metric") == "word_length", bottom)).alias("min_word_length"),
    )


def _quantiles(own: DataFrame, by: list[str], name: str) -> DataFrame:
    """From the merged histograms of a level: size, upper and lower quantile and their distances from the median."""
    keys = [*by, "metric"]
    hist = own.groupBy(*keys, "bin").agg(F.sum("n").alias("n"))
    up = Window.partitionBy(*keys).orderBy("bin")
    ranked = hist.withColumn("c", F.sum("n").over(up)).withColumn("t", F.sum("n").over(Window.partitionBy(*keys)))
    q = ranked.groupBy(*keys).agg(
        F.max("t").alias("n"),
        *[F.min(F.when(F.col("c") * 100 >= F.col("t") * p, F.col("bin"))).alias(f"q{p}") for p in (LOWER, 50, *UPPER)],
    )
    hi = F.coalesce(*[F.when(F.col(f"q{p}") > F.col("q50"), F.col(f"q{p}")) for p in UPPER], F.col(f"q{UPPER[-1]}"))
    apart = lambda d: F.greatest(d, F.shiftright("q50", 6))
    made = {"n": F.col("n"), "hi": hi, "up": apart(hi - F.col("q50")), "lo": F.col(f"q{LOWER}"), "down": apart(F.col("q50") - F.col(f"q{LOWER}"))}
    return q.select(*keys, *[v.alias(f"{name}_{k}") for k, v in made.items()])


def _left(a: DataFrame, b: DataFrame, on: list[str]) -> DataFrame:
    b = b.withColumnsRenamed({c: f"__{c}" for c in on})
    cond = F.lit(True)
    for c in on:
        cond = cond & a[c].eqNullSafe(b[f"__{c}"])
    return a.join(b, cond, "left").drop(*[f"__{c}" for c in on])


def judged(counted: DataFrame, limits: DataFrame) -> DataFrame:
    """``counted`` with ``base_failed`` and ``kept``."""
    if limits.count() <= BROADCAST_GROUPS:
        limits = F.broadcast(limits)
    m = _metrics()
    inside = (
        (m["symbols"] <= F.col("max_symbols"))
        & (m["dup_lines"] <= F.col("max_dup_lines"))
        & (m["repeats"] <= F.col("max_repeats"))
        & (m["marks"] <= F.col("max_marks"))
        & (m["word_length"] <= F.col("max_word_length"))
        & (m["word_length"] >= F.col("min_word_length"))
    )
    j = _left(counted, limits, ["lang", "source"])
    j = j.withColumn("base_failed", _failed()).withColumn("kept", ~F.col("base_failed") & F.coalesce(inside, F.lit(False)))
    return j.drop("min_word_length", *[f"max_{k}" for k in METRICS])


def counted_documents(docs: DataFrame, id_col: str = "doc_id", text: str = "text", lang: str = "lang", source: str = "source") -> DataFrame:
    return docs.select(
        F.col(f"`{id_col}`").alias("doc_id"),
        F.col(f"`{lang}`").alias("lang"),
        F.col(f"`{source}`").alias("source"),
        counts(F.col(f"`{text}`")).alias("c"),
    ).select("doc_id", "lang", "source", "c.*")


def quality_rules(docs: DataFrame, id_col: str = "doc_id", text: str = "text", lang: str = "lang", source: str = "source") -> DataFrame:
    """A verdict for every row of ``docs``: counts, ``base_failed``, ``kept``.

    Null or blank texts have no words and fail. Null languages and sources are
    groups like others. Repeated rows each get their verdict. An empty table
    gives an empty table.
    """
    c = materialize(counted_documents(docs, id_col, text, lang, source))
    return judged(c, materialize(thresholds(c)))


def keep_good(docs: DataFrame, text: str = "text", lang: str = "lang", source: str = "source") -> DataFrame:
    """The rows of ``docs`` that the rules keep, with the columns of ``docs``; awkward rows as in ``quality_rules``.

    Rows are written once with their counts, so that no text is counted twice
    and none is shuffled to meet its verdict.
    """
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    c = docs.select(row.alias("__row"), F.col(f"`{lang}`").alias("lang"), F.col(f"`{source}`").alias("source"), counts(F.col(f"`{text}`")).alias("c"))
    c = materialize(c).select("__row", "lang", "source", "c.*")
    return judged(c, materialize(thresholds(c))).where("kept").select("__row.*")


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(table(spark, sf_dir, "documents")).select("doc_id", *COUNTS, "base_failed", "kept")


def _level(name: str, by: list[str]) -> str:
    """SQL for the quantiles of one level, a row for each group and metric."""
    keys = ", ".join([*by, "metric"])
    cuts = ", ".join(f"min(bin) FILTER (WHERE c * 100 >= t * {p}) AS q{p}" for p in (LOWER, 50, *UPPER))
    hi = "CASE " + " ".join(f"WHEN q{p} > q50 THEN q{p}" for p in UPPER) + f" ELSE q{UPPER[-1]} END"
    return f"""{name} AS (
  SELECT {keys}, n, {hi} AS hi, greatest({hi} - q50, q50 >> 6) AS up, q{LOWER} AS lo, greatest(q50 - q{LOWER}, q50 >> 6) AS down FROM (
    SELECT {keys}, CAST(max(t) AS BIGINT) AS n, {cuts}
    FROM (SELECT *, sum(n) OVER (PARTITION BY {keys} ORDER BY bin) AS c, sum(n) OVER (PARTITION BY {keys}) AS t
          FROM (SELECT {keys}, bin, sum(n) AS n FROM hist GROUP BY ALL)) GROUP BY {keys}))"""


def rules_sql(docs: str = "documents") -> str:
    """CTEs up to ``verdicts`` for the rows of the relation ``docs``."""
    drawn = lambda a, b, x: f"CASE WHEN {a}.n IS NULL THEN {b} ELSE ({a}.n * {a}.{x} + {PRIOR} * {b}) // ({a}.n + {PRIOR}) END"
    value = lambda x: drawn("qs", f"({drawn('ql', f'qa.{x}', x)})", x)
    names = ", ".join(f"'{m}'" for m in METRICS)
    return f"""base AS (
  SELECT doc_id, lang, source, coalesce(text, '') AS text,
    list_filter(regexp_split_to_array(coalesce(text, ''), '{BLANKS}'), lambda x: x <> '') AS w FROM {docs}
), runs AS (
  SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS c
  FROM (SELECT doc_id, i, w[i:i + 2] AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM base))
), repeats AS (
  SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS p FROM runs WHERE c > 1) GROUP BY doc_id
), counted AS (
  SELECT b.doc_id, lang, source, CAST(len(w) AS BIGINT) AS n_words,
    CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars,
    CAST(length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
    CAST(length(regexp_replace(text, '{MARKS.replace("[", "[^", 1)}', '', 'g')) AS BIGINT) AS n_marks,
    CAST(len(list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '{NOT_BLANK}')))
       - len(list_distinct(list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '{NOT_BLANK}')))) AS BIGINT) AS n_dup_lines,
    CAST(greatest(len(string_split(trim(text, ' '), chr(10))), 1) AS BIGINT) AS n_lines,
    CAST(coalesce(r.n, 0) AS BIGINT) AS n_repeat_words
  FROM base b LEFT JOIN repeats r ON b.doc_id = r.doc_id
), scored AS (
  SELECT *, n_words < {MIN_WORDS} OR n_repeat_words * 100 > n_words * {MAX_REPEAT_PERCENT} AS base_failed,
    n_symbols * 10000 // greatest(n_words, 1) AS symbols, n_dup_lines * 10000 // n_lines AS dup_lines,
    n_repeat_words * 10000 // greatest(n_words, 1) AS repeats, word_chars * 10000 // greatest(n_words, 1) AS word_length,
    n_marks * 10000 // greatest(word_chars, 1) AS marks
  FROM counted
), hist AS (
  SELECT lang, source, metric, CASE WHEN m < 128 THEN m ELSE (m >> (length(bin(m)) - 7)) << (length(bin(m)) - 7) END AS bin, count(*) AS n
  FROM (SELECT lang, source, unnest([{names}]) AS metric,
               unnest([{", ".join(METRICS)}]) AS m FROM scored WHERE NOT base_failed) GROUP BY ALL
), {_level("qs", ["lang", "source"])}, {_level("ql", ["lang"])}, {_level("qa", [])},
limits AS (
  SELECT lang, source, metric, hi + {FENCE} * up AS top, lo - {FENCE} * down AS bottom
  FROM (SELECT g.lang, g.source, g.metric, {", ".join(f"{value(x)} AS {x}" for x in ("hi", "up", "lo", "down"))}
    FROM (SELECT DISTINCT lang, source, unnest([{names}]) AS metric FROM scored) g
    LEFT JOIN qs ON g.lang IS NOT DISTINCT FROM qs.lang AND g.source IS NOT DISTINCT FROM qs.source AND g.metric = qs.metric
    LEFT JOIN ql ON g.lang IS NOT DISTINCT FROM ql.lang AND g.metric = ql.metric
    LEFT JOIN qa ON g.metric = qa.metric)
), wide AS (
  SELECT lang, source, {", ".join(f"max(top) FILTER (WHERE metric = '{m}') AS max_{m}" for m in METRICS)},
    max(bottom) FILTER (WHERE metric = 'word_length') AS min_word_length FROM limits GROUP BY ALL
), verdicts AS (
  SELECT s.*, NOT base_failed AND coalesce({" AND ".join(f"{m} <= max_{m}" for m in METRICS)}
    AND word_length >= min_word_length, false) AS kept
  FROM scored s JOIN wide t ON s.lang IS NOT DISTINCT FROM t.lang AND s.source IS NOT DISTINCT FROM t.source
)"""


OP6_SQL = f"WITH {rules_sql()} SELECT doc_id, {', '.join(COUNTS)}, base_failed, kept FROM verdicts"
