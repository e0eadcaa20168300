"""Mixing sources to target weights by iterative proportional fitting (operator 3), with DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from postwright.llm.common import BLANKS, let, materialize, table, words

#: Sweeps over the three marginals; at 20 the largest marginal error of the given tables is under 1e-9.
SWEEPS = 20
#: Targets are the shares of tokens to this power, normalised: 1 leaves the mix, 0 makes it even.
FLATTEN = 0.5
#: Share of all tokens that the sample has in expectation.
BUDGET = 0.5
AXES = ["source", "lang", "topic"]
#: Cells are categories, not documents; so many of them are broadcast, more are joined by shuffle.
BROADCAST_CELLS = 200_000


def token_count(text: Column) -> Column:
    return F.size(words(text)).cast("long")


def layout_topic(text: Column) -> Column:
    """A topic by what the whole text looks like: empty, symbols, verse (short lines), long, short or prose."""
    t = F.coalesce(text, F.lit(""))
    symbols = F.regexp_count(t, F.lit("[#*$%&|<>]"))
    lines = F.regexp_count(t, F.lit("\n")) + 1
    return let(
        F.struct(F.size(words(t)).alias("w"), symbols.alias("s"), lines.alias("l")),
        lambda x: F.when(x["w"] == 0, "empty")
        .when(x["s"] * 2 > x["w"], "symbols")
        .when(x["l"] * 12 > x["w"], "verse")
        .when(x["w"] >= 1000, "long")
        .when(x["w"] < 100, "short")
        .otherwise("prose"),
    )


def rake(cells: DataFrame, targets: dict[str, DataFrame] | None = None, sweeps: int = SWEEPS) -> DataFrame:
    """``cells`` (the axes and ``tokens``) with ``weight``, raked to the target of each axis in turn.

    ``targets[axis]`` has the axis and ``share``; where it's missing, the
    flattened token share of the axis is the target. Categories without tokens
    have no cell and get no weight; null is a category. Each sweep is written
    to the shared folder, so plans stay short.
    """
    w = cells.withColumn("total", F.sum("tokens").over(Window.partitionBy(F.lit(0)))).withColumn("weight", F.col("tokens").cast("double"))
    for axis in AXES:
        if targets and axis in targets:
            t = targets[axis].select(F.col(axis).alias("__axis"), F.col("share").cast("double").alias(f"t_{axis}"))
            w = w.join(F.broadcast(t), w[axis].eqNullSafe(F.col("__axis")), "left").drop("__axis")
            w = w.withColumn(f"t_{axis}", F.coalesce(f"t_{axis}", F.lit(0.0)))
        else:
            by = cells.groupBy(axis).agg(F.sum("tokens").alias("__n"))
            by = by.withColumn("__p", F.pow(F.col("__n").cast("double"), F.lit(FLATTEN)))
            by = by.select(F.col(axis).alias("__axis"), (F.col("__p") / F.sum("__p").over(Window.partitionBy(F.lit(0)))).alias(f"t_{axis}"))
            w = w.join(by, w[axis].eqNullSafe(F.col("__axis")), "left").drop("__axis")
    w = materialize(w)
    for _ in range(sweeps):
        for axis in AXES:
            now = F.sum("weight").over(Window.partitionBy(axis))
            w = w.withColumn("weight", F.when(now > 0, F.col("weight") * F.col(f"t_{axis}") * F.col("total") / now).otherwise(0.0))
        w = materialize(w)
    return w.select(*AXES, "tokens", "weight")


def probabilities(raked: DataFrame, budget: float = BUDGET) -> DataFrame:
    """``raked`` with ``p``: the chance of a document of the cell.

    Chances are in proportion to weight / tokens and 1 at most; the factor is
    set so that the expected tokens are ``budget`` of all, those of full cells
    included. All chances are 1 where the budget reaches the whole.
    """
    r = raked.where("tokens > 0 and weight > 0").withColumn("ratio", F.col("weight") / F.col("tokens"))
    everything = Window.partitionBy(F.lit(0))
    before = everything.orderBy(F.col("ratio").desc(), *AXES).rowsBetween(Window.unboundedPreceding, -1)
    r = r.withColumn("goal", F.sum("tokens").over(everything) * F.lit(budget))
    r = r.withColumn("full", F.coalesce(F.sum("tokens").over(before), F.lit(0)))
    r = r.withColumn("rest", F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0.0)))
    r = r.withColumn("c", (F.col("goal") - F.col("full")) / F.greatest("rest", F.lit(1e-300)))
    open_ = F.col("c") * F.col("ratio") < 1
    r = r.withColumn("factor", F.max_by(F.when(open_, F.col("c")), F.when(open_, F.col("ratio"))).over(everything))
    p = F.when(F.col("factor").isNull(), F.lit(1.0)).otherwise(F.least(F.lit(1.0), F.col("factor") * F.col("ratio")))
    return r.select(*AXES, "tokens", "weight", F.greatest(F.lit(0.0), p).alias("p"))


def draw(id_col: Column, text: Column) -> Column:
    """A number in [0, 1) that depends on the document alone: 52 bits of a SHA-256."""
    key = F.concat(F.lit("mix:"), F.coalesce(id_col.cast("string"), text, F.lit("")))
    return F.conv(F.substring(F.sha2(key.cast("binary"), 256), 1, 13), 16, 10).cast("double") / F.lit(2.0**52)


def mixed(
    docs: DataFrame,
    id_col: str = "doc_id",
    text: str = "text",
    source: str = "source",
    lang: str = "lang",
    topic: Column | None = None,
    targets: dict[str, DataFrame] | None = None,
    budget: float = BUDGET,
    sweeps: int = SWEEPS,
) -> DataFrame:
    """The sampled rows of ``docs`` as ``__row``, with their cell, ``n_tokens``, ``p`` and ``sample_weight`` (1 / p).

    Token weights are raked to the three marginals; then every document is
    kept with the probability of its cell, by a hash of its id: the same rows
    whatever the partitions, and repeated ids share their fate. Documents
    without words have no tokens to weigh and are never drawn.
    """
    t = F.col(f"`{text}`")
    cut = lambda *more: docs.select(
        *more,
        F.col(f"`{source}`").alias("source"),
        F.col(f"`{lang}`").alias("lang"),
        (layout_topic(t) if topic is None else topic).alias("topic"),
        token_count(t).alias("n_tokens"),
    )
    cells = materialize(cut().groupBy(*AXES).agg(F.sum("n_tokens").alias("tokens")).where("tokens > 0"))
    p = materialize(probabilities(rake(cells, targets, sweeps), budget))
    small = p.select(*[F.col(a).alias(f"__{a}") for a in AXES], "p")
    if small.count() <= BROADCAST_CELLS:
        small = F.broadcast(small)
    rows = cut(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("__row"), draw(F.col(f"`{id_col}`"), t).alias("__u"))
    on = F.lit(True)
    for a in AXES:
        on = on & rows[a].eqNullSafe(F.col(f"__{a}"))
    return (
        rows.join(small, on)
        .where("n_tokens > 0 and __u < p")
        .select("__row", *AXES, "n_tokens", "p", (1 / F.col("p")).alias("sample_weight"))
    )


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = mixed(table(spark, sf_dir, "documents"))
    return m.select("__row.doc_id", *AXES, "n_tokens", F.round("p", 6).alias("p"), F.round("sample_weight", 4).alias("sample_weight"))


def mixing_sql(docs: str = "documents", budget: float = BUDGET) -> str:
    """CTEs up to ``sampled`` for the rows of the relation ``docs``."""
    out = f"""sized AS (
  SELECT *, CASE WHEN n_tokens = 0 THEN 'empty' WHEN s * 2 > n_tokens THEN 'symbols' WHEN l * 12 > n_tokens THEN 'verse'
    WHEN n_tokens >= 1000 THEN 'long' WHEN n_tokens < 100 THEN 'short' ELSE 'prose' END AS topic,
    CAST(('0x' || substr(sha256('mix:' || coalesce(CAST(doc_id AS VARCHAR), text, '')), 1, 13)) AS BIGINT) / 4503599627370496.0 AS u
  FROM (SELECT *, CAST(len(list_filter(regexp_split_to_array(coalesce(text, ''), '{BLANKS}'), lambda x: x <> '')) AS BIGINT) AS n_tokens,
          length(regexp_replace(coalesce(text, ''), '[^#*$%&|<>]', '', 'g')) AS s, len(string_split(coalesce(text, ''), chr(10))) AS l
        FROM {docs})
), cells AS (SELECT source, lang, topic, CAST(sum(n_tokens) AS BIGINT) AS tokens FROM sized GROUP BY ALL HAVING sum(n_tokens) > 0)"""
    for a in AXES:
        out += f""", t_{a} AS (
  SELECT {a}, pow(n, {FLATTEN}) / sum(pow(n, {FLATTEN})) OVER () AS t FROM (SELECT {a}, CAST(sum(tokens) AS DOUBLE) AS n FROM cells GROUP BY {a}))"""
    joins = " ".join(f"JOIN t_{a} ON cells.{a} IS NOT DISTINCT FROM t_{a}.{a}" for a in AXES)
    out += f""", w0 AS MATERIALIZED (SELECT cells.*, {", ".join(f"t_{a}.t AS t_{a}" for a in AXES)}, sum(tokens) OVER () AS total, CAST(tokens AS DOUBLE) AS weight FROM cells {joins})"""
    k = 0
    for _ in range(SWEEPS):
        for a in AXES:
            out += f", w{k + 1} AS MATERIALIZED (SELECT * REPLACE (weight * t_{a} * total / sum(weight) OVER (PARTITION BY {a}) AS weight) FROM w{k})"
            k += 1
    return out + f""", ordered AS (
  SELECT *, weight / tokens AS ratio, sum(tokens) OVER () * {budget} AS goal,
    coalesce(sum(tokens) OVER (ORDER BY weight / tokens DESC, source, lang, topic ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS full_,
    sum(weight) OVER () - coalesce(sum(weight) OVER (ORDER BY weight / tokens DESC, source, lang, topic ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS rest
  FROM w{k}
), chances AS (
  SELECT source, lang, topic, least(1.0, coalesce((SELECT max_by((goal - full_) / rest, ratio) FROM ordered WHERE (goal - full_) / rest * ratio < 1), 1e300) * ratio) AS p FROM ordered
), sampled AS (
  SELECT z.*, c.p FROM sized z JOIN chances c
    ON z.source IS NOT DISTINCT FROM c.source AND z.lang IS NOT DISTINCT FROM c.lang AND z.topic = c.topic
  WHERE n_tokens > 0 AND u < p)"""


OP3_SQL = f"WITH {mixing_sql()} SELECT doc_id, source, lang, topic, n_tokens, round(p, 6) AS p, round(1 / p, 4) AS sample_weight FROM sampled"
