"""Packing by optimal length buckets (operator 5)."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from postwright.llm.common import BLANKS, NOT_BLANK, let, materialize, table, words

#: A longer document is cut into pieces of so many tokens.
MAX_TOKENS = 8192
#: Bucket lengths are multiples of this, so the histogram has MAX_TOKENS / ALIGN bars at most.
ALIGN = 8
BUCKETS = 16
#: Tokens of a batch, padding included.
BATCH_TOKENS = 65536
#: Pieces a shard aims at; shards of a bucket grow with its pieces.
SHARD_ROWS = 20_000
BROADCAST_SHARDS = 500_000


def best_boundaries(histogram: dict[int, int], buckets: int = BUCKETS) -> list[int]:
    """Upper bounds, in units, of the ``buckets`` buckets with the least padding in all.

    ``histogram`` counts pieces by length in units. Exact dynamic programming:
    the cost of a bucket (i, j] is the padding of its pieces to j; row k holds the
    least cost of the first lengths in k buckets. The histogram has a bounded
    number of bars whatever the number of documents. Ties go to the lower bound.
    """
    lengths = np.array(sorted(histogram), dtype=np.int64)
    if not len(lengths):
        return []
    n = np.array([histogram[x] for x in lengths], dtype=np.float64)
    c = np.concatenate([[0.0], np.cumsum(n)])
    s = np.concatenate([[0.0], np.cumsum(n * lengths)])
    m = len(lengths)
    cost = (c[None, 1:] - c[:, None]) * lengths[None, :] - (s[None, 1:] - s[:, None])  # cost[i, j]: bars i..j
    cost[np.arange(m + 1)[:, None] > np.arange(m)[None, :]] = np.inf
    best = cost[0].copy()
    back = [np.zeros(m, dtype=np.int64)]
    for _ in range(1, min(buckets, m)):
        total = np.concatenate([[np.inf], best[:-1]])[:, None] + cost[:m]
        start = np.argmin(total, axis=0)
        value = total[start, np.arange(m)]
        keep = value < best
        back.append(np.where(keep, start, -1))
        best = np.where(keep, value, best)
    out, j, k = [], m - 1, len(back) - 1
    while j >= 0:
        while k > 0 and back[k][j] < 0:
            k -= 1
        out.append(int(lengths[j]))
        j = int(back[k][j]) - 1
        k = max(k - 1, 0)
    return out[::-1]


def pieces(docs: DataFrame, id_col: str = "doc_id", text: str = "text", max_tokens: int = MAX_TOKENS) -> DataFrame:
    """``(__row, doc_id, piece, first_token, n_tokens)``: each document in pieces of ``max_tokens`` at most.

    A document without words, null included, has no piece: there is nothing to train on.
    """
    n = F.size(words(F.col(f"`{text}`")))
    at = lambda k: F.struct(
        k.cast("int").alias("piece"),
        (k * max_tokens).cast("long").alias("first_token"),
    )
    cut = let(n, lambda w: F.when(w > 0, F.transform(F.sequence(F.lit(0), F.floor((w - 1) / max_tokens).cast("int")), lambda k: F.struct(at(k).alias("at"), F.least(w - k * max_tokens, F.lit(max_tokens)).cast("long").alias("n_tokens")))))
    return docs.select(
        F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("__row"),
        F.col(f"`{id_col}`").alias("doc_id"),
        F.explode(cut).alias("cut"),
    ).select("__row", "doc_id", "cut.at.*", "cut.n_tokens")


def _units(align: int) -> Column:
    return F.ceil(F.col("n_tokens") / align).cast("int")


def pack(
    cut: DataFrame,
    sizes: DataFrame,
    buckets: int = BUCKETS,
    align: int = ALIGN,
    max_tokens: int = MAX_TOKENS,
    batch_tokens: int = BATCH_TOKENS,
) -> DataFrame:
    """``cut`` (from ``pieces``) with ``bucket_len``, ``batch_id`` and ``slot``.

    ``sizes`` is a written ``(doc_id, piece, n_tokens)`` of the same pieces.
    All pieces of a batch are padded to one bucket length; a batch has
    ``batch_tokens`` tokens at most, padding included (one piece at least), and
    only the last of a bucket is short. Pieces are numbered inside a bucket by
    shard: counts of the shards give each its first number and a window numbers
    the pieces of one shard, so a hot bucket is many shards and no task sees
    a whole bucket. Equal pieces (repeated rows) get slots of their own.
    """
    bars = {r["u"]: r["n"] for r in sizes.groupBy(_units(align).alias("u")).agg(F.count("*").alias("n")).collect()}
    bounds = best_boundaries(bars, buckets)
    if not bounds:
        return cut.select("*", F.lit(0).alias("bucket_len"), F.lit(0).cast("long").alias("batch_id"), F.lit(0).alias("slot")).where(F.lit(False))
    which = np.searchsorted(bounds, np.arange(max(bounds) + 1)).tolist()  # by length in units
    filled = np.zeros(len(bounds), dtype=np.int64)
    for u, n in bars.items():
        filled[which[u]] += n
    shards = [int(-(-n // SHARD_ROWS)) for n in filled]
    room = [max(1, batch_tokens // (b * align)) for b in bounds]
    pick = lambda values, i: F.element_at(F.lit(values), (i + 1).cast("int"))

    def dealt(df: DataFrame) -> DataFrame:
        df = df.withColumn("bucket", pick(which, _units(align)))
        own = F.pmod(F.xxhash64(F.coalesce("doc_id", F.lit(0)), "piece", "n_tokens"), F.greatest(pick(shards, F.col("bucket")), F.lit(1)))
        return df.withColumn("shard", own.cast("int"))

    counts = dealt(sizes).groupBy("bucket", "shard").agg(F.count("*").alias("n"))
    before = Window.partitionBy("bucket").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    firsts = counts.select(
        F.col("bucket").alias("__b"), F.col("shard").alias("__s"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first")
    )
    if sum(shards) <= BROADCAST_SHARDS:
        firsts = F.broadcast(firsts)
    in_shard = Window.partitionBy("bucket", "shard").orderBy("n_tokens", "doc_id", "piece")
    numbered = dealt(cut).withColumn("__r", F.row_number().over(in_shard) - 1)
    numbered = numbered.join(firsts, (F.col("bucket") == F.col("__b")) & (F.col("shard") == F.col("__s")))
    rank = F.col("first") + F.col("__r")
    size = pick(room, F.col("bucket"))
    return numbered.select(
        *cut.columns,
        (pick([int(b) for b in bounds], F.col("bucket")) * align).cast("int").alias("bucket_len"),
        (F.col("bucket").cast("long") * F.lit(1 << 44) + F.floor(rank / size)).alias("batch_id"),
        F.pmod(rank, size).cast("int").alias("slot"),
    )


def packed(docs: DataFrame, id_col: str = "doc_id", text: str = "text", **how) -> DataFrame:
    """Pieces of all documents with their batch and ``text``: a piece runs from its first word to its last.

    Blanks and line feeds within a piece are those of the text, whatever its
    length; those before the first and after the last word of a document stay
    with its outer pieces, and the run of blanks at a cut is left out.
    Null and blank texts have no piece; repeated rows have pieces of their own;
    an empty table gives an empty table.
    """
    cut = pieces(docs, id_col, text, how.get("max_tokens", MAX_TOKENS))
    sizes = materialize(cut.select("doc_id", "piece", "n_tokens"))
    out = pack(cut, sizes, **how)
    own = F.col(f"__row.`{text}`")
    with_blanks = F.regexp_extract_all(own, F.lit(f"{NOT_BLANK}+(?:{BLANKS})?"), F.lit(0))
    first, n = F.col("first_token").cast("int"), F.col("n_tokens").cast("int")

    def between(ws: Column) -> Column:
        run = F.array_join(F.slice(ws, first + 1, n), "")
        return F.when(first + n < F.size(ws), F.regexp_replace(run, f"{BLANKS}$", "")).otherwise(run)

    part = let(with_blanks, between)
    lead = F.when(F.col("piece") == 0, F.regexp_extract(own, f"^{BLANKS}", 0)).otherwise("")
    whole = (F.col("piece") == 0) & (F.col("n_tokens") < how.get("max_tokens", MAX_TOKENS))
    part = F.when(whole, own).otherwise(F.concat(lead, part))  # the same text, without a cut where there is nothing to cut
    return out.select("doc_id", "piece", "first_token", "n_tokens", "bucket_len", "batch_id", "slot", part.alias("text"))


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = materialize(pieces(table(spark, sf_dir, "documents")).drop("__row"))
    return pack(cut, cut)
