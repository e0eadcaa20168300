"""Bottom-k sketches of shingle hashes (operator 4), with DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from postwright.llm.common import ascii_lower, let, shingle_hashes, table, words

SHINGLE_WORDS = 5
#: Hashes kept a sketch: a likeness of one half has a standard error of 0.044.
K = 128
#: Rows a cell of the doc_id line aims at; the number of cells grows with the table, up to MAX_CELLS.
CELL_ROWS = 4000
#: Bounds of cells go to the driver and back, and heads of cells are broadcast: two MB at most.
MAX_CELLS = 1 << 15


def sketch(text: Column, k: int = K, n: int = SHINGLE_WORDS) -> Column:
    """Sorted array of the ``k`` smallest distinct shingle hashes of the whole text.

    All of them where the text has fewer than ``k``; null and blank texts give an
    empty array. Equal texts give equal arrays.
    """
    all_hashes = shingle_hashes(words(ascii_lower(F.coalesce(text, F.lit("")))), n)
    return F.slice(F.sort_array(F.array_distinct(all_hashes)), 1, k)


def merge(a: Column, b: Column, k: int = K) -> Column:
    """Sketch of the union of what two sketches stand for."""
    return F.slice(F.sort_array(F.array_union(a, b)), 1, k)


def resemblance(a: Column, b: Column, k: int = K) -> Column:
    """Estimated Jaccard resemblance, exact while both sides together have at most ``k`` hashes.

    Two empty sketches are alike (1.0); an empty and another aren't (0.0).
    """
    return let(
        merge(a, b, k),
        lambda u: F.when(F.size(u) == 0, F.lit(1.0)).otherwise(
            F.size(F.array_intersect(F.array_intersect(u, a), b)) / F.size(u)
        ),
    )


def distinct_shingles(a: Column, k: int = K) -> Column:
    """Estimated number of distinct shingles; exact below ``k``."""
    share = (F.element_at(a, -1).cast("double") + F.lit(2.0**63)) / F.lit(2.0**64)
    return F.when(F.size(a) < k, F.size(a).cast("double")).otherwise(F.lit(float(k - 1)) / share)


def containment(a: Column, b: Column, k: int = K) -> Column:
    """Estimated share of ``a``'s shingles that ``b`` has: 1.0 for an empty ``a``, 1.0 at most."""
    shared = resemblance(a, b, k) * distinct_shingles(merge(a, b, k), k)
    return F.when(F.size(a) == 0, F.lit(1.0)).otherwise(F.least(F.lit(1.0), shared / distinct_shingles(a, k)))


def merge_sketches(df: DataFrame, by: list[str], sketch_col: str = "sketch", k: int = K) -> DataFrame:
    """One sketch for each value of ``by``: that of all the parts' texts together.

    Hashes are made distinct and cut to ``k`` a task before they are dealt by
    ``by``, so a hot value sends ``k`` rows a task and no more.
    """
    hashes = df.select(*by, F.explode(sketch_col).alias("__h")).dropDuplicates([*by, "__h"])
    ranked = hashes.withColumn("__r", F.row_number().over(Window.partitionBy(*by).orderBy("__h"))).where(F.col("__r") <= k)
    return ranked.groupBy(*by).agg(F.sort_array(F.collect_list("__h")).alias(sketch_col))


def as_text(a: Column) -> Column:
    """A sketch as a string: its hashes in hexadecimal, a comma between."""
    return F.array_join(F.transform(a, lambda h: F.hex(h)), ",")


def from_text(s: Column) -> Column:
    """The sketch that ``as_text`` wrote."""
    return F.transform(
        F.filter(F.split(s, ","), lambda x: x != ""), lambda x: F.conv(x, 16, -10).cast("long")
    )


def with_next(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, text, next_text)``: each document with the next by descending id, the first after the last.

    The line of ids is cut at their quantiles into cells of equal size, however
    the ids lie; each cell also gets a copy of the first document of the next
    one, and a window in the cell looks one row ahead: one shuffle of the texts
    and no global order. Rows of the same id follow each other by the hash of
    their text and by text; null ids come last, in cells by that hash. The one
    row of a table follows itself.
    """
    d = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text"))
    n = d.agg(F.count("*").alias("n"), F.count("doc_id").alias("ids")).first()
    cells = lambda rows: min(MAX_CELLS, max(1, -(-rows // CELL_ROWS)))
    parts = cells(n["ids"])
    cuts = d.agg(F.percentile_approx("doc_id", [k / parts for k in range(1, parts)] or [0.5], 10 * parts)).first()[0] or []
    # nulls below all others: a later hash, a later cell
    late = F.floor((F.lit(2.0**63) - F.xxhash64("text")) / F.lit(2.0**64) * cells(n["n"] - n["ids"])).cast("int")
    d = d.withColumn("cell", F.when(F.col("doc_id").isNull(), -1 - late).otherwise(_passed(F.col("doc_id"), sorted(set(cuts)))))
    key = F.struct(F.col("doc_id").isNotNull().alias("k"), F.coalesce("doc_id", F.lit(0)).alias("i"), F.xxhash64("text").alias("x"))
    heads = d.groupBy("cell").agg(F.max(key).alias("head"))
    # a line of 2 * MAX_CELLS rows at most
    line = Window.orderBy(F.col("cell").desc())
    last = Window.partitionBy(F.lit(0))
    heads = heads.select("head", F.coalesce(F.lag("cell").over(line), F.min("cell").over(last)).alias("to_cell"))
    copies = (
        d.withColumn("key", key)
        .join(F.broadcast(heads), F.col("key") == F.col("head"))
        .select("doc_id", "text", F.col("to_cell").alias("cell"), "key", F.lit(True).alias("copy"))
    )
    # of texts that share the head's id and hash the first counts
    copies = copies.groupBy("cell", "key").agg(F.min("doc_id").alias("doc_id"), F.min("text").alias("text"), F.first("copy").alias("copy"))
    own = d.select("doc_id", "text", "cell", key.alias("key"), F.lit(False).alias("copy"))
    ahead = Window.partitionBy("cell").orderBy("copy", F.col("key").desc(), "text")
    return (
        own.unionByName(copies)
        .withColumn("next_text", F.lead("text").over(ahead))
        .where(~F.col("copy"))
        .select("doc_id", "text", "next_text")
    )


def _passed(x: Column, cuts: list[int]) -> Column:
    """How many of the sorted ``cuts`` are less than ``x``, by halving."""
    if not cuts:
        return F.lit(0)
    held = F.split(F.lit(",".join(map(str, cuts))), ",").cast("array<bigint>")
    bounds = F.struct(F.lit(0).alias("lo"), F.lit(len(cuts)).alias("hi"))
    mid = lambda b: F.floor((b["lo"] + b["hi"]) / 2).cast("int")

    def half(b: Column, _: Column) -> Column:
        less = F.get(held, mid(b)) < x
        done = b["lo"] >= b["hi"]
        return F.struct(
            F.when(done | ~less, b["lo"]).otherwise(mid(b) + 1).alias("lo"),
            F.when(done | less, b["hi"]).otherwise(mid(b)).alias("hi"),
        )

    steps = F.sequence(F.lit(1), F.lit(len(cuts).bit_length()))
    return F.aggregate(steps, bounds, half, lambda b: b["lo"])


def edited_pairs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = K) -> DataFrame:
    """Sketches of each text, of its edited text and of the next text.

    The edited text has the last third of the code points (floor) replaced by
    as many first ones of the next document, or all that it has.
    """
    third = F.floor(F.char_length("text") / 3).cast("int")
    cut = (F.char_length("text") - third).cast("int")
    edited = F.concat(F.substring("text", F.lit(1), cut), F.substring("next_text", F.lit(1), third))
    d = with_next(docs, id_col, text_col).withColumn("edited", edited)
    return d.select(
        "doc_id",
        F.char_length("text").cast("long").alias("n_chars"),
        F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"),
        sketch(F.col("text"), k).alias("sketch"),
        sketch(F.col("edited"), k).alias("edited_sketch"),
        sketch(F.col("next_text"), k).alias("next_sketch"),
    )


def op4_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = edited_pairs(table(spark, sf_dir, "documents"))
    a, e = F.col("sketch"), F.col("edited_sketch")
    return s.select(
        "doc_id",
        "n_chars",
        "edited_sha256",
        as_text(a).alias("fingerprint"),
        as_text(e).alias("edited_fingerprint"),
        resemblance(a, e).alias("near_edited"),
        resemblance(a, F.col("next_sketch")).alias("near_next"),
        F.round(distinct_shingles(a)).cast("long").alias("distinct_shingles"),
        containment(a, e).alias("contained_in_edited"),
    )
