"""Curation of evaluation sets: duplicates, leakage, gates, scores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from postwright.functions.session import cut_off
from postwright.operators.audit import sample_key

#: Of the overlap that a link needs, the part that near duplicates are to share among their first shingles.
SIEVE = 8
#: Ids that are broadcast; more are joined by shuffle.
BROADCAST_IDS = 1_000_000
#: Classes that meet under one shingle are dealt in blocks of so many.
BLOCK = 1024


def inventory(files: DataFrame) -> DataFrame:
    """Files and bytes by dataset (folder) and extension; ``files`` is a ``binaryFile`` read or has ``path`` and ``length``."""
    parts = F.split("path", "/")
    name = F.element_at(parts, -1)
    return files.groupBy(
        F.element_at(parts, -2).alias("dataset"), F.lower(F.regexp_extract(name, r"\.([^.]+)$", 1)).alias("extension")
    ).agg(F.count("*").alias("files"), F.sum("length").alias("bytes"))


def text_key(text: Column) -> Column:
    """What normalised duplicates agree in: lower case, blanks collapsed."""
    return F.trim(F.regexp_replace(F.lower(text), r"\s+", " "))


def duplicate_groups(docs: DataFrame, key: Column, id_col: str = "doc_id") -> DataFrame:
    """``(key, first_id, copies)`` of the keys that several rows have; counted before rows are dealt out."""
    return docs.groupBy(F.sha2(key.cast("binary"), 256).alias("key")).agg(F.min(id_col).alias("first_id"), F.count("*").alias("copies")).where("copies > 1")


def leakage(items: DataFrame, group: str = "item", split: str = "split") -> DataFrame:
    """Items or duplicate groups that are in several splits."""
    return items.groupBy(group).agg(F.count_distinct(split).alias("splits"), F.array_join(F.sort_array(F.collect_set(split)), ",").alias("in_splits")).where("splits > 1")


def unannotated(items: DataFrame, annotations: DataFrame, on: str = "item") -> DataFrame:
    return items.join(annotations.select(on), on, "left_anti")


def gate_failures(metrics: DataFrame, thresholds: DataFrame) -> DataFrame:
    """Metrics under their threshold, and thresholds without a metric."""
    rows = thresholds.join(metrics, "metric", "left")
    return rows.where(F.col("value").isNull() | (F.col("value") < F.col("threshold"))).select("metric", "value", "threshold")


def balanced_selection(docs: DataFrame, duplicates: DataFrame, quotas: dict[str, int], domain: str, id_col: str, seed: str) -> DataFrame:
    """For each domain the quotas of the splits, in hash order, without the duplicates."""
    rows = docs.join(duplicates.select(id_col), id_col, "left_anti")
    place = F.row_number().over(Window.partitionBy(domain).orderBy(sample_key(seed, F.col(id_col)), id_col))
    split, total = None, 0
    for name, n in quotas.items():
        cond = place <= total + n
        split = F.when(cond, name) if split is None else split.when(cond, name)
        total += n
    return rows.withColumn("split", split).where("split is not null")


def confusion(rows: DataFrame, expected: str = "expected", actual: str = "actual") -> DataFrame:
    return rows.groupBy(expected, actual).agg(F.count("*").alias("n"))


def set_scores(rows: DataFrame, expected: str = "expected", actual: str = "actual") -> DataFrame:
    """``rows`` with precision, recall and F1 of their two sets; both empty is a full score."""
    tp = F.size(F.array_intersect(expected, actual))
    ne, na = F.size(F.array_distinct(expected)), F.size(F.array_distinct(actual))
    part = lambda a, b: F.when(b > 0, a / b).when(ne + na == 0, 1.0).otherwise(0.0)
    out = rows.withColumn("tp", tp).withColumn("precision", part(tp, na)).withColumn("recall", part(tp, ne))
    f1 = F.when(F.col("precision") + F.col("recall") > 0, 2 * F.col("precision") * F.col("recall") / (F.col("precision") + F.col("recall"))).otherwise(0.0)
    return out.withColumn("f1", f1)


def score_summary(rows: DataFrame, expected: str = "expected", actual: str = "actual") -> DataFrame:
    """Micro and macro averages of ``set_scores``."""
    s = set_scores(rows, expected, actual)
    tp, na, ne = F.sum("tp"), F.sum(F.size(F.array_distinct(actual))), F.sum(F.size(F.array_distinct(expected)))
    return s.agg(
        F.count("*").alias("items"),
        (tp / F.nullif(na, F.lit(0))).alias("micro_precision"),
        (tp / F.nullif(ne, F.lit(0))).alias("micro_recall"),
        (2 * tp / F.nullif(na + ne, F.lit(0))).alias("micro_f1"),
        F.avg("precision").alias("macro_precision"),
        F.avg("recall").alias("macro_recall"),
        F.avg("f1").alias("macro_f1"),
    )


def set_errors(rows: DataFrame, id_col: str, expected: str = "expected", actual: str = "actual") -> DataFrame:
    """A row for each skill that is missing or too many."""
    lost = rows.select(id_col, F.explode(F.array_except(expected, actual)).alias("skill"), F.lit("missing").alias("direction"))
    return lost.union(rows.select(id_col, F.explode(F.array_except(actual, expected)).alias("skill"), F.lit("extra").alias("direction")))


EMAIL = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}"
PHONE = r"\+?[0-9][0-9 ().-]{6,}[0-9]"
URL = r"https?://[^\s]+"
ADDRESS = r"[0-9]{1,4},? (?:rue|avenue|boulevard|street|road|strasse|calle) [A-Za-z]+"


def pii_queue(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """Counts of what looks personal in each document and what to do; no matched text leaves."""
    t = F.coalesce(F.col(text), F.lit(""))
    n = {k: F.regexp_count(t, F.lit(p)) for k, p in (("emails", EMAIL), ("phones", PHONE), ("urls", URL), ("addresses", ADDRESS))}
    rows = docs.select(id_col, *[v.alias(k) for k, v in n.items()])
    return rows.withColumn(
        "action",
        F.when(F.col("emails") + F.col("phones") + F.col("addresses") >= 3, "remove").when(F.col("emails") + F.col("phones") + F.col("addresses") > 0, "redact").when(F.col("urls") > 0, "review").otherwise("keep"),
    )


def near_duplicate_groups(docs: DataFrame, words: int = 5, threshold: float = 0.8, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """``(doc_id, group_id)`` of the texts that links lead to another from: exact, by Jaccard of word shingles of at least ``threshold``.

    Texts of one shingle set are a class. Of a set of ``n``, a link needs an overlap of ``need(n)``, and in any one order of
    shingles two sets that link share ``k`` of their first ``n - need(n) + k``, with the ``k`` of the smaller one. In the order of hashes,
    classes that don't meet as many others there are dropped. For the rest shingles are ordered by frequency. Each class is
    compared with the first one of a prefix shingle that it shares most with, which joins large groups of near copies; classes
    that are still apart and share ``k`` of their prefixes are all compared.
    """
    w = F.array_remove(F.split(text_key(F.coalesce(F.col("text"), F.lit(""))), " "), "")
    shingle = F.transform(F.slice("w", 1, F.greatest(F.size("w") - (words - 1), F.lit(1))), lambda x, i: F.xxhash64(x, *[F.get("w", i + k) for k in range(1, words)]))
    with_set = lambda rows: rows.withColumn("w", w).withColumn("s", F.sort_array(F.array_distinct(shingle))).select("doc_id", F.xxhash64("s").alias("class"), F.size("s").alias("n"), "s")
    need = lambda n: F.greatest(F.lit(1), F.ceil(n * threshold - 1e-9).cast("int"))
    share = lambda n: F.greatest(F.lit(1), F.floor(need(n) / SIEVE).cast("int"))
    first = F.col("n") - need(F.col("n")) + share(F.col("n"))
    texts = docs.select(F.col(id_col).alias("doc_id"), F.col(text).alias("text"))
    # the first shingles are all that is kept of a text; sets are made again where a class has met enough others
    signed = cut_off(with_set(texts).select("doc_id", "class", "n", F.slice("s", F.lit(1), first).alias("least"))).where("n > 0")
    met = _with_frequency(signed.select("class", F.explode("least").alias("x")).repartition("x").distinct()).groupBy("class").agg(F.count("*").alias("met"))
    heads = signed.groupBy("class").agg(F.min("doc_id").alias("head"), F.max("n").alias("n"))
    left = cut_off(met.join(heads, "class").where(F.col("met") >= share(need(F.col("n")))).select("class", "head"))
    few = (lambda ids: F.broadcast(ids)) if left.count() <= BROADCAST_IDS else lambda ids: ids
    own = with_set(texts.join(few(left.select("head").distinct()), F.col("doc_id").eqNullSafe(F.col("head")), "left_semi"))
    sets = cut_off(own.join(few(left.select("class")), "class", "left_semi").select("class", "n", "s").dropDuplicates(["class"]))

    met = _with_frequency(sets.select("class", F.explode("s").alias("x")).repartition("x"))
    common = met.groupBy("class").agg(F.transform(F.sort_array(F.collect_list(F.struct("df", "x"))), lambda e: e["x"]).alias("common"))
    depth = first - (F.col("n") - F.size("common"))  # shingles of one class alone come first in the order
    sets = cut_off(sets.select("class", "n").join(common, "class").withColumn("depth", depth).where(F.col("depth") >= share(need(F.col("n")))))
    meet = cut_off(sets.select("class", "n", F.explode(F.slice("common", F.lit(1), F.col("depth"))).alias("x")))
    enough = lambda rows: rows.groupBy("a", "b").agg(F.count("*").alias("times"), F.first(F.least("n", "m")).alias("n")).where(F.col("times") >= share(F.col("n")))

    centres = meet.groupBy("x").agg(F.min(F.struct("class", F.col("n").alias("m"))).alias("c"), F.count("*").alias("df")).where("df > 1").select("x", "c.m", F.col("c.class").alias("b"))
    led = enough(meet.join(centres, "x").where("class <> b").withColumnRenamed("class", "a")).groupBy("a").agg(F.max_by("b", F.struct("times", "b")).alias("b"))
    links = cut_off(_near(led, sets, threshold))
    rest = enough(_apart(meet, _connected(links)))
    links = links.union(_near(rest.select("a", "b"), sets, threshold))

    label = signed.select("doc_id", "class").join(_connected(links), "class", "left").select("doc_id", F.coalesce("root", "class").alias("root"))
    size = label.groupBy("root").agg(F.min("doc_id").alias("group_id"), F.count("*").alias("n")).where("n > 1")
    return label.join(size, "root").select("doc_id", "group_id")


def _with_frequency(each: DataFrame) -> DataFrame:
    """``(x, class, df)`` of the values that several classes have; ``each`` is dealt by ``x`` and stays where it is."""
    return each.join(each.groupBy("x").agg(F.count("class").alias("df")).where("df > 1"), "x")


def _apart(meet: DataFrame, groups: DataFrame) -> DataFrame:
    """``(a, b, n, m)``, a row for each value that two classes of different groups share, with their sizes.

    Of each value the classes outside its largest group are dealt in blocks, and each block meets all classes of
    the value: a large group costs a row a member and block.
    """
    marked = meet.join(groups, "class", "left").withColumn("root", F.coalesce("root", "class"))
    roots = marked.groupBy("x", "root").agg(F.count("*").alias("c")).groupBy("x").agg(F.sum("c").alias("m"), F.max(F.struct("c", "root")).alias("most"), F.count("*").alias("roots")).where("roots > 1")
    blocks = F.ceil((F.col("m") - F.col("most.c")) / BLOCK).cast("int")
    marked = cut_off(marked.join(roots.select("x", F.col("most.root").alias("most"), blocks.alias("blocks")), "x"))
    outside = F.col("root") != F.col("most")
    one = marked.where(outside).select("x", F.pmod(F.xxhash64("class"), "blocks").cast("int").alias("block"), F.col("class").alias("a"), "n", F.col("root").alias("ra"))
    all_ = marked.select("x", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), F.col("class").alias("b"), F.col("n").alias("m"), F.col("root").alias("rb"), outside.alias("twice"))
    return one.join(all_, ["x", "block"]).where("ra <> rb and (a < b or not twice)").select("a", "b", "n", "m")


def _near(pairs: DataFrame, sets: DataFrame, threshold: float) -> DataFrame:
    """The pairs ``(class, first)`` whose sets reach the threshold."""
    side = lambda c, d: sets.select(F.col("class").alias(c), F.col("n").alias(f"n{d}"), F.col("common").alias(f"s{d}"))
    both = pairs.join(side("a", 0), "a").join(side("b", 1), "b").withColumn("o", F.size(F.array_intersect("s0", "s1")))
    return both.where(F.col("o") >= threshold * (F.col("n0") + F.col("n1") - F.col("o"))).select(F.col("a").alias("class"), F.col("b").alias("first"))


def _connected(links: DataFrame) -> DataFrame:
    """``(class, root)`` by smallest labels along links, until none changes; each round is cut off by a checkpoint."""
    both = cut_off(links.toDF("a", "b").union(links.select("first", "class")).distinct())
    label = both.select(F.col("a").alias("class"), F.col("a").alias("root")).distinct()
    while True:
        near = both.join(label, both["b"] == label["class"]).groupBy("a").agg(F.min("root").alias("m"))
        new = cut_off(label.join(near, label["class"] == near["a"]).select("class", F.least("root", "m").alias("root"), (F.col("m") < F.col("root")).alias("moved")))
        label = new.select("class", "root")
        if new.where("moved").isEmpty():
            return label
