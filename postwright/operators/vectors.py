"""Embeddings: validation, texts to encode, exact and approximate neighbours."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from postwright.functions.session import cut_off

#: Queries that are sent out at once: 32 MB of 256 float64.
QUERY_BLOCK = 16384
#: Queries and vectors of one matrix product: 16 MB of scores.
ASKED, SLICE = 256, 8192
#: Vectors that the centres of the approximate search are fitted on, and the most centres: 2 MB of 256 float64.
FIT_ROWS = 50_000
MAX_CELLS = 1024


def is_valid(v: Column, dim: int) -> Column:
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return v.isNotNull() & (F.size(v) == dim) & ~bad


def norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(v, F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))


def unit(v: Column) -> Column:
    """The vector at length one; null for the zero vector."""
    n = norm(v)
    return F.when(n > 0, F.transform(v, lambda x: x.cast("double") / n))


def cosine(a: Column, b: Column) -> Column:
    dot = F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)
    return dot / (norm(a) * norm(b))


def version_stamp(strategy: str, model: str, revision: str, dim: int, normalised: bool) -> Column:
    return F.lit(f"{strategy}:{model}:{revision}:{dim}:{str(normalised).lower()}")


def pending(ledger: DataFrame, vectors: DataFrame, model: str, version: str, again: bool = False) -> DataFrame:
    """Jobs that succeeded in the run and whose vector is missing or of another model or version."""
    j = ledger.where("status = 'success'").select("job_id").distinct().join(vectors.select("job_id", "model", "version", "embedding"), "job_id", "left")
    stale = F.col("embedding").isNull() | ~F.col("model").eqNullSafe(F.lit(model)) | ~F.col("version").eqNullSafe(F.lit(version))
    return (j if again else j.where(stale)).select("job_id")


def with_skill_list(jobs: DataFrame, job_skills: DataFrame) -> DataFrame:
    """``jobs`` with the sorted list of their skills, empty where there are none."""
    lists = job_skills.groupBy("job_id").agg(F.sort_array(F.collect_set("canonical")).alias("skills"))
    return jobs.join(lists, "job_id", "left").withColumn("skills", F.coalesce("skills", F.expr("cast(array() as array<string>)")))


def job_text(title: Column, level: Column, skills: Column, domains: Column, contract: Column, mode: Column, description: Column, limit: int = 1500) -> Column:
    """Labelled lines of a job; absent fields have no line, and the description doesn't repeat the title."""
    d = F.regexp_replace(F.trim(F.coalesce(description, F.lit(""))), r"\s+", " ")
    d = F.trim(F.when(F.startswith(F.lower(d), F.lower(title)), F.substring(d, F.char_length(title) + 1, F.char_length(d))).otherwise(d))
    line = lambda label, v: F.when(v.isNotNull() & (v != ""), F.concat(F.lit(f"{label}: "), v))
    return F.concat_ws(
        "\n",
        line("Title", title),
        line("Career level", F.when(level != "unknown", level)),
        line("Skills", F.array_join(skills, ", ")),
        line("Domain", F.array_join(domains, ", ")),
        line("Contract", contract),
        line("Work mode", mode),
        line("Description", F.substring(d, 1, limit)),
    )


def cv_text(level: Column, skills: Column, domains: Column, languages: Column, databases: Column, education: Column, experience: Column) -> Column:
    line = lambda label, v: F.when(v.isNotNull() & (v != ""), F.concat(F.lit(f"{label}: "), v))
    listed = lambda v: F.array_join(v, ", ")
    return F.concat_ws(
        "\n", line("Career level", F.when(level != "unknown", level)), line("Skills", listed(skills)), line("Domains", listed(domains)),
        line("Programming languages", listed(languages)), line("Databases", listed(databases)), line("Education", education), line("Experience", F.array_join(experience, "; ")),
    )


def hashed_words(texts: list[str], dim: int = 384) -> np.ndarray:
    """The default encoder: signed hashed bag of words, at length one (the zero vector for a blank text)."""
    import zlib

    out = np.zeros((len(texts), dim), dtype=np.float32)
    for row, text in zip(out, texts, strict=True):
        for word in text.lower().split():
            h = zlib.crc32(word.encode("utf-8", "surrogatepass"))
            row[h % dim] += 1.0 if h & 0x80000000 else -1.0
    n = np.linalg.norm(out, axis=1, keepdims=True)
    return out / np.where(n > 0, n, 1)


def encode(rows: DataFrame, encoder: Callable[[list[str]], np.ndarray] = hashed_words, batch: int = 64) -> DataFrame:
    """``(job_id, embedding, error)``: a batch whose encoder fails becomes error rows and the others go on."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            for k in range(0, len(pdf), batch):
                cut = pdf.iloc[k : k + batch]
                try:
                    v, error = list(encoder(cut["text"].fillna("").tolist())), None
                except Exception as e:  # noqa: BLE001  any failure of a batch is its own
                    v, error = [None] * len(cut), f"{type(e).__name__}: {e}"
                yield pd.DataFrame({"job_id": cut["job_id"].values, "embedding": v, "error": error})

    return rows.select("job_id", "text").mapInPandas(run, "job_id bigint, embedding array<float>, error string")


def nearest(queries: DataFrame, vectors: DataFrame, k: int, query_id: str = "query_id", vector_id: str = "vec_id", column: str = "embedding") -> DataFrame:
    """Exact neighbours ``(query_id, vec_id, score, rank)`` by cosine; ties go to the smaller id.

    Queries go out in blocks of about QUERY_BLOCK as one matrix, and a block's answers
    are written before the next goes out: the driver holds one block. Vectors are dealt to all
    tasks, however few files they come in. A task takes them in slices, one matrix product for
    ASKED queries each, and sorts those scores only that may be among the ``k`` best so far; a window merges
    the tasks' best. All vectors meet all queries, as an exact search must; nothing but the best leaves a
    task. Score is 1 - distance within 0 and 1. Zero vectors and queries match nothing.
    """
    blocks = max(1, -(-queries.count() // QUERY_BLOCK))
    tasks = vectors.sparkSession.sparkContext.defaultParallelism
    vectors = vectors.select(vector_id, column).repartition(tasks)
    if blocks > 1:
        queries, vectors = cut_off(queries.select(query_id, column)), cut_off(vectors)
    out: DataFrame | None = None
    for b in range(blocks):
        block = queries if blocks == 1 else queries.where(F.pmod(F.xxhash64(query_id), F.lit(blocks)) == b)
        rows = [r for r in block.select(query_id, column).collect() if r[1] is not None and any(r[1])]
        found = _block(rows, vectors, k, query_id, vector_id, column)
        best = Window.partitionBy(query_id).orderBy(F.col("similarity").desc(), vector_id)
        found = found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
        found = found if blocks == 1 else cut_off(found)
        out = found if out is None else out.union(found)
    assert out is not None
    score = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("similarity")))
    return out.select(query_id, vector_id, score.alias("score"), "rank")


def _block(rows: list, vectors: DataFrame, k: int, query_id: str, vector_id: str, column: str) -> DataFrame:
    keys = np.array([r[0] for r in rows], dtype=np.int64)
    q = np.array([r[1] for r in rows], dtype=np.float64).reshape(len(rows), -1)
    q = q / np.linalg.norm(q, axis=1, keepdims=True) if len(rows) else q
    asked, slice_ = ASKED, SLICE

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        none = np.empty(0), np.empty(0, dtype=np.int64), np.empty(0, dtype=np.int64)
        kept = {at: none for at in range(0, len(keys), asked)}  # scores, ids and numbers of their queries, in order of these, best first
        for pdf in parts:
            pdf = pdf[[x is not None and len(x) == q.shape[1] for x in pdf[column]]] if len(keys) else pdf.iloc[:0]
            for start in range(0, len(pdf), slice_):
                cut = pdf.iloc[start : start + slice_]
                v = np.stack(cut[column].to_numpy()).astype(np.float64)
                n = np.linalg.norm(v, axis=1)
                v, own = v[n > 0] / n[n > 0, None], cut[vector_id].to_numpy()[n > 0]
                for at in kept:
                    kept[at] = _merged(kept[at], q[at : at + asked] @ v.T, own, k)
        for at, (scores, ids, numbers) in kept.items():
            yield pd.DataFrame({query_id: keys[at + numbers], vector_id: ids, "similarity": scores})

    return vectors.mapInPandas(run, f"{query_id} bigint, {vector_id} bigint, similarity double")


def _merged(kept: tuple[np.ndarray, np.ndarray, np.ndarray], scores: np.ndarray, own: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The ``k`` best ``(scores, ids, numbers)`` of each query among those kept and a matrix of new scores.

    Scores count to 12 digits. What lies below a query's k-th best, kept or new, is never sorted.
    """
    s, ids, numbers = kept
    bound = np.full(len(scores), -np.inf)
    held = np.bincount(numbers, minlength=len(scores))
    full = held >= k
    bound[full] = s[np.cumsum(held)[full] - 1]
    if not full.all() and scores.shape[1] >= k:
        bound[~full] = -np.partition(-scores[~full], k - 1, axis=1)[:, k - 1]
    row, at = np.nonzero(~(scores < (bound - 1e-12)[:, None]))  # what isn't a number stays, and sorts last
    s, ids, numbers = np.concatenate([s, np.round(scores[row, at], 12)]), np.concatenate([ids, own[at]]), np.concatenate([numbers, row])
    order = np.lexsort((ids, -s, numbers))
    s, ids, numbers = s[order], ids[order], numbers[order]
    best = np.arange(len(numbers)) - np.searchsorted(numbers, numbers) < k
    return s[best], ids[best], numbers[best]


def approximate_nearest(
    queries: DataFrame, vectors: DataFrame, k: int, probes: float = 0.15, query_id: str = "query_id", vector_id: str = "vec_id", column: str = "embedding", seed: int = 7, block: int = 4096
) -> DataFrame:
    """Neighbours ``(query_id, vec_id, score, rank)`` among the vectors of the cells nearest to the query.

    Cells are those of k-means centres, about the square root of the rows and MAX_CELLS at
    most, fitted on about FIT_ROWS vectors; every vector lies in one cell and a
    query visits the share ``probes`` of the cells, two at least. A cell's vectors and its queries
    are dealt in blocks of ``block``, so that a cell with most of the rows is
    spread over many tasks, and a block gives the ``k`` best of its queries. Zero
    and null vectors, and those of another size than most, match nothing.
    """
    rows = vectors.where(norm(F.col(column)) > 0).select(F.col(vector_id).alias("id"), F.col(column).cast("array<float>").alias("v"))
    asked = queries.where(norm(F.col(column)) > 0).select(F.col(query_id).alias("id"), F.col(column).cast("array<float>").alias("v"))
    centres = _centres(rows, seed)
    visits = max(2, math.ceil(probes * len(centres)))
    base = cut_off(_cells(rows, centres, 1))
    asked = cut_off(_cells(asked, centres, visits))
    split = lambda d, name: d.groupBy("cell").agg(F.ceil(F.count("*") / block).cast("int").alias(name))
    grid = F.broadcast(split(base, "rows").join(split(asked, "asks"), "cell"))  # a row a cell
    deal = lambda n: F.pmod(F.xxhash64("id"), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    left = asked.join(grid, "cell").select("cell", deal("asks").alias("i"), every("rows").alias("j"), "id", "v")
    right = base.join(grid, "cell").select("cell", every("asks").alias("i"), deal("rows").alias("j"), "id", "v")

    def best_of(ours: pd.DataFrame, theirs: pd.DataFrame) -> pd.DataFrame:
        if not len(ours) or not len(theirs):
            return pd.DataFrame({"q": [], "x": [], "score": []})
        q, own = _units(ours["v"]), theirs["id"].to_numpy()
        s = np.round(q @ _units(theirs["v"]).T, 12)
        top = np.lexsort((np.broadcast_to(own, s.shape), -s), axis=1)[:, :k]
        return pd.DataFrame({"q": np.repeat(ours["id"].to_numpy(), top.shape[1]), "x": own[top].ravel(), "score": np.take_along_axis(s, top, 1).ravel()})

    by = ["cell", "i", "j"]
    near = left.groupBy(*by).cogroup(right.groupBy(*by)).applyInPandas(best_of, "q bigint, x bigint, score double")
    best = Window.partitionBy("q").orderBy(F.col("score").desc(), "x")
    near = near.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    return near.select(F.col("q").alias(query_id), F.col("x").alias(vector_id), F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("score"))).alias("score"), "rank")


def _centres(rows: DataFrame, seed: int) -> np.ndarray:
    """Centres of k-means over a sample by hash of the id: about FIT_ROWS rows, whatever the table."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    n = rows.count()
    if not n:
        return np.zeros((1, 1))
    dim = rows.groupBy(F.size("v").alias("d")).count().orderBy(F.col("count").desc(), "d").first()["d"]
    share = max(1, n // FIT_ROWS)
    part = rows.where((F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(share)) == 0) & (F.size("v") == dim))
    part = cut_off(part.select(array_to_vector(unit(F.col("v"))).alias("features")))
    cells = max(2, min(MAX_CELLS, round(n**0.5)))
    model = KMeans(k=cells, seed=seed, maxIter=10, distanceMeasure="cosine").fit(part)
    return np.array(model.clusterCenters())


def _cells(rows: DataFrame, centres: np.ndarray, visits: int) -> DataFrame:
    """``rows`` once for each of their ``visits`` nearest cells."""
    dim, visits = centres.shape[1], min(visits, len(centres))

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            pdf = pdf[pdf["v"].map(len) == dim]
            if not len(pdf):
                continue
            s = _units(pdf["v"]) @ centres.T
            near = np.argsort(-s, axis=1, kind="stable")[:, :visits]
            at = np.repeat(np.arange(len(pdf)), visits)
            yield pd.DataFrame({"cell": near.ravel(), "id": pdf["id"].to_numpy()[at], "v": pdf["v"].to_numpy()[at]})

    return rows.mapInPandas(run, "cell int, id bigint, v array<float>")


def _units(column: pd.Series) -> np.ndarray:
    v = np.stack(column.to_numpy()).astype(np.float64)
    return v / np.linalg.norm(v, axis=1, keepdims=True)


def mode_filter(mode: str, title: Column, description: Column) -> Column:
    both = F.concat_ws(" ", title, description)
    # What each work mode is found by.
    terms = {"remote": ["%remote%", "%télétravail%", "%teletravail%"], "hybrid": ["%hybrid%"], "on_site": ["%on-site%", "%on site%", "%présentiel%"]}[mode]
    out = F.lit(False)
    for t in terms:
        out = out | both.ilike(t)
    return out


def coverage(jobs: DataFrame, vectors: DataFrame) -> DataFrame:
    have = vectors.where("embedding is not null").select("job_id", F.lit(1).alias("has")).dropDuplicates(["job_id"])
    return jobs.join(have, "job_id", "left").agg(F.count("*").alias("jobs"), F.count("has").alias("embedded"))
