"""Product quantisation of vectors by exact k-means over integers (operator 13).

Each part of a vector gets the nearest entry of the part's codebook, and the codebooks are
trained over all vectors. After the first round most parts keep their entry, and
distance bounds in the manner of Drake and Hamerly tell which: a part holds its ``b`` closest
entries in order, a lower bound on the distance of every later entry after each of them, and
so one outer bound on all the others. When entries move, bounds fall by how far they moved.
An assigned entry strictly nearer than a bound needs no more than the entries before that bound;
these are compared by their integer distances, so ties and near ties are exact. ``b`` follows what the
last round needed, for each part position.

Vectors lie in blocks of rows, with their bounds, in the shared folder; a round reads one
such table, writes the next one and deletes the one before. The driver holds codebooks and tallies,
whose size doesn't depend on the number of vectors.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from postwright.llm.common import materialize, remove, stage_path, table

PARTS, ENTRIES, ROUNDS = 8, 16, 6
SCALE = 4096
#: Integer components saturate here, so that squared distances and their sums stay in 64 bits.
LARGEST = 1 << 26
#: Vectors in a block row.
BLOCK = 1 << 14
#: The share of parts that may need more entries than they hold.
BEYOND = 1 / 16
#: Label sums are broadcast up to so many labels and joined by label and salt beyond.
BROADCAST_ROWS = 100_000
SALTS = 64
#: Relative slack of distances in floating point; bounds are drawn in by it.
SLACK = 1e-12


def integer_vectors(vectors: DataFrame, id_col: str = "vec_id", vector: str = "embedding", label: str = "label") -> DataFrame:
    """``(id, label, x)`` of the vectors without null and non-finite components, ``x`` being ``floor(4096 * component)``."""
    v = F.col(f"`{vector}`")
    finite = F.forall(v, lambda c: F.coalesce((F.abs(c.cast("double")) < float("inf")) & ~F.isnan(c.cast("double")), F.lit(False)))
    limit = F.lit(float(LARGEST))
    x = F.transform(v, lambda c: F.floor(F.greatest(F.least(c.cast("double") * SCALE, limit), -limit)).cast("int"))
    return vectors.where(v.isNotNull()).where(finite).select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{label}`").alias("label"), x.alias("x"))


def squared(x: np.ndarray, entries: np.ndarray) -> np.ndarray:
    """Integer squared distances of each row of ``x`` to each of its entries (rows, entries, components)."""
    return np.square(x[:, None, :] - entries).sum(axis=2)


def assign(x: np.ndarray, book: np.ndarray, near: np.ndarray | None, low: np.ndarray | None, drift: np.ndarray, held: int) -> tuple[np.ndarray, ...]:
    """``(near, low, distance, needed)`` of one part of all vectors in a block.

    ``near[:, 0]`` is the assigned entry; every entry after rank ``z`` is at least ``low[:, z]`` away.
    ``needed`` is how many entries were compared: 1 where the bounds left no other. ``held`` is the new ``b``.
    """
    n, k = len(x), len(book)
    held = min(held, k)
    if near is None:
        near, low, best = np.zeros((n, 0), np.uint8), np.zeros((n, 0)), np.zeros(n, np.int64)
        needed = np.full(n, k + 1)
    else:
        low = low.astype(np.float64)
        moved = np.append(drift, 0.0)[np.minimum(near, k)]
        low[:, -1] -= drift.max(initial=0.0)
        for z in range(low.shape[1] - 2, -1, -1):
            low[:, z] = np.minimum(low[:, z] - moved[:, z + 1], low[:, z + 1])
        low -= SLACK * np.abs(low)
        best = squared(x, book[near[:, 0]][:, None, :])[:, 0]
        sure = (np.sqrt(best) * (1 + SLACK))[:, None] < low
        needed = np.where(sure.any(axis=1), sure.argmax(axis=1) + 1, k + 1)
    width = max(held, near.shape[1])
    # a row's list may be shorter than the table's: no rank beyond it is ever reached, its bound is the last one's
    near = np.pad(near, ((0, 0), (0, width - near.shape[1])), constant_values=255)
    low = np.pad(low, ((0, 0), (0, width - low.shape[1])), mode="edge") if low.shape[1] else np.zeros((n, width))
    for z in np.unique(needed[(needed > 1) & (needed <= k)]):
        at = np.flatnonzero(needed == z)
        d = squared(x[at], book[near[at, :z]])
        order = np.lexsort((near[at, :z], d), axis=1)
        d = np.take_along_axis(d, order, axis=1)
        near[at[:, None], np.arange(z)] = np.take_along_axis(near[at, :z], order, axis=1)
        low[at[:, None], np.arange(z - 1)] = np.minimum(np.sqrt(d[:, 1:]) * (1 - SLACK), low[at, z - 1][:, None])
        best[at] = d[:, 0]
    at = np.flatnonzero(needed > k)
    if len(at):
        d = squared(x[at], book[None, :, :])
        order = np.argsort(d, axis=1, kind="stable")
        d = np.take_along_axis(d, order, axis=1)
        top = min(width, k)
        near[at, :top] = order[:, :top]
        bound = np.concatenate((np.sqrt(d[:, 1:]) * (1 - SLACK), np.full((len(at), 1), np.inf)), axis=1)
        low[at, :top] = bound[:, :top]
        low[at, top:] = bound[:, top - 1 : top]
        best[at] = d[:, 0]
    return near[:, :held], np.nextafter(low[:, :held].astype(np.float32), np.float32(-np.inf)), best, np.minimum(needed, k)


def next_held(needed: np.ndarray, held: int) -> int:
    """The next ``b``, half the entries at most, after a round's counts of compared entries (``needed[z]`` parts compared ``z``)."""
    total = needed.sum()
    over = total - np.cumsum(needed)
    return max(1, min((len(needed) - 1) // 2, int(np.flatnonzero(over <= BEYOND * total)[0]))) if total else held


class Books:
    """The codebooks of all parts, how far their entries moved last, and how many entries each part holds."""

    def __init__(self, entries: np.ndarray, drift: np.ndarray, held: list[int]):
        self.entries, self.drift, self.held = entries, drift, held

    def moved(self, sums: np.ndarray, counts: np.ndarray, needed: np.ndarray) -> Books:
        new = np.where(counts[..., None] > 0, sums // np.maximum(counts, 1)[..., None], self.entries)
        drift = np.sqrt(np.square(new - self.entries).sum(axis=2)) * (1 + SLACK)
        return Books(new, drift, [next_held(z, b) for z, b in zip(needed, self.held, strict=True)])

    def sha256(self) -> str:
        return hashlib.sha256(",".join(map(str, self.entries.ravel().tolist())).encode()).hexdigest()


def _blocks(vectors: DataFrame, size: int) -> DataFrame:
    """Rows of up to ``BLOCK`` vectors; a vector of another length than ``size`` isn't one of these."""
    kind = vectors.schema["label"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, BLOCK):
                b = batch.slice(at, BLOCK)
                n, flat = b.num_rows, b.column(2).flatten().to_numpy(zero_copy_only=False)
                x = flat.astype(np.int16 if n and np.abs(flat).max(initial=0) < 1 << 15 else np.int32)
                lists = [pa.ListArray.from_arrays(pa.array([0, n], pa.int32()), b.column(k)) for k in (0, 1)]
                yield pa.RecordBatch.from_arrays([*lists, pa.array([x.itemsize], pa.int32()), pa.array([x.tobytes()], pa.binary())], ["ids", "labels", "bytes", "x"])

    return vectors.where(F.size("x") == size).select("id", "label", "x").mapInArrow(run, f"ids array<bigint>, labels array<{kind}>, bytes int, x binary")


def _opened(batch: pa.RecordBatch, k: int, width: int) -> tuple[np.ndarray, np.ndarray | None, np.ndarray | None]:
    """Integer parts ``(vector, part, component)`` of a block row, and its bounds if it has any."""
    row = {name: batch.column(name)[k].as_py() for name in batch.schema.names if name not in ("ids", "labels")}
    x = np.frombuffer(row["x"], dtype=f"<i{row['bytes']}")
    n = len(batch.column("ids")[k])
    x = np.pad(x.reshape(n, -1), ((0, 0), (0, PARTS * width - x.size // max(n, 1)))).reshape(n, PARTS, width).astype(np.int64)
    if row.get("near") is None:
        return x, None, None
    return x, np.frombuffer(row["near"], np.uint8).reshape(n, PARTS, -1), np.frombuffer(row["low"], "<f4").reshape(n, PARTS, -1)


def _parts(x, near, low, books: Books) -> list[tuple[np.ndarray, ...]]:
    return [
        assign(x[:, p], books.entries[p], None if near is None else near[:, p], None if low is None else low[:, p], books.drift[p], books.held[p])
        for p in range(PARTS)
    ]


def _round(blocks: DataFrame, books: Books) -> DataFrame:
    """The blocks with the bounds after a round, and its tally: sums, counts and compared entries by part and entry."""
    k, width = books.entries.shape[1:]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["ids", "labels", "bytes", "x", "near", "low", "tally"]
        wide = max(books.held)
        for batch in batches:
            for j in range(batch.num_rows):
                x, near, low = _opened(batch, j, width)
                got = _parts(x, near, low, books)
                sums, counts, needed = np.zeros((PARTS, k, width), np.int64), np.zeros((PARTS, k), np.int64), np.zeros((PARTS, k + 1), np.int64)
                for p, (rank, _, _, compared) in enumerate(got):
                    np.add.at(sums[p], rank[:, 0], x[:, p])
                    counts[p] = np.bincount(rank[:, 0], minlength=k)
                    if near is not None:  # the first round says nothing about bounds
                        needed[p] = np.bincount(compared, minlength=k + 1)
                ranks = np.stack([np.pad(r, ((0, 0), (0, wide - r.shape[1])), constant_values=255) for r, *_ in got], axis=1)
                lows = np.stack([np.pad(v, ((0, 0), (0, wide - v.shape[1])), mode="edge") for _, v, *_ in got], axis=1)
                tally = np.concatenate((sums.ravel(), counts.ravel(), needed.ravel()))
                kept = [batch.column(name).slice(j, 1) for name in names[:4]]
                yield pa.RecordBatch.from_arrays(
                    [*kept, pa.array([ranks.tobytes()], pa.binary()), pa.array([lows.astype("<f4").tobytes()], pa.binary()), pa.array([tally], pa.list_(pa.int64()))], names
                )

    kind = blocks.schema["labels"].dataType.simpleString()
    return blocks.mapInArrow(run, f"ids array<bigint>, labels {kind}, bytes int, x binary, near binary, low binary, tally array<bigint>")


def train(vectors: DataFrame, rounds: int = ROUNDS, entries: int = ENTRIES) -> tuple[DataFrame, Books] | None:
    """Blocks with their bounds, and the codebooks after ``rounds`` rounds over all of ``vectors``; None without vectors.

    ``vectors`` are of ``integer_vectors``. The codebooks begin as the vectors of the smallest ids
    (null ids last, then by components). Their first one's length is the length of all: others
    are left out, and zeros fill the last part where 8 doesn't divide it.
    """
    spark = vectors.sparkSession
    order = [F.col("id").asc_nulls_last(), F.col("x")]
    one = vectors.orderBy(*order).limit(1).collect()
    if not one:
        return None
    size = len(one[0]["x"])
    first = vectors.where(F.size("x") == size).orderBy(*order).limit(entries).collect()
    width = max(1, -(-size // PARTS))
    start = np.array([list(r["x"]) + [0] * (PARTS * width - size) for r in first], dtype=np.int64)
    k = len(start)
    books = Books(start.reshape(k, PARTS, width).transpose(1, 0, 2), np.zeros((PARTS, k)), [max(1, k // 4)] * PARTS)
    path, blocks = None, _blocks(vectors, size)
    for _ in range(rounds):
        new = f"{stage_path(spark)}/{uuid.uuid4().hex}"
        done = _round(blocks, books)
        done.write.parquet(new)
        blocks = spark.read.schema(done.schema).parquet(new)
        tally = np.zeros(PARTS * (k * width + 2 * k + 1), dtype=np.int64)
        for r in blocks.select(F.posexplode("tally").alias("at", "v")).groupBy("at").agg(F.sum("v").alias("v")).collect():
            tally[r["at"]] = r["v"]
        a, b = PARTS * k * width, PARTS * k * (width + 1)
        books = books.moved(tally[:a].reshape(PARTS, k, width), tally[a:b].reshape(PARTS, k), tally[b:].reshape(PARTS, k + 1))
        if path:
            remove(spark, path)
        path = new
    return blocks, books


def codes(blocks: DataFrame, books: Books) -> DataFrame:
    """``(vec_id, label, code, error)``: each vector's entries as two hex digits a part, and its squared error."""
    width = books.entries.shape[2]
    kind = blocks.schema["labels"].dataType.elementType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for j in range(batch.num_rows):
                got = _parts(*_opened(batch, j, width), books)
                ranks, error = np.stack([r[:, 0] for r, *_ in got], axis=1), sum(d for _, _, d, _ in got)
                text = np.ascontiguousarray(ranks).tobytes().hex()
                code = [text[a : a + 2 * PARTS] for a in range(0, len(text), 2 * PARTS)]
                yield pa.RecordBatch.from_arrays([batch.column("ids")[j].values, batch.column("labels")[j].values, pa.array(code, pa.string()), pa.array(error, pa.int64())], ["vec_id", "label", "code", "error"])

    return blocks.drop("tally").mapInArrow(run, f"vec_id bigint, label {kind}, code string, error bigint")


def vector_codes(vectors: DataFrame, id_col: str = "vec_id", vector: str = "embedding", label: str = "label", rounds: int = ROUNDS, entries: int = ENTRIES) -> DataFrame:
    """``(vec_id, label, code, error, label_error, codebooks_sha256)`` of every vector that is kept.

    Null vectors and those with a null or non-finite component go; null ids are coded like
    others and null labels are one label. Repeated rows are vectors of their own; ties go to the entry
    of the lower index. Components beyond 16,384 in size saturate. An empty table gives no row; extra columns don't matter.
    """
    trained = train(integer_vectors(vectors, id_col, vector, label), rounds, entries)
    if trained is None:
        kind = vectors.schema[label].dataType.simpleString()
        return vectors.sparkSession.createDataFrame([], f"vec_id bigint, label {kind}, code string, error bigint, label_error bigint, codebooks_sha256 string")
    blocks, books = trained
    rows = materialize(codes(blocks, books))
    sums = rows.groupBy(F.col("label").alias("of")).agg(F.try_sum("error").alias("label_error"))
    same = F.col("label").eqNullSafe(F.col("of"))
    if sums.count() <= BROADCAST_ROWS:
        joined = rows.join(F.broadcast(sums), same)
    else:  # a label may have a third of the rows: they meet its sum in SALTS tasks
        salted = sums.withColumn("to", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        joined = rows.withColumn("salt", F.pmod(F.xxhash64("vec_id", "code"), F.lit(SALTS)).cast("int")).join(salted, same & (F.col("salt") == F.col("to")))
    return joined.select("vec_id", "label", "code", "error", "label_error", F.lit(books.sha256()).alias("codebooks_sha256"))


def op13_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_codes(table(spark, sf_dir, "embeddings")).drop("label")


def _sql() -> str:
    steps = []
    for r in range(ROUNDS + 1):
        steps.append(f"""a{r} AS MATERIALIZED (
  SELECT vec_id, x.p, any_value(x.x) AS x, min(list_sum(list_transform(list_zip(x.x, b.x), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) * {ENTRIES} + e) AS m
  FROM parts x JOIN b{r} b ON x.p = b.p GROUP BY vec_id, x.p)""")
        if r < ROUNDS:
            steps.append(f"""b{r + 1} AS MATERIALIZED (
  SELECT b.p, b.e, coalesce(n.x, b.x) AS x FROM b{r} b LEFT JOIN (
    SELECT p, e, list(CAST((s - ((s % c) + c) % c) // c AS BIGINT) ORDER BY i) AS x FROM (
      SELECT p, m % {ENTRIES} AS e, i, CAST(sum(x[i]) AS BIGINT) AS s, count(*) AS c FROM a{r}, range(1, (SELECT w + 1 FROM width)) AS t(i) GROUP BY ALL)
    GROUP BY p, e) n ON b.p = n.p AND b.e = n.e)""")
    return f"""
WITH kept AS MATERIALIZED (
  SELECT vec_id, label, list_transform(embedding, lambda c: CAST(floor(CAST(c AS DOUBLE) * {SCALE}) AS BIGINT)) AS v
  FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0
), width AS (SELECT len(v) // {PARTS} AS w FROM kept ORDER BY vec_id LIMIT 1),
parts AS MATERIALIZED (SELECT vec_id, p, v[p * w + 1 : (p + 1) * w] AS x FROM kept, width, range({PARTS}) AS t(p)),
b0 AS MATERIALIZED (
  SELECT p, e, x FROM (SELECT p, x, row_number() OVER (PARTITION BY p ORDER BY vec_id) - 1 AS e FROM parts) WHERE e < {ENTRIES}
), {", ".join(steps)},
books AS (SELECT sha256(string_agg(v, ',' ORDER BY p, e, i)) AS h FROM (SELECT p, e, CAST(unnest(x) AS VARCHAR) AS v, generate_subscripts(x, 1) AS i FROM b{ROUNDS})),
coded AS (
  SELECT vec_id, string_agg(printf('%02x', CAST(m % {ENTRIES} AS INTEGER)), '' ORDER BY p) AS code, CAST(sum(m // {ENTRIES}) AS BIGINT) AS error
  FROM a{ROUNDS} GROUP BY vec_id)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, (SELECT h FROM books) AS codebooks_sha256
FROM kept JOIN coded USING (vec_id)
"""


OP13_SQL = _sql()
