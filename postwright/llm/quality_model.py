"""Quality classifier: ordinal cumulative-link regression on hashed text (operator 8).

P(grade >= k) = sigmoid(w x - t_k), with one weight vector for all grades and
ordered thresholds t_1 < t_2 < ...
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from postwright.llm.common import materialize, table
from postwright.llm.toxicity import held_out

#: Hashed weights.
DIM = 1 << 16
#: The bound of the sample that is fitted: labelled rows, by hash of their id.
FIT_ROWS = 20_000
STEPS = 120
RATE = 0.15
RIDGE = 1e-4
#: Documents whose chance of a grade of at least SELECT_GRADE is so high are selected.
SELECT_GRADE = 1
SELECT_CHANCE = 0.5

SHAPES = [(re.compile(r"[^\W\d_]*[a-zß-ÿ][^\W\d_]*"), "a"), (re.compile(r"[^\W\d_]+"), "A"), (re.compile(r"\d+"), "9"), (re.compile(r"([^\w])\1+"), r"\1")]
CACHE = 400_000


def _slot(name: str) -> int:
    return zlib.crc32(name.encode("utf-8", "surrogatepass")) % DIM


def _shape(word: str) -> str:
    for pattern, to in SHAPES:
        word = pattern.sub(to, word)
    return word


def features(text: str, cache: dict[str, tuple[int, int]]) -> tuple[np.ndarray, np.ndarray]:
    """Slots and values of a whole text: its words, their shapes, and what repeats in it.

    Words and shapes each have length one; the shares of distinct words, of
    repeated lines and of repeated word pairs, and the length, are steps.
    """
    tokens = text.split()
    n = len(tokens)
    if not n:
        return np.array([_slot("empty")], dtype=np.int32), np.ones(1, dtype=np.float32)
    words: list[int] = []
    values: list[float] = []
    shapes: Counter = Counter()
    counts = Counter(tokens)
    for word, k in counts.items():
        known = cache.get(word)
        if known is None:
            if len(cache) >= CACHE:
                cache.clear()
            known = cache[word] = (_slot("w:" + word.lower()), _slot("s:" + _shape(word)))
        words.append(known[0])
        values.append(k)
        shapes[known[1]] += k
    v = np.log1p(np.array(values, dtype=np.float32))
    v /= np.sqrt((v * v).sum())
    s = np.array(list(shapes.values()), dtype=np.float32) / n
    lines = [x for x in text.split("\n") if x.strip()]
    pairs = len(set(zip(tokens, tokens[1:], strict=False))) / max(n - 1, 1)
    steps = [
        f"distinct:{int(10 * len(counts) / n)}",
        f"pairs:{int(10 * pairs)}",
        f"lines:{int(10 * len(set(lines)) / max(len(lines), 1))}",
        f"length:{n.bit_length()}",
        f"width:{int(8 * math.log2(len(text) / n))}",
        "bias",
    ]
    slots = np.concatenate([np.array(words, dtype=np.int32), np.array(list(shapes), dtype=np.int32), np.array([_slot(x) for x in steps], dtype=np.int32)])
    return slots, np.concatenate([v, s, np.full(len(steps), 0.5, dtype=np.float32)])


def _cuts(t: np.ndarray) -> np.ndarray:
    """Ordered thresholds of a first one and the logarithms of the gaps."""
    return np.cumsum(np.concatenate([t[:1], np.exp(t[1:])]))


def likelihood(w: np.ndarray, t: np.ndarray, y: np.ndarray, of: np.ndarray, slot: np.ndarray, value: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
    """Mean log-likelihood less the ridge, and its gradients by the weights and by ``t``.

    Row ``of[i]`` has ``value[i]`` in slot ``slot[i]``; ``y`` are the grades.
    """
    cuts, n = _cuts(t), len(y)
    f = np.bincount(of, value * w[slot], n)
    tail = 1 / (1 + np.exp(-np.clip(f[:, None] - cuts[None, :], -30, 30)))  # P(y >= k), k = 1..
    full = np.concatenate([np.ones((n, 1)), tail, np.zeros((n, 1))], axis=1)
    at = np.arange(n)
    p = np.maximum(full[at, y] - full[at, y + 1], 1e-9)
    d = full * (1 - full)  # derivatives of the tails by f
    by_f = (d[at, y] - d[at, y + 1]) / p
    by_cut = np.array([((d[:, k] / p) * ((y == k - 1).astype(float) - (y == k))).sum() for k in range(1, len(cuts) + 1)])
    down = by_cut[::-1].cumsum()[::-1]
    by_t = np.concatenate([down[:1], down[1:] * np.exp(t[1:])]) / n
    return float(np.log(p).mean() - RIDGE * (w * w).sum() / 2), np.bincount(slot, value * by_f[of], len(w)) / n - RIDGE * w, by_t


def fit(rows: list[tuple[int, np.ndarray, np.ndarray]], grades: int) -> tuple[np.ndarray, np.ndarray]:
    """Weights and ordered thresholds of the cumulative-link model, by Adam on the whole sample.

    Thresholds are a first one and logarithms of the gaps, so they can't cross.
    """
    w, t = np.zeros(DIM), np.zeros(max(grades - 1, 1))
    if not rows or grades < 2:
        return w, _cuts(t)
    y = np.array([r[0] for r in rows])
    of = np.repeat(np.arange(len(rows)), [len(r[1]) for r in rows])
    slot, value = np.concatenate([r[1] for r in rows]), np.concatenate([r[2] for r in rows]).astype(np.float64)
    m = [np.zeros(DIM), np.zeros(len(t))]
    q = [np.zeros(DIM), np.zeros(len(t))]
    for step in range(1, STEPS + 1):
        _, *grads = likelihood(w, t, y, of, slot, value)
        for x, g, a, b in zip([w, t], grads, m, q, strict=True):
            a *= 0.9
            a += 0.1 * g
            b *= 0.999
            b += 0.001 * g * g
            x += RATE * (a / (1 - 0.9**step)) / (np.sqrt(b / (1 - 0.999**step)) + 1e-8)
    return w, _cuts(t)


def graded(labels: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """``(doc_id, grade)``: 0 of no quality, 1 of quality but toxic, 2 of quality and clean."""
    grade = F.when(F.col("quality") == 0, 0).when(F.coalesce("toxic", F.lit(0)) == 1, 1).otherwise(2)
    known = labels.where(F.col("quality").isNotNull()).select(F.col(f"`{id_col}`").alias("doc_id"), grade.alias("grade"))
    return known.dropna().groupBy("doc_id").agg(F.min("grade").cast("int").alias("grade"))


def train(docs: DataFrame, grades: DataFrame, n_grades: int = 3, rows: int = FIT_ROWS, id_col: str = "doc_id", text: str = "text") -> tuple[np.ndarray, np.ndarray]:
    """The model, fitted in one task on about ``rows`` graded documents that aren't held out (crc32 of the id modulo 5 is 0).

    The sample is what its ids' hashes select, the same at every run; it is small enough to broadcast and for one task.
    """
    known = grades.select("doc_id", "grade").dropna().where(~held_out(F.col("doc_id")))
    share = min(1.0, rows / max(1, known.count()))
    sample = F.broadcast(known.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < int(share * (1 << 30))))
    t = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text"))

    def extract(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        cache: dict[str, tuple[int, int]] = {}
        for pdf in batches:
            got = [features(x, cache) for x in pdf["text"]]
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "grade": pdf["grade"], "slots": [a for a, _ in got], "v": [b for _, b in got]})

    def fitted(pdf):
        pdf = pdf.sort_values("doc_id", kind="stable")  # sums in one order
        w, cuts = fit(list(zip(pdf["grade"], pdf["slots"], pdf["v"], strict=True)), n_grades)
        return pd.DataFrame({"w": [w.astype(np.float32).tobytes()], "cuts": [cuts.tolist()]})

    rows_ = t.join(sample, "doc_id").mapInPandas(extract, "doc_id bigint, grade int, slots array<int>, v array<float>").withColumn("all", F.lit(1))
    model = rows_.groupBy("all").applyInPandas(fitted, "w binary, cuts array<double>").collect()
    if not model:
        return np.zeros(DIM, dtype=np.float32), np.arange(n_grades - 1, dtype=float)
    return np.frombuffer(model[0]["w"], dtype=np.float32), np.array(model[0]["cuts"])


def score(docs: DataFrame, model: tuple[np.ndarray, np.ndarray], id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """``(doc_id, expected_grade, tails)``: ``tails[k - 1]`` is the chance of grade ``k`` or more."""
    w, cuts = model

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        cache: dict[str, tuple[int, int]] = {}
        for pdf in batches:
            f = np.empty(len(pdf))
            for k, x in enumerate(pdf["text"]):
                slots, v = features(x, cache)
                f[k] = float((w[slots] * v).sum(dtype=np.float64))
            tails = 1 / (1 + np.exp(-np.clip(f[:, None] - cuts[None, :], -30, 30)))
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "expected_grade": tails.sum(axis=1), "tails": list(tails)})

    t = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text"))
    return t.mapInPandas(run, "doc_id bigint, expected_grade double, tails array<double>")


def quality_classifier(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Expected grade and tail chances of every row of ``docs``, and what they select.

    Null and empty texts are scored by the feature that marks them. Without
    labels all weights are zero. Repeated rows score alike; labels of unknown
    documents and rows without a label don't count.
    """
    model = train(docs, materialize(graded(labels)))
    return score(docs, model).select(
        "doc_id",
        "expected_grade",
        F.element_at("tails", 1).alias("p_grade_1"),
        F.element_at("tails", 2).alias("p_grade_2"),
        (F.element_at("tails", SELECT_GRADE) >= SELECT_CHANCE).alias("kept"),
    )


def op8_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_classifier(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
