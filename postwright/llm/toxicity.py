"""Toxic passages by maximum-scoring segments (operator 7).

1. Token log-odds of toxic against clean training documents, under a Dirichlet
   prior in proportion to how often either kind has the token.
2. A word scores the best log-odds of it and its stems, less a drift; a word that
   the lexicon doesn't know costs the drift. All maximal segments of a document come from one scan.
3. Segments get the E-value of the extreme-value law for maximal segments, with
   lambda solved for the clean tokens and K estimated from the best segments of
   the clean training documents; a document's statistic sums its significant
   segments, and a logistic curve over the training documents makes a
   probability of it.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from postwright.llm.common import materialize, table

TOKEN = re.compile(r"\w+")
#: Mass of the Dirichlet prior, in tokens.
PRIOR = 5000.0
#: Lexicon tokens are so many standard errors over zero.
MIN_Z = 2.5
#: Cost of a token besides its log-odds.
DRIFT = 0.2
#: The bound of what the model is learnt from: training documents. Its lexicon has the significant tokens of these.
TRAIN_ROWS = 200_000
#: Stems of so many letters are tokens besides the word itself: inflected forms are too rare to be learnt one by one.
STEMS = (4, 5, 6)
#: Words of which a task remembers the score.
MEMORY = 500_000
#: Segments of a smaller E-value are significant passages.
MAX_E = 0.05


def training(labels: DataFrame, label: str = "toxic", id_col: str = "doc_id", rows: int = TRAIN_ROWS) -> DataFrame:
    """``(doc_id, y)`` of the rows to learn from: crc32 of the id modulo 5 isn't 0; about ``rows`` of more, by hash.

    Rows without an id or a label don't count; an id with several labels takes the largest.
    """
    known = labels.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{label}`").cast("int").alias("y")).dropna()
    known = known.where(~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max("y").alias("y"))
    share = min(1.0, rows / max(1, known.count()))
    return known.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < int(share * (1 << 30)))


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def tokens_of(word: str) -> list[str]:
    """A word and its stems, marked as such."""
    return [word, *(word[:k] + "-" for k in STEMS if len(word) > k)]


def _token_counts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Documents of either kind that have a token, and how often clean ones use it."""
    seen: tuple[Counter, Counter, Counter] = (Counter(), Counter(), Counter())

    def flush() -> pd.DataFrame:
        found = seen[0].keys() | seen[1].keys()
        out = pd.DataFrame([(w, seen[0][w], seen[1][w], seen[2][w]) for w in found], columns=["token", "toxic", "clean", "uses"])
        for c in seen:
            c.clear()
        return out

    for pdf in batches:
        for y, text in zip(pdf["y"], pdf["text"], strict=True):
            uses: Counter = Counter()
            for word, k in Counter(TOKEN.findall(text.lower())).items():
                for token in tokens_of(word):
                    uses[token] += k
            seen[0 if y else 1].update(uses.keys())
            if not y:
                seen[2].update(uses)
        if len(seen[0]) + len(seen[1]) > 500_000:
            yield flush()
    yield flush()


def lexicon(docs: DataFrame, train: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """``(token, odds, z, background)`` of the tokens that speak significantly for toxicity; TRAIN_ROWS bounds them."""
    t = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text"))
    rows = t.join(F.broadcast(train), "doc_id").select("y", "text")  # TRAIN_ROWS bounds what is broadcast
    n = materialize(
        rows.mapInPandas(_token_counts, "token string, toxic bigint, clean bigint, uses bigint")
        .groupBy("token")
        .agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"), F.sum("uses").alias("uses"))
    )
    s = n.agg(F.sum("toxic").alias("t"), F.sum("clean").alias("c"), F.sum("uses").alias("u")).first()
    nt, nc, uses = float(s["t"] or 0), float(s["c"] or 0), float(max(s["u"] or 0, 1))
    prior = (F.col("toxic") + F.col("clean")) * F.lit(PRIOR / max(nt + nc, 1.0))
    a, b = F.col("toxic") + prior, F.col("clean") + prior
    odds = F.log(a / (F.lit(nt + PRIOR) - a)) - F.log(b / (F.lit(nc + PRIOR) - b))
    scored = n.select("token", odds.alias("odds"), (odds / F.sqrt(1 / a + 1 / b)).alias("z"), (F.col("uses") / F.lit(uses)).alias("background"))
    return scored.where((F.col("z") >= MIN_Z) & (F.col("odds") > DRIFT))


def evd_lambda(scores: list[float], background: list[float], drift: float = DRIFT) -> float:
    """The positive root of sum p exp(lambda s) = 1 over the clean tokens."""
    rest = max(1.0 - sum(background), 1e-9)
    f = lambda x: rest * math.exp(-x * drift) + sum(p * math.exp(min(x * s, 700)) for s, p in zip(scores, background, strict=True)) - 1
    # a lexicon that clean text never uses would give no root: 3 is steep enough for any use
    low, high = 1e-4, 3.0
    if f(high) < 0:
        return high
    for _ in range(60):
        mid = (low + high) / 2
        low, high = (mid, high) if f(mid) < 0 else (low, mid)
    return low


def maximal_segments(events: list[tuple[int, float]], drift: float = DRIFT) -> list[tuple[int, int, float]]:
    """All maximal scoring segments ``(first, last, score)`` of a sequence, in linear time.

    ``events`` are the positions with a score over the drift, in order; every
    other position scores ``-drift``. Segments are kept on a stack with the
    cumulative score at both ends; a new one swallows those before it as long as
    that raises its score.
    """
    # first, last, cumulative before, cumulative after, nearest earlier entry with a smaller sum before
    stack: list[tuple[int, int, float, float, int]] = []
    total, at = 0.0, 0
    for position, score in events:
        total -= drift * (position - at)
        at = position + 1
        first, low = position, total
        total += score
        high = total
        k = len(stack) - 1
        while True:
            # segments that begin no lower can't be extended: the links pass each of them once
            while k >= 0 and stack[k][2] >= low:
                k = stack[k][4]
            if k < 0 or stack[k][3] >= high:
                break
            first, low, before = stack[k][0], stack[k][2], stack[k][4]
            del stack[k:]
            k = before
        stack.append((first, position, low, high, k))
    return [(a, b, high - low) for a, b, low, high, _ in stack]


def _scorer(scores: dict[str, float]):
    """A function that gives a text's number of tokens and its maximal segments."""
    memory: dict[str, float] = {}

    def score(word: str) -> float:
        """The best score of a word's tokens; 0 if the lexicon has none of them."""
        if len(memory) >= MEMORY:
            memory.clear()
        memory[word] = best = max((scores.get(t, 0.0) for t in tokens_of(word)), default=0.0)
        return best

    def segments(text: str) -> tuple[int, list[tuple[int, int, float]]]:
        tokens = TOKEN.findall(text.lower())
        events = [(i, x) for i, w in enumerate(tokens) if (x := memory[w] if w in memory else score(w)) > 0]
        return len(tokens), maximal_segments(events)

    return segments


def statistic(n: int, found: list[tuple[int, int, float]], rate: float, k: float) -> tuple[float, list[tuple[int, int, float]]]:
    """A document's evidence, 0 without a segment, and its significant passages ``(first, end, -log E)``.

    The sum over the significant segments, less what any order of them would
    give; if none is, minus the logarithm of the best one's P-value.
    """
    if not found:
        return 0.0, []
    length = math.log(k * max(n, 2))
    by = sorted(((rate * s - length, a, b) for a, b, s in found), reverse=True)
    good = [x for x in by if x[0] >= -math.log(MAX_E)]
    value = sum(x[0] for x in good) - math.lgamma(len(good) + 1) if good else -math.log(max(-math.expm1(-math.exp(-by[0][0])), 1e-300))
    return value, [(a, b + 1, v) for v, a, b in good]


def toxic_statistics(docs: DataFrame, train: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """``(doc_id, statistic, passages)`` for every row: passages are token spans with the log of their E-value."""
    words = lexicon(docs, train, id_col, text).collect()  # the significant tokens of TRAIN_ROWS documents
    scores = {r["token"]: r["odds"] - DRIFT for r in words}
    rate = evd_lambda([r["odds"] - DRIFT for r in words], [r["background"] for r in words])
    t = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text"))

    def clean(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        segments = _scorer(scores)
        for pdf in batches:
            got = [segments(x) for x in pdf["text"]]
            yield pd.DataFrame({"e": [n * math.exp(-rate * max((s for *_, s in found), default=0.0)) for n, found in got]})

    # K n exp(-lambda M) has mean 1 over clean documents of n tokens whose best segment scores M
    e = t.join(F.broadcast(train.where("y = 0")), "doc_id").select("text").mapInPandas(clean, "e double").agg(F.sum("e").alias("e"), F.count("*").alias("n")).first()
    k = e["n"] / e["e"] if e["e"] else 1.0

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        segments = _scorer(scores)
        for pdf in batches:
            got = [statistic(*segments(x), rate, k) for x in pdf["text"]]
            yield pd.DataFrame(
                {
                    "doc_id": pdf["doc_id"],
                    "statistic": [x for x, _ in got],
                    "passages": [[{"first": a, "end": b, "log_e": -v} for a, b, v in p] for _, p in got],
                }
            )

    return t.mapInPandas(run, "doc_id bigint, statistic double, passages array<struct<first int, end int, log_e double>>")


def calibration(bars: list[tuple[float, int, int]]) -> tuple[float, float]:
    """Intercept and slope of a logistic curve over ``(statistic, toxic, clean)`` bars, by Newton's method.

    A little ridge keeps the curve finite where the bars part cleanly.
    """
    if not bars:
        return 0.0, 0.3
    x, pos, neg = (np.array(c, dtype=float) for c in zip(*bars, strict=True))
    x = x / 10
    design = np.stack([np.ones_like(x), x])
    beta = np.zeros(2)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(beta @ design, -30, 30)))
        g = design @ (pos - (pos + neg) * p) - 0.01 * beta
        h = (design * ((pos + neg) * p * (1 - p))) @ design.T + 0.01 * np.eye(2)
        step = np.linalg.solve(h, g)
        beta = beta + step
        if np.abs(step).max() < 1e-9:
            break
    return float(beta[0]), float(beta[1] / 10)


def toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """``(doc_id, held_out, score, predicted, n_passages, passages)`` for every row of ``docs``.

    Null and empty texts have no passage and score like any text without toxic
    tokens. Without labels every score is under one half. Ties and repeated
    rows score alike; a null id is never held out. Extra columns of either
    table don't matter.
    """
    train = materialize(training(labels, "toxic"))
    found = materialize(toxic_statistics(docs, train, id_col, text))
    bar = F.round(F.col("statistic") * 4) / 4  # as many bars as training documents at most
    rows = found.join(F.broadcast(train), "doc_id").groupBy(bar.alias("x")).agg(F.sum("y").alias("t"), F.sum(1 - F.col("y")).alias("c")).orderBy("x")
    a, b = calibration([(r["x"], r["t"], r["c"]) for r in rows.collect()])
    if train.isEmpty():
        a, b = -1.0, 0.0
    score = 1 / (1 + F.exp(-(F.lit(a) + F.lit(b) * F.col("statistic"))))
    return found.select(
        "doc_id",
        held_out(F.col("doc_id")).alias("held_out"),
        score.alias("score"),
        (score >= 0.5).cast("int").alias("predicted"),
        F.size("passages").alias("n_passages"),
        "passages",
    )


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
