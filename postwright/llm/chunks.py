"""Substring dedup by content-defined chunks (operator 10)."""

from __future__ import annotations

import random
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from postwright.llm.common import materialize, table, unused

#: Bytes that a cut depends on. Gear values have 2 * WINDOW bits, shifted by two a byte.
WINDOW = 16
#: A byte ends a chunk with one chance in so many; chunks have so many bytes on average.
MEAN_CHUNK = 32
#: A repeat of fewer words isn't a passage. A passage of over 50 words loses a part of a chunk
#: at both ends.
MIN_WORDS = 16

#: Owners of runs that are broadcast, 24 bytes each; more are joined by shuffle.
BROADCAST_ROWS = 500_000

#: One 32-bit value for each byte, from a fixed seed.
GEAR = np.array(random.Random(20).sample(range(1 << 32), 256), dtype=np.uint32)
RUN_SCHEMA = "doc_id bigint, start int, size int, word int, n_words int, digest bigint"


def gear_hashes(data: np.ndarray) -> np.ndarray:
    """The rolling hash at each byte: h = (h << 2) + GEAR[byte], of which the last WINDOW bytes remain.

    Computed by doubling: the hash over 2 w bytes is that over w bytes plus the
    one w bytes earlier, shifted.
    """
    h = GEAR[data]
    w = 1
    while w < WINDOW:
        h[w:] += h[:-w] << np.uint32(2 * w)
        w *= 2
    return h


def cut_points(data: np.ndarray) -> np.ndarray:
    """Ends of the chunks of a byte string; the last is its length.

    A cut depends on the WINDOW bytes before it and on nothing else, so an
    insertion changes the chunks that it touches and no others.
    """
    ends = np.flatnonzero(gear_hashes(data) < np.uint32((1 << 32) // MEAN_CHUNK)) + 1 if len(data) else np.zeros(0, dtype=np.int64)
    ends = ends[ends >= WINDOW]
    return np.append(ends, len(data)) if len(data) and (not len(ends) or ends[-1] != len(data)) else ends


def _runs(batches: Iterator[pd.DataFrame], min_words: int) -> Iterator[pd.DataFrame]:
    """The shortest runs of chunks of ``min_words`` words from each chunk on or back, with the count of words before them."""
    blanks = np.zeros(256, dtype=bool)
    blanks[[9, 10, 11, 12, 13, 32]] = True
    for pdf in batches:
        parts: list[tuple] = []
        held = 0
        for doc_id, text in zip(pdf["doc_id"], pdf["text"], strict=True):
            raw = text.encode("utf-8", "surrogatepass")
            data = np.frombuffer(raw, dtype=np.uint8)
            ends = cut_points(data)
            if not len(ends):
                continue
            # a run has the bytes that its first cut depends on as well: whoever has them has the cut
            starts = np.maximum(np.concatenate([[0], ends[:-1]]) - WINDOW, 0)
            blank = blanks[data]
            opens = ~blank
            opens[1:] &= blank[:-1]
            count = np.concatenate([[0], np.cumsum(opens)])
            # a part of a word at the start counts, so that the bytes of a run alone decide where it ends
            word = count[starts] - (~blank[starts] & ~opens[starts])
            last = np.searchsorted(count[ends], word + min_words)
            # from each chunk on, and back from each chunk where none of those ends: a passage is covered to both ends
            first = np.flatnonzero(last < len(ends))
            if not len(first):
                continue
            others = np.setdiff1d(np.arange(last[0], len(ends)), last[first])
            first, last = np.append(first, np.searchsorted(word, count[ends[others]] - min_words, side="right") - 1), np.append(last[first], others)
            starts, word, ends = starts[first], word[first], ends[last]
            n_words = count[ends] - word
            runs = np.empty(len(ends), dtype=object)
            runs[:] = [raw[a:b] for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]
            digests = pd.util.hash_array(runs, categorize=False)
            # spans hold whole characters: a rest of one at either end is the same bytes in every holder
            starts, ends = _whole(data, starts, ends)
            parts.append((np.full(len(ends), doc_id, dtype=np.int64), starts, ends - starts, word, n_words, digests.view(np.int64)))
            held += len(ends)
            if held >= 200_000:
                yield _frame(parts)
                parts, held = [], 0
        if parts:
            yield _frame(parts)


def _whole(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Spans without the parts of UTF-8 characters that they begin or end with."""
    inner = np.append((data & 0xC0) == 0x80, False)  # bytes that go on with a character
    for _ in range(3):
        starts = starts + inner[starts]
        ends = ends - inner[ends]
    return starts, ends


def _frame(parts: list[tuple]) -> pd.DataFrame:
    cols = [np.concatenate(x) for x in zip(*parts, strict=True)]
    return pd.DataFrame(dict(zip(["doc_id", "start", "size", "word", "n_words", "digest"], cols, strict=True)))


def repeated_passages(docs: DataFrame, id_col: str = "doc_id", text: str = "text", min_words: int = MIN_WORDS) -> DataFrame:
    """``(doc_id, start, end, n_words, first_doc_id, first_start)``: passages that an earlier document has.

    ``start`` and ``end`` are bytes of the UTF-8 text, between whole characters. From each chunk on or
    back, as few chunks as have ``min_words`` words are a run; runs are held against all
    others by digest, so that one document has all of a run, whoever has its
    parts. The document of the smallest id that has a run owns it. Runs of a
    document that one owner has at one distance and that touch are one
    passage, the same bytes in both; passages of several owners may overlap.
    Common phrases and lines are shorter than a run.
    Null or empty texts and rows of a null id have no runs. Rows that repeat an
    id are one document: a repeated row changes nothing, of different texts under one id
    each adds its spans; repeats within one document are left alone.
    """
    d = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text}`").alias("text"))
    d = d.where("doc_id is not null and text is not null and text <> ''")
    runs = materialize(d.mapInPandas(lambda it: _runs(it, min_words), RUN_SCHEMA))
    # owners are added up task by task first: a run that very many documents have costs a row a task
    owners = materialize(
        runs.groupBy("digest")
        .agg(F.min(F.struct("doc_id", "start")).alias("first"), F.max("doc_id").alias("last"))
        .where(F.col("last") > F.col("first.doc_id"))
        .select("digest", F.col("first.doc_id").alias("first_doc_id"), F.col("first.start").alias("first_run"))
    )
    # most runs have one holder: where the owners of the others are counted few, runs stay where they are
    owners = F.broadcast(owners) if owners.count() <= BROADCAST_ROWS else owners
    hits = (
        runs.join(owners, "digest")
        .where("first_doc_id < doc_id")
        .select(
            "doc_id", "start", (F.col("start") + F.col("size")).alias("end"), "word", (F.col("word") + F.col("n_words")).alias("last_word"),
            "first_doc_id", (F.col("start") - F.col("first_run")).alias("shift"),
        )
    )
    by = ["doc_id", "first_doc_id", "shift"]
    line = Window.partitionBy(*by).orderBy("start")
    new = F.coalesce((F.col("start") > F.max("end").over(line.rowsBetween(Window.unboundedPreceding, -1))).cast("int"), F.lit(0))
    return (
        hits.withColumn("new", new)
        .withColumn("part", F.sum("new").over(line))
        .groupBy(*by, "part")
        .agg(F.min("start").alias("start"), F.max("end").alias("end"), (F.max("last_word") - F.min("word")).cast("int").alias("n_words"))
        .select("doc_id", "start", "end", "n_words", "first_doc_id", (F.col("start") - F.col("shift")).alias("first_start"))
    )


def cut_passages(docs: DataFrame, passages: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` without their repeated passages; the first holder of each keeps it. Other rows and extra columns stay as they are."""
    spans_name, id_name = unused(docs, "spans_", "id_")
    spans = passages.groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("start", "end"))).alias(spans_name))
    spans = spans.withColumnRenamed("doc_id", id_name)
    at = docs.columns.index(text)

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            pdf.iloc[:, at] = [_without(t, s) for t, s in zip(pdf.iloc[:, at], pdf[spans_name], strict=True)]
            yield pdf.drop(columns=spans_name)

    joined = docs.join(spans, F.col(f"`{id_col}`") == F.col(id_name), "left").drop(id_name)
    return joined.mapInPandas(cut, docs.schema)


def _without(text: str | None, spans) -> str | None:
    if text is None or spans is None:
        return text
    raw, out, at = text.encode("utf-8", "surrogatepass"), [], 0
    for span in spans:
        out.append(raw[at : max(at, span["start"])])
        at = max(at, span["end"])
    return b"".join([*out, raw[at:]]).decode("utf-8", "surrogatepass")


def op10_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated_passages(table(spark, sf_dir, "documents"))
