"""Token ids in grammar-compressed files (operator 12).

A file set is a Parquet folder with a row for each shard: consecutive documents in
ascending order of id, about ``SHARD_TOKENS`` ids of them. A shard's ids are one
sequence that Re-Pair shortens: again and again the most frequent pairs of
neighbours become nonterminals, never across the end of a document. The row holds the rules,
how many ids each nonterminal stands for, and each document's number of
symbols and of ids, so that any span of ids is read without expanding what
stands before it. Shards are independent: a lost task writes its own again.
"""

from __future__ import annotations

import json
import os
import string
import unicodedata
import uuid
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from postwright.llm.common import stage_path, table

#: Ids after which a shard ends (a document is never cut, so a longer one is a shard of its own).
SHARD_TOKENS = 1 << 20
#: A pair becomes a nonterminal if a shard has it so many times at least ...
MIN_PAIRS = 32
#: ... and at least this part as often as the round's most frequent pair.
ROUND_SHARE = 8
#: Words of which a worker remembers the ids; the memory starts anew beyond it.
MEMORY = 2_000_000

SHARD = (
    "part int, shard int, before bigint, n_tokens bigint, first_id bigint, last_id bigint, ids array<bigint>, lengths array<int>,"
    " symbols array<int>, vocab int, width int, rules binary, spans binary, body binary"
)


#: What a tokenizer must do to a text before its merges for ``WordIds`` to hold.
WORDWISE = (["NFC", "Replace", "Lowercase"], ["Split", "ByteLevel"])


#: Marks that stand alone after letters: all of ASCII but the apostrophe, which begins endings of its own.
MARKS = string.punctuation.replace("'", "")
#: The end of the Latin letters; all but one (I with a dot) have one lower-case letter each.
LATIN_END = "\u0250"
#: Merges are of bytes, each written as a letter: itself if it is printable Latin-1, else the next one after these.
BYTE_LETTERS = {b: chr(256 + k) for k, b in enumerate(b for b in range(256) if b not in {*range(33, 127), *range(161, 173), *range(174, 256)})}


def as_bytes(word: str) -> str:
    return word if word.isascii() else word.encode().decode("latin-1").translate(BYTE_LETTERS)


class TextIds:
    """Ids of whole texts, as bytes of 32-bit little-endian integers; for any tokenizer."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)

    def of(self, texts: list[str]) -> list[bytes]:
        return [array("I", e.ids).tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]


class WordIds(TextIds):
    """The same, word by word, for a tokenizer that drops white space and joins nothing across it.

    A text's ids are its words' ids in turn, and a word that comes again is looked up. A word of Latin letters is
    what the merges get, in lower case; marks after it are a piece of their own.
    """

    def __init__(self, path: str):
        super().__init__(path)
        self.known: dict[str, bytes] = {}
        self.merges = self.tokenizer.model.tokenize
        self.marks = {"": b""}

    def whole(self, words: list[str]) -> list[bytes]:
        return super().of(words)

    def learn(self, words: set[str]) -> None:
        known = self.known
        if len(known) + len(words) > MEMORY:
            known.clear()
            self.marks = {"": b""}
        other = []
        for w in words:
            stem = w.rstrip(MARKS)
            run = w[len(stem) :]
            if stem.isalpha() and (stem.isascii() or max(stem) < LATIN_END and "İ" not in stem and unicodedata.is_normalized("NFC", stem)):
                low = "".join(map(str.lower, stem))
                if run and run not in self.marks:
                    self.marks[run] = self.whole([run])[0]
                known[w] = (known.get(low) or array("I", [t.id for t in self.merges(as_bytes(low))]).tobytes()) + self.marks[run]
            else:
                other.append(w)
        known.update(zip(other, self.whole(other), strict=True))

    def of(self, texts: list[str]) -> list[bytes]:
        split = [text.replace("\n", " ").replace("\t", " ").split(" ") for text in texts]
        found = [list(map(self.known.get, words)) for words in split]
        missed = [(words, got, k) for words, got in zip(split, found, strict=True) for k in places(got, None)]
        self.learn({words[k] for words, _, k in missed})
        for words, got, k in missed:
            got[k] = self.known[words[k]]
        return [b"".join(got) for got in found]


def places(values: list, wanted) -> Iterator[int]:
    """Where ``wanted`` stands in ``values``."""
    at = -1
    for _ in range(values.count(wanted)):
        at = values.index(wanted, at + 1)
        yield at


def ids_of(path: str) -> TextIds:
    """The faster of the two that holds for the tokenizer."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    steps = [[x["type"] for x in (spec[k] or {}).get(inner, [])] for k, inner in (("normalizer", "normalizers"), ("pre_tokenizer", "pretokenizers"))]
    return WordIds(path) if steps == [*WORDWISE] and spec["model"]["type"] == "BPE" else TextIds(path)


def repair(ids: np.ndarray, lengths: np.ndarray, min_pairs: int = MIN_PAIRS) -> tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """``(vocab, rules, spans, symbols, counts)`` of a shard: a grammar and each document's number of symbols.

    Each round counts all pairs of neighbours within documents and replaces, from left to
    right, those that are at least ``1 / ROUND_SHARE`` as frequent as the most frequent one;
    rounds end when none occurs ``min_pairs`` times. ``rules[k]`` is what nonterminal ``vocab + k``
    stands for, ``spans[k]`` the number of ids in it.
    """
    vocab = int(ids.max(initial=0)) + 1
    seq = ids.astype(np.uint32)
    last = np.zeros(len(seq), dtype=bool)
    ends = np.cumsum(lengths)[lengths > 0]
    last[ends - 1] = True
    rules, n = [np.empty((0, 2), dtype=np.uint32)], vocab
    while len(seq) > 1:
        kind = np.uint32 if n <= 1 << 16 else np.uint64
        stop = np.flatnonzero(last[:-1])
        pairs = seq[:-1].astype(kind)
        pairs *= kind(n)
        pairs += seq[1:]
        ordered = pairs.copy()
        ordered[stop] = np.iinfo(kind).max  # no pair: both halves are under n
        ordered.sort()
        ordered = ordered[: len(ordered) - len(stop)]
        if not len(ordered):
            break
        first = np.flatnonzero(np.concatenate(([True], ordered[1:] != ordered[:-1])))
        times = np.diff(np.append(first, len(ordered)))
        if times.max() < min_pairs:
            break
        often = ordered[first[times >= max(min_pairs, times.max() // ROUND_SHARE)]]
        at, rule = _occurrences(seq, stop, often // kind(n), often % kind(n), n)
        # of pairs that overlap in a row, every other one is replaced
        fresh = np.concatenate(([True], np.diff(at) != 1))
        place = np.arange(len(at))
        free = ((place - np.maximum.accumulate(np.where(fresh, place, 0))) & 1) == 0
        at, rule = at[free], rule[free]
        used = np.bincount(rule, minlength=len(often)) > 0
        rules.append(np.stack([often[used] // kind(n), often[used] % kind(n)], axis=1).astype(np.uint32))
        seq[at] = (n + (np.cumsum(used) - 1)[rule]).astype(np.uint32)
        last[at] = last[at + 1]
        stays = np.ones(len(seq), dtype=bool)
        stays[at + 1] = False
        seq, last = seq[stays], last[stays]
        n += int(used.sum())
    grammar = np.concatenate(rules)
    counts = np.zeros(len(lengths), dtype=np.int32)
    counts[lengths > 0] = np.diff(np.concatenate(([-1], np.flatnonzero(last))))
    return vocab, grammar, spans_of(vocab, grammar), seq, counts


def _occurrences(seq: np.ndarray, stop: np.ndarray, left: np.ndarray, right: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Where the pairs ``(left[k], right[k])`` stand, and ``k``; none begins at ``stop``."""
    lefts, rights = np.unique(left), np.unique(right)
    of_left, of_right = np.full(n, -1, dtype=np.int32), np.full(n, -1, dtype=np.int32)
    of_left[lefts], of_right[rights] = np.arange(len(lefts)), np.arange(len(rights))
    begins = of_left[seq[:-1]] >= 0
    begins &= of_right[seq[1:]] >= 0
    begins[stop] = False
    at = np.flatnonzero(begins)
    cell = of_left[seq[at]].astype(np.int64) * len(rights) + of_right[seq[at + 1]]
    own = of_left[left].astype(np.int64) * len(rights) + of_right[right]
    if len(lefts) * len(rights) <= 1 << 24:
        table = np.full(len(lefts) * len(rights), -1, dtype=np.int32)
        table[own] = np.arange(len(own))
        rule = table[cell]
    else:  # ``own`` is in order
        rule = np.minimum(np.searchsorted(own, cell), len(own) - 1)
        rule[own[rule] != cell] = -1
    hit = rule >= 0
    return at[hit], rule[hit]


def spans_of(vocab: int, rules: np.ndarray) -> np.ndarray:
    """How many ids each nonterminal stands for; a rule names earlier symbols only."""
    spans = np.ones(vocab + len(rules), dtype=np.uint32)
    for k, (a, b) in enumerate(rules.tolist(), vocab):
        spans[k] = spans[a] + spans[b]
    return spans[vocab:]


def expand(vocab: int, rules: np.ndarray, symbols: np.ndarray) -> np.ndarray:
    """The ids that ``symbols`` stand for: nonterminals open level by level, all of a level at once."""
    out = symbols.astype(np.uint32)
    while len(at := np.flatnonzero(out >= vocab)):
        size = np.ones(len(out), dtype=np.int64)
        size[at] = 2
        to = np.cumsum(size) - size
        wide = np.empty(int(size.sum()), dtype=np.uint32)
        wide[to] = out
        wide[to[at]], wide[to[at] + 1] = rules[out[at] - vocab].T
        out = wide
    return out


def expand_all(vocab: int, rules: np.ndarray, spans: np.ndarray, symbols: np.ndarray) -> np.ndarray:
    """The same for a whole shard: each nonterminal is opened once, and what it stands for is copied."""
    opened = np.concatenate((np.arange(vocab, dtype=np.uint32), expand(vocab, rules, np.arange(vocab, vocab + len(rules)))))
    size = np.concatenate((np.ones(vocab, dtype=np.int64), spans))
    begin = np.cumsum(size) - size
    length = size[symbols]
    ends = np.cumsum(length)
    return opened[np.repeat(begin[symbols] - ends + length, length) + np.arange(int(ends[-1]) if len(ends) else 0)]


def span_of_ids(vocab: int, rules: np.ndarray, spans: np.ndarray, symbols: np.ndarray, first: int, count: int) -> np.ndarray:
    """Ids ``first`` to ``first + count`` of a document: only the symbols that reach into the span are expanded."""
    size = np.concatenate((np.ones(vocab, dtype=np.int64), spans))[symbols]
    ends = np.cumsum(size)
    a, b = np.searchsorted(ends, first, side="right"), np.searchsorted(ends, first + count, side="left") + 1
    skip = first - (int(ends[a - 1]) if a else 0)
    return expand(vocab, rules, symbols[a:b])[skip : skip + count]


def _shard(part: int, shard: int, before: int, docs: list[tuple[int | None, bytes]]) -> dict:
    lengths = np.array([len(x) // 4 for _, x in docs], dtype=np.int32)
    vocab, rules, spans, seq, counts = repair(np.frombuffer(b"".join([x for _, x in docs]), dtype="<u4"), lengths)
    width = 2 if vocab + len(rules) <= 1 << 16 else 4
    known = [d for d, _ in docs if d is not None]
    return {
        "part": part, "shard": shard, "before": before, "n_tokens": int(lengths.sum()), "first_id": min(known, default=None), "last_id": max(known, default=None),
        "ids": [d for d, _ in docs], "lengths": lengths.tolist(), "symbols": counts.tolist(), "vocab": vocab, "width": width,
        "rules": rules.astype("<u4").tobytes(), "spans": spans.astype("<u4").tobytes(), "body": seq.astype(f"<u{width}").tobytes(),
    }


def write_tokens(
    docs: DataFrame, path: str, tokenizer: str, id_col: str = "doc_id", text: str = "text", end_id: int | None = 2, shard_tokens: int = SHARD_TOKENS
) -> None:
    """Encode every whole text and write the shards to the new folder ``path``, in ascending order of id.

    ``tokenizer`` is a file of the tokenizers library that every worker can read. ``end_id`` is
    appended to each document (None: nothing). A null text is empty; null ids come first; rows of one id stand in the table's
    order, so repeated rows are documents of their own. Extra columns don't matter;
    an empty table gives a folder without shards. A task holds one shard's ids.
    """
    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text"))
    ordered = rows.withColumn("row", F.monotonically_increasing_id()).repartitionByRange("id", "row").sortWithinPartitions("id", "row")
    schema = _arrow_schema()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, end = worker_memory(tokenizer, lambda: ids_of(tokenizer)), b"" if end_id is None else int(end_id).to_bytes(4, "little")
        part, shard, before, held, size = TaskContext.get().partitionId(), 0, 0, [], 0
        for batch in batches:
            ids, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for k in range(0, len(ids), 256):
                for doc, got in zip(ids[k : k + 256], words.of(texts[k : k + 256]), strict=True):
                    held.append((doc, got + end))
                    size += len(held[-1][1]) // 4
                    if size >= shard_tokens:
                        yield pa.RecordBatch.from_pylist([_shard(part, shard, before, held)], schema)
                        shard, before, held, size = shard + 1, before + size, [], 0
        if held:
            yield pa.RecordBatch.from_pylist([_shard(part, shard, before, held)], schema)

    ordered.select("id", "text").mapInArrow(run, SHARD).write.option("compression", "zstd").parquet(path)


def worker_memory(key: str, make):
    """What a Python worker keeps between its tasks: they'd all learn the same words anew.

    A worker has one core, so the library's own threads would only wait for each other.
    """
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    import tokenizers

    held = tokenizers.__dict__.setdefault("_held_by_worker", {})
    if key not in held:
        held[key] = make()
    return held[key]


def _arrow_schema() -> pa.Schema:
    kinds = {"int": pa.int32(), "bigint": pa.int64(), "binary": pa.binary(), "array<int>": pa.list_(pa.int32()), "array<bigint>": pa.list_(pa.int64())}
    return pa.schema([(name, kinds[kind]) for name, kind in (c.split() for c in SHARD.split(", "))])


def _opened(row: dict) -> tuple[int, np.ndarray, np.ndarray, np.ndarray]:
    body = np.frombuffer(row["body"], dtype=f"<u{row['width']}")
    return row["vocab"], np.frombuffer(row["rules"], dtype="<u4").reshape(-1, 2), np.frombuffer(row["spans"], dtype="<u4"), body


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """``(doc_id, start, n_tokens, tokens)`` of every document of the folder.

    ``start`` counts the ids of all documents before it; ``tokens`` has the ids as 32-bit
    little-endian integers. Only the totals of the parts that were written (one for each
    task that wrote) go through the driver.
    """
    shards = spark.read.schema(SHARD).parquet(path)
    offset, total = {}, 0
    for r in shards.groupBy("part").agg(F.sum("n_tokens").alias("n")).orderBy("part").collect():
        offset[r["part"]], total = total, total + r["n"]
    names = ["doc_id", "start", "n_tokens", "tokens"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                row = {name: batch.column(j)[k].as_py() for j, name in enumerate(batch.schema.names)}
                flat, sizes = expand_all(*_opened(row)), np.array(row["lengths"], dtype=np.int64)
                ends = np.concatenate(([0], np.cumsum(sizes)))
                whole = pa.Array.from_buffers(pa.binary(), len(sizes), [None, pa.py_buffer((ends * 4).astype(np.int32)), pa.py_buffer(flat.astype("<u4"))])
                first = offset[row["part"]] + row["before"]
                yield pa.RecordBatch.from_arrays([pa.array(row["ids"], pa.int64()), pa.array(first + ends[:-1], pa.int64()), pa.array(sizes, pa.int64()), whole], names)

    return shards.select("part", "before", "ids", "lengths", "vocab", "width", "rules", "spans", "body").mapInArrow(run, "doc_id bigint, start bigint, n_tokens bigint, tokens binary")


def read_spans(spark: SparkSession, path: str, doc_ids: list[int], first: int = 0, count: int = 1 << 31) -> DataFrame:
    """``(doc_id, tokens)`` of some documents: ids ``first`` to ``first + count`` of each, as an array.

    The range of ids of a shard decides in the scan whether it is read; in a shard only the
    symbols that reach into a span are expanded. An id that no shard has gives no row.
    """
    wanted = sorted(set(doc_ids))
    shards = spark.read.schema(SHARD).parquet(path).where(F.arrays_overlap("ids", F.array(*[F.lit(x).cast("long") for x in wanted])))
    if wanted:
        shards = shards.where((F.col("first_id") <= wanted[-1]) & (F.col("last_id") >= wanted[0]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        inside = set(wanted)
        for batch in batches:
            for row in batch.to_pylist():
                vocab, rules, spans, body = _opened(row)
                ends = np.concatenate(([0], np.cumsum(row["symbols"])))
                found = [k for k, d in enumerate(row["ids"]) if d in inside]
                got = [span_of_ids(vocab, rules, spans, body[ends[k] : ends[k + 1]], first, min(count, row["lengths"][k])).tolist() for k in found]
                yield pa.RecordBatch.from_arrays([pa.array([row["ids"][k] for k in found], pa.int64()), pa.array(got, pa.list_(pa.int64()))], ["doc_id", "tokens"])

    return shards.mapInArrow(run, "doc_id bigint, tokens array<bigint>") if wanted else spark.createDataFrame([], "doc_id bigint, tokens array<bigint>")


def op12_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    path = f"{stage_path(spark)}/tokens-{uuid.uuid4().hex}"
    write_tokens(table(spark, sf_dir, "documents"), path, public_tokenizers.path("word_bpe_49k.json"))
    return read_tokens(spark, path).select("doc_id", "start", "n_tokens", F.crc32("tokens").alias("ids_crc32"))
