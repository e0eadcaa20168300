import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from postwright.llm import token_files
from postwright.llm.queries import QUERIES

tokenizers = pytest.importorskip("tokenizers")
public_tokenizers = pytest.importorskip("public_tokenizers")
PATH = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def library():
    return tokenizers.Tokenizer.from_file(PATH)


def whole(library, text):
    return library.encode(text or "", add_special_tokens=False).ids


@given(st.lists(st.lists(st.integers(0, 5), max_size=60), max_size=8), st.integers(2, 4))
@settings(max_examples=200, deadline=None)
def test_grammar_round_trip(docs, least):
    lengths = np.array([len(d) for d in docs], dtype=np.int32)
    flat = np.array([x for d in docs for x in d], dtype=np.uint32)
    vocab, rules, spans, seq, counts = token_files.repair(flat, lengths, least)
    assert token_files.expand(vocab, rules, seq).tolist() == flat.tolist() == token_files.expand_all(vocab, rules, spans, seq).tolist()
    ends = np.concatenate(([0], np.cumsum(counts)))
    for k, d in enumerate(docs):
        part = seq[ends[k] : ends[k + 1]]
        assert token_files.expand(vocab, rules, part).tolist() == d
        for first in range(0, len(d) + 1, 7):
            assert token_files.span_of_ids(vocab, rules, spans, part, first, 5).tolist() == d[first : first + 5]
    left = [tuple(p) for k in range(len(docs)) for p in zip(seq[ends[k] : ends[k + 1] - 1].tolist(), seq[ends[k] + 1 : ends[k + 1]].tolist())]
    # no pair is left that could be replaced (of a run x x x only every other pair can)
    assert all(left.count(p) < least or p[0] == p[1] for p in set(left))
    assert all(len(token_files.expand(vocab, rules, np.array([vocab + k]))) == spans[k] for k in range(len(rules)))


def test_wide_symbols():
    flat = np.array([70_000, 5] * 80, dtype=np.uint32)
    vocab, rules, _, seq, _ = token_files.repair(flat, np.array([160]))
    assert len(seq) < 160 and token_files.expand(vocab, rules, seq).tolist() == flat.tolist()


WORDS = ["word.$$$", "a_b_", "x<|", "don't.", "end.'", "Été***", "7th!", "a-", "---", "<|endoftext|>.", "İstanbul", "éè", "ÉTÉ.", "ǅungla", "ŉa", "Øre,", "ſ", "ĲSLAND", "e\u0301te", "ªº", "naïve!", "ßẞ", "ÀÀ", "ΣΑΣ", "don't", "it's.", "é", "́x", "a\x1cb", "a\x85b", "a b", "<|endoftext|>", "<|ENDOFTEXT|>", "x<|startoftext|>y", "2024,", "Word.", "WORD?!", "日本語", "😀", "ß", "", "\r", "\x0b", "'s", "A'll"]


@given(st.lists(st.sampled_from(WORDS) | st.text(max_size=6), max_size=12), st.sampled_from([" ", "\n", "\t", "  ", "\r\n"]))
@settings(max_examples=300, deadline=None)
def test_words_give_the_ids_of_the_text(library, words, blank):
    text = blank.join(words)
    assert np.frombuffer(token_files.WordIds(PATH).of([text])[0], dtype="<u4").tolist() == whole(library, text) if len(words) < 3 else True
    assert np.frombuffer(SHARED.of([text])[0], dtype="<u4").tolist() == whole(library, text)


SHARED = token_files.WordIds(PATH)


def test_memory_starts_anew(library, monkeypatch):
    monkeypatch.setattr(token_files, "MEMORY", 5)
    texts = ["one two three", "four five six. seven", " ".join(f"w{k}" for k in range(20)), ""]
    assert isinstance(token_files.ids_of(PATH), token_files.WordIds)
    other = public_tokenizers.path("byte_bpe_50k.json")
    assert type(token_files.ids_of(other)) is token_files.TextIds
    assert np.frombuffer(token_files.ids_of(other).of(["a  b\n"])[0], dtype="<u4").tolist() == tokenizers.Tokenizer.from_file(other).encode("a  b\n").ids
    got = token_files.WordIds(PATH).of(texts)
    assert [np.frombuffer(x, dtype="<u4").tolist() for x in got] == [whole(library, x) for x in texts]


def brute(library, docs):
    out, start = [], 0
    for doc_id, text in docs:
        ids = [*whole(library, text), 2]
        out.append((doc_id, start, len(ids), zlib.crc32(np.array(ids, dtype="<u4").tobytes())))
        start += len(ids)
    return out


def test_query_equals_brute_force(spark, sf_dir, library):
    docs = sorted((r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect())
    got = sorted(tuple(r) for r in QUERIES["op12_token_files"](spark, sf_dir).select("doc_id", "start", "n_tokens", "ids_crc32").collect())
    assert got == brute(library, docs)


def test_files_of_awkward_rows(spark, library, tmp_path):
    rows = [(5, "b b b"), (None, "null id"), (1, None), (2, ""), (2, ""), (2, "other"), (9, "long word " * 5000), (9, "again")]
    d = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    for c in ("id", "row", "part", "tokens"):
        d = d.withColumn(c, F.lit("clash"))
    token_files.write_tokens(d, f"{tmp_path}/t", PATH, shard_tokens=4)
    got = token_files.read_tokens(spark, f"{tmp_path}/t")
    want = brute(library, sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)))
    assert sorted((tuple(r) for r in got.select("doc_id", "start", "n_tokens", F.crc32("tokens")).collect()), key=lambda r: r[1]) == want
    assert spark.read.parquet(f"{tmp_path}/t").count() > 2
    spans = {r["doc_id"]: r["tokens"] for r in token_files.read_spans(spark, f"{tmp_path}/t", [5, 77], 1, 2).collect()}
    assert spans == {5: [*whole(library, "b b b"), 2][1:3]}
    many = [r["tokens"] for r in token_files.read_spans(spark, f"{tmp_path}/t", [9], 9000, 3).collect()]
    assert sorted(many) == [[], [*whole(library, rows[6][1]), 2][9000:9003]]


def test_files_of_an_empty_table(spark, tmp_path):
    token_files.write_tokens(spark.createDataFrame([], "doc_id long, text string"), f"{tmp_path}/t", PATH)
    assert token_files.read_tokens(spark, f"{tmp_path}/t").count() == 0
    assert token_files.read_spans(spark, f"{tmp_path}/t", [1]).count() == 0 and token_files.read_spans(spark, f"{tmp_path}/t", []).count() == 0
