"""Inputs at the edges of the corpus operators, each with its value."""

import time

import pytest
from pyspark.sql import functions as F

from postwright.llm import chunks, fingerprints, html_text, lines, ngram_join, packing, quality_rules, toxicity
from tests.llm.test_corpus_operators import corpus


def test_next_of_wide_and_clustered_ids(spark, monkeypatch):
    monkeypatch.setattr(fingerprints, "CELL_ROWS", 5)
    ids = [-(2**63), -(2**62), -1, 0, 2**62, 2**63 - 1, *range(1000, 1040)]
    d = spark.createDataFrame([(i, f"text {i}") for i in ids], "doc_id long, text string")
    order = sorted(ids, reverse=True)
    want = {i: f"text {order[(k + 1) % len(order)]}" for k, i in enumerate(order)}
    assert {r["doc_id"]: r["next_text"] for r in fingerprints.with_next(d).collect()} == want


def test_a_repeated_row_makes_no_passage(spark):
    phrase = " ".join(f"shared{k}" for k in range(8))
    own = lambda a: " ".join(f"{a}{k}x" for k in range(40))
    texts = [(1, f"{own('a')} {phrase} {own('b')}"), (2, f"{own('c')} {phrase} {own('d')}")]
    assert chunks.repeated_passages(corpus(spark, [*texts, texts[1]])).count() == 0
    long = " ".join(f"common{k}" for k in range(60))
    texts = [(1, f"{own('a')} {long} {own('b')}"), (2, f"{own('c')} {long} {own('d')}")]
    once, twice = (sorted(map(tuple, chunks.repeated_passages(corpus(spark, t)).collect())) for t in (texts, [*texts, texts[1]]))
    assert once == twice and len(once) > 0


def test_passages_hold_whole_characters(spark):
    shared = " ".join(f"é{k}ü😀{k * 7}ß" for k in range(80))
    texts = [f"{'ä' * k} {'ö😀' * (k + 3)} eigen{k} {shared} {'😀ñ' * (k + 2)}" for k in range(6)]
    d = corpus(spark, texts)
    found = chunks.repeated_passages(d)
    rows = found.collect()
    assert {r["doc_id"] for r in rows} == {1, 2, 3, 4, 5}
    for r in rows:
        part = texts[r["doc_id"]].encode()[r["start"] : r["end"]]
        first = texts[r["first_doc_id"]].encode()
        assert part.decode() in shared + texts[r["doc_id"]] and first[r["first_start"] : r["first_start"] + len(part)] == part
    left = {r["doc_id"]: r["text"] for r in chunks.cut_passages(d, found).collect()}
    assert left[0] == texts[0] and all(f"eigen{k}" in left[k] and "�" not in left[k] for k in range(1, 6))


@pytest.mark.parametrize("n", [99, 100, 101, 250])
def test_pieces_keep_the_lines_of_the_text(spark, n):
    text = " \n" + "".join(f"w{k}" + ("\n\n  " if k % 7 == 0 else "\t") for k in range(n))
    r = sorted(packing.packed(corpus(spark, [text]), max_tokens=100, batch_tokens=400).collect(), key=lambda x: x["piece"])
    at = 0
    for x in r:
        found = text.index(x["text"], at)
        assert not text[at:found].strip()  # only blanks between the pieces
        at = found + len(x["text"])
    assert at == len(text) and r[0]["text"].startswith(" \n") and sum(len(x["text"].split()) for x in r) == n


def test_segments_take_linear_time():
    events = [(3 * k, 1.0 + (k % 5) / 10) for k in range(100_000)]
    start = time.process_time()
    assert len(toxicity.maximal_segments(events, 2.0)) == 100_000
    assert time.process_time() - start < 5  # the square of it takes minutes


def counted(spark, rows):
    return spark.createDataFrame(
        [(lang, source, 1000, 5000, s, 0, 0, 50, 0) for lang, source, s in rows],
        "lang string, source string, n_words long, word_chars long, n_symbols long, n_marks long, n_dup_lines long, n_lines long, n_repeat_words long",
    )


def test_limits_follow_their_group(spark):
    few = [("en", "few", k % 5) for k in range(3000)]
    many = [("en", "many", 40 + k % 25) for k in range(3000)]
    limit = lambda rows: {r["source"]: r["max_symbols"] for r in quality_rules.thresholds(counted(spark, rows)).collect()}
    a = limit(few + many)
    assert a["few"] != a["many"]
    b = limit(few + [(lang, source, s + 30) for lang, source, s in many])
    assert b["many"] > a["many"]
    # the same document falls in one source and stands in the other, and stands again when the source moves
    judged = lambda rows, source, s: quality_rules.judged(
        counted(spark, [("en", source, s)]), quality_rules.thresholds(counted(spark, rows))
    ).first()["kept"]
    s = (min(a.values()) // 10 + max(a.values()) // 10) // 2
    low, high = sorted(a, key=a.get)
    assert not judged(few + many, low, s) and judged(few + many, high, s)


def test_links_come_from_the_trees(spark, monkeypatch):
    base = [f"w{k}" for k in range(200)]
    near = [" ".join([*base[:150], f"own{k}", *base[151:]]) for k in range(40)]
    d = corpus(spark, [*near, " ".join(f"z{k}" for k in range(90))])
    joined = lambda: {r["doc_id"]: r["component_id"] for r in ngram_join.jaccard_components(d, 3, 90, 100, block=8).collect()}
    assert joined() == {**dict.fromkeys(range(40), 0), 40: 40}
    monkeypatch.setattr(ngram_join, "_tree_join", lambda batches, num, den: (b[["doc_id", "n"]].set_axis(["a", "b"], axis=1).head(0) for b in batches))
    assert joined() == {k: k for k in range(41)}


TABLES = {
    "<p>a</p><dialog>closed</dialog><dialog open>open</dialog>": "a\nopen",
    "<pre>\nx\n y</pre>": "x\n y",
    "<table><tr><td>low</td></tr><thead><tr><td>top</td></tr></thead></table>": "top\nlow",
    "<table><tr><td rowspan=2>a</td><td>b</td></tr><tr><td>c</td></tr></table>": "a  b\n   c",
}


@pytest.mark.parametrize("page", TABLES)
def test_layout(page):
    lines = [x.rstrip() for x in html_text.render(page).split("\n") if x.strip()]
    assert [" ".join(x.replace("|", " ").split()) for x in lines] == [" ".join(x.split()) for x in TABLES[page].split("\n")]


def test_passed_counts_the_cuts(spark):
    d = spark.createDataFrame([(x,) for x in range(-3, 12)], "x long")
    cuts = [-2, 0, 1, 5, 9]
    got = {r["x"]: r["n"] for r in d.select("x", fingerprints._passed(F.col("x"), cuts).alias("n")).collect()}
    assert got == {x: sum(c < x for c in cuts) for x in range(-3, 12)}


@pytest.mark.parametrize("unit", ['<a "x', "<b>x</i>", "<p>x<div>y<li>z", '<a b="', "<title></title ", "<<<", "<!-- x", "<font color='r>"])
def test_broken_markup_takes_linear_time(unit):
    """64,000 repeats: hours where time grows with the square."""
    import time

    began = time.process_time()
    html_text.render(unit * 64_000)
    assert time.process_time() - began < 60


def test_visible_text():
    show = html_text.render
    assert show("<p aria-hidden=true>seen</p><p hidden>not") == "seen"
    assert show("<details><summary>S</summary>in</details><details open><summary>T</summary>out</details>") == "S\nT\nout"
    assert show('<div style="visibility:hidden">no<b style="visibility: visible">yes</b></div>') == "yes"
    assert show("<textarea>a &amp; b</textarea>") == "a & b"
    assert show("<p>x <a href=\"q>r\" title='z>'>l</a> a<b and 3 < 4") == "x l a"
    assert show("<a \"x>y</a> 3 < 4 z") == "y 3 < 4 z"
    assert show('<table style="visibility:hidden"><tr><td>a<td style="visibility:visible">b</table>') == "  b"  # a hidden cell keeps its place


def test_names_of_the_input_never_clash(spark):
    text = " ".join(f"word{k}" for k in range(40))
    d = corpus(spark, [text, text + " x", "menu\nown", "menu\nother"])
    for c in ("__host", "__id", "keep_id", "host_", "id_", "hash_", "cut_", "lines_", "kept_", "spans_", "other_id", "_other_id", "set", "n", "s"):
        d = d.withColumn(c, F.lit("clash"))
    kept = lines.drop_boilerplate(d, min_pages=1, ratio_percent=60)
    assert kept.count() == 4 and kept.where("__host <> 'clash' or host_ <> 'clash' or kept_ <> 'clash'").count() == 0
    first = ngram_join.keep_first(d)
    assert sorted(r["doc_id"] for r in first.collect()) == [0, 2, 3] and first.columns == d.columns
    cut = chunks.cut_passages(d, chunks.repeated_passages(d))
    assert cut.count() == 4 and cut.columns == d.columns
