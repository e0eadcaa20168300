"""Skill mentions with verified offsets: each text is walked once, next to the aliases.

The folded text is cut into tokens (runs of word characters, runs of blanks,
single other characters); an alias is a run of such tokens. A walk looks up each token in a map
of the aliases' first tokens and cuts out the runs that are aliases, with their context; folding
may expand a letter (``ß``), so a map leads from the folded text back to the text. Guards and
policies are column expressions over the runs. No text and no position is shuffled. The alias table is a few
thousand rows (the ontology) and goes to the tasks behind a check of its size.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from postwright.functions.session import cut_off
from postwright.functions.text import folded_with_origin
from postwright.operators.ontology import alias_index

# What may stand beside a short alias, and how far context reaches.
NEIGHBOURS = " \t\n\r,;/|()[]:."
SHORT = 3
CONTEXT = 80
TOKENS = r"(?U)\w+|\s+|[^\w\s]"
TOKEN = re.compile(r"\w+|\s+|[^\w\s]")
#: Ontologies of more aliases are joined by shuffle.
BROADCAST_ALIASES = 200_000
#: So many first tokens are looked for one by one; beyond, texts are cut into tokens.
FEW_FIRST = 16
#: Hits that a worker holds before it hands them on.
HITS = 2_000

# Terms of which one stands near an alias that needs capitals and context, in folded form.
AI_TERMS = [
    "ai", "agent", "artificielle", "artificial", "architecture", "architectures", "data", "deep learning", "genai", "generative", "ia", "engineer",
    "intelligence", "learning", "machine learning", "model", "modele", "ml",
]
ML_TERMS = ["data", "deep learning", "engineering", "learning", "machine", "model", "modele", "scientist"]
BI_TERMS = ["analytics", "business", "data", "decisionnel", "power bi", "reporting", "tableau"]
CLOUD_TERMS = ["cloud", "data", "platform", "vertex"]
SAP_TERMS = ["bw", "consultant", "erp", "s/4", "sap", "solution"]
RAG_TERMS = ["agent", "ai", "genai", "ia", "llm", "retrieval"]
LLM_TERMS = ["ai", "genai", "ia", "language", "langage", "model", "modele", "rag"]
R_TERMS = [
    "programming", "programmation", "langage", "language", "python", "sql", "rstudio", "statistical", "statistics", "skills", "competences", "technologies",
]
C_TERMS = ["c++", "c/c++", "developpons", "embedded", "langage", "linux", "python", "rust", "software"]
CAPITALS_AND_CONTEXT = {
    ("Artificial Intelligence", "ai"): AI_TERMS,
    ("Artificial Intelligence", "ia"): AI_TERMS,
    ("Artificial Intelligence", "ki"): AI_TERMS,
    ("Machine Learning", "ml"): ML_TERMS,
    ("Business Intelligence", "bi"): BI_TERMS,
    ("R", "r"): R_TERMS,
    ("C", "c"): C_TERMS,
    ("SAP", "sap"): SAP_TERMS,
    ("GCP", "gcp"): CLOUD_TERMS,
    ("Retrieval-Augmented Generation", "rag"): RAG_TERMS,
    ("Large Language Models", "llm"): LLM_TERMS,
}
CHEF_AFTER = r"^\s+d[eu']\b|^\s+d'?\s*equipe\b"
CHEF_BEFORE = r"\b(du|des)\s+$"


def alias_table(skills: DataFrame) -> DataFrame:
    """The alias index with what the scan needs: its key, its first token, its length in tokens, its policy.

    ``first_ord`` numbers aliases by skill, in the order of declaration.
    """
    index = alias_index(skills)
    tokens = F.regexp_extract_all("folded", F.lit(TOKENS), F.lit(0))
    terms = F.map_from_entries(
        F.array(*[F.struct(F.lit(f"{c}\n{a}"), F.array(*[F.lit(t) for t in terms])) for (c, a), terms in CAPITALS_AND_CONTEXT.items()])
    )
    return index.select(
        "canonical",
        "alias",
        "alias_ord",
        F.regexp_replace("folded", r"(?U)\s+", " ").alias("key"),
        F.get(tokens, 0).alias("first_token"),
        F.size(tokens).alias("n_tokens"),
        (~F.col("folded").contains(" ") & (F.char_length("folded") <= SHORT)).alias("is_short"),
        F.col("folded").rlike(r"(?U)^\p{L}+$").alias("is_alphabetic"),
        F.element_at(terms, F.concat_ws("\n", "canonical", "folded")).alias("terms"),
        ((F.col("canonical") == "Chef") & (F.col("folded") == "chef")).alias("is_chef"),
    )


def walk(text: str, runs: dict[str, dict[int, dict[str, str] | None]] | None, lengths: list[int]) -> Iterator[tuple]:
    """``(key, n_tokens, start, end, evidence, before, after)`` of the runs of tokens that are aliases.

    ``runs`` has the aliases by first token and length; None stands for any run of one of ``lengths``.
    Offsets and evidence are of the text, the context is folded.
    """
    folded, origin = folded_with_origin(text)
    if runs is not None and len(runs) <= FEW_FIRST:
        for a, first in _firsts(folded, runs):
            own = []
            for n, keys in sorted(runs[first].items()):
                while len(own) < n and (m := TOKEN.match(folded, own[-1].end() if own else a)):
                    own.append(m)
                key = keys.get("".join([" " if m.group().isspace() else m.group() for m in own[:n]])) if len(own) >= n else None
                if key is not None:
                    b = own[n - 1].end()
                    start, end = (a, b) if origin is None else (origin[a], origin[b - 1] + 1)
                    yield key, n, start, end, text[start:end], folded[max(0, a - CONTEXT) : a], folded[b : b + CONTEXT]
        return
    tokens = TOKEN.findall(folded)
    begins = range(len(tokens)) if runs is None else [k for k, t in enumerate(tokens) if t in runs]
    if not begins:
        return
    ends = list(accumulate(map(len, tokens)))
    for k in begins:
        for n in lengths if runs is None else runs[tokens[k]]:
            if k + n > len(tokens):
                continue
            key = "".join([" " if t.isspace() else t for t in tokens[k : k + n]])
            if runs is not None:
                key = runs[tokens[k]][n].get(key)
            if key is not None:
                a, b = ends[k] - len(tokens[k]), ends[k + n - 1]
                start, end = (a, b) if origin is None else (origin[a], origin[b - 1] + 1)
                yield key, n, start, end, text[start:end], folded[max(0, a - CONTEXT) : a], folded[b : b + CONTEXT]


def _firsts(folded: str, firsts: Iterable[str]) -> Iterator[tuple[int, str]]:
    """Where the text has a token that is one of a few, one token after the other; nothing else is cut out."""
    word = lambda c: c.isalnum() or c == "_"
    for t in firsts:
        a = folded.find(t)
        while a >= 0:
            b = a + len(t)
            if not word(t[0]) or not (a and word(folded[a - 1]) or b < len(folded) and word(folded[b])):
                yield a, t
            a = folded.find(t, a + 1)


def hits(docs: DataFrame, aliases: DataFrame, id_col: str = "doc_id", text: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """All alias hits ``(doc_id, *keep, row, canonical, alias, alias_ord, start, end, evidence)`` that guards and policies pass.

    Offsets are code points, half open. ``row`` numbers the rows of ``docs``: rows of one id and rows without
    one keep their own hits. Null texts have none. Beyond ``BROADCAST_ALIASES`` aliases all runs of their
    lengths are cut out and joined by shuffle.
    """
    small = aliases.count() <= BROADCAST_ALIASES
    runs, lengths = None, sorted(r["n_tokens"] for r in aliases.select("n_tokens").distinct().collect())
    if small:
        runs = {}
        for r in aliases.select("key", "alias").distinct().collect():
            own = re.sub(r"\s+", " ", folded_with_origin(r["alias"].strip())[0])
            tokens = TOKEN.findall(own)
            runs.setdefault(tokens[0], {}).setdefault(len(tokens), {})[own] = r["key"]
    columns = docs.select(F.col(f"`{text}`").alias("text"), F.monotonically_increasing_id().alias("row"), F.col(f"`{id_col}`").alias("doc_id"), *keep)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in columns.schema[1:])
    names = ["key", "n_tokens", "start", "end", "evidence", "before", "after"]
    kinds = [pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.string(), pa.string(), pa.string()]

    def cut(rows: pa.RecordBatch, at: list[int], found: list[tuple]) -> pa.RecordBatch:
        rest = rows.select(rows.schema.names[1:]).take(pa.array(at, pa.int64()))
        own = [pa.array(c, t) for c, t in zip(zip(*found, strict=True) if found else [[]] * len(names), kinds, strict=True)]
        return pa.RecordBatch.from_arrays([*rest.columns, *own], [*rest.schema.names, *names])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, found = [], []
            for k in range(batch.num_rows):
                for hit in walk(batch.column(0)[k].as_py() or "", runs, lengths):
                    at.append(k)
                    found.append(hit)
                    if len(found) == HITS:
                        yield cut(batch, at, found)
                        at, found = [], []
            yield cut(batch, at, found)

    found = columns.mapInArrow(run, f"{schema}, key string, n_tokens int, start int, `end` int, evidence string, before string, after string")
    found = found.join(F.broadcast(aliases) if small else aliases, ["key"] if small else ["key", "n_tokens"])
    before_char, after_char = F.right("before", F.lit(1)), F.substring("after", 1, 1)
    word = lambda c: c.rlike(r"(?U)^\w$")
    beside = lambda c: (c == "") | F.lit(NEIGHBOURS).contains(c)
    lower = F.col("evidence") == F.lower("evidence")
    ok = (
        ~word(before_char)
        & ~word(after_char)
        & (~F.col("is_short") | (beside(before_char) & beside(after_char) & ~(F.col("is_alphabetic") & lower)))
        & (F.col("terms").isNull() | (~lower & F.exists("terms", lambda t: F.col("before").contains(t) | F.col("after").contains(t))))
        & (~F.col("is_chef") | (~F.col("after").rlike(CHEF_AFTER) & ~F.col("before").rlike(CHEF_BEFORE)))
    )
    return found.where(ok).select("doc_id", *keep, "row", "canonical", "alias", "alias_ord", "start", "end", "evidence")


def matches(docs: DataFrame, skills: DataFrame, id_col: str = "doc_id", text: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """One hit for each row of ``docs`` and skill: its first alias with a hit, where that hit comes first."""
    best = Window.partitionBy("row", "canonical").orderBy("alias_ord", "start")
    found = hits(docs, alias_table(skills), id_col, text, keep)
    return found.withColumn("__n", F.row_number().over(best)).where("__n = 1").drop("__n", "alias_ord", "row")


def posting_matches(jobs: DataFrame, skills: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``(matches, failures)`` of title and description: offsets are relative to the field.

    Title and description are read as one text with an empty line between; a hit
    across that line fails the job, and none of its matches count. Texts are walked once,
    and the hits wait in the shared folder.
    """
    both = jobs.select("job_id", F.concat_ws("\n\n", F.coalesce("title", F.lit("")), F.coalesce("description", F.lit(""))).alias("text"), F.char_length(F.coalesce("title", F.lit(""))).alias("cut"))
    found = matches(both, skills, "job_id", keep=("cut",)).withColumnRenamed("doc_id", "job_id")
    field = F.when(F.col("end") <= F.col("cut"), "title").when(F.col("start") >= F.col("cut") + 2, "description")
    shift = F.when(F.col("end") <= F.col("cut"), 0).otherwise(F.col("cut") + 2)
    placed = found.select("job_id", "canonical", "alias", field.alias("evidence_field"), (F.col("start") - shift).alias("start"), (F.col("end") - shift).alias("end"), "evidence")
    placed = cut_off(placed)  # read for the matches, for the failures and to part them
    failures = placed.where("evidence_field is null").select("job_id", F.lit("match").alias("stage"), F.lit("evidence crosses title and description").alias("error")).distinct()
    return placed.join(failures.select("job_id"), "job_id", "left_anti"), failures
