"""Queries of the corpus operators and their SQL, for the registry."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from postwright.llm.chunks import op10_substring_dedup
from postwright.llm.conversations import OP11_SQL, op11_conversation_repair
from postwright.llm.fingerprints import op4_fingerprints
from postwright.llm.html_text import op9_html_extraction
from postwright.llm.lines import OP1_SQL, op1_line_dedup
from postwright.llm.mixing import OP3_SQL, op3_mixing
from postwright.llm.ngram_join import OP2_SQL, op2_ngram_join
from postwright.llm.packing import op5_packing
from postwright.llm.quality_model import op8_quality_classifier
from postwright.llm.quality_rules import OP6_SQL, op6_quality_rules
from postwright.llm.token_files import op12_token_files
from postwright.llm.toxicity import op7_toxicity
from postwright.llm.vector_codes import OP13_SQL, op13_vector_codes

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_line_dedup": op1_line_dedup,
    "op2_ngram_join": op2_ngram_join,
    "op3_mixing": op3_mixing,
    "op4_fingerprints": op4_fingerprints,
    "op5_packing": op5_packing,
    "op6_quality_rules": op6_quality_rules,
    "op7_toxicity": op7_toxicity,
    "op8_quality_classifier": op8_quality_classifier,
    "op9_html_extraction": op9_html_extraction,
    "op10_substring_dedup": op10_substring_dedup,
    "op11_conversation_repair": op11_conversation_repair,
    "op12_token_files": op12_token_files,
    "op13_vector_codes": op13_vector_codes,
}

SQL: dict[str, str] = {
    "op1_line_dedup": OP1_SQL,
    "op2_ngram_join": OP2_SQL,
    "op3_mixing": OP3_SQL,
    "op6_quality_rules": OP6_SQL,
    "op11_conversation_repair": OP11_SQL,
    "op13_vector_codes": OP13_SQL,
}
