"""The registered queries of this subpackage, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

import corpus_pipeline
from tidemark.llm.chat_format import OP10_SQL, op10_chat_format
from tidemark.llm.contamination import OP2_SQL, op2_decontamination
from tidemark.llm.hash_index import OP13_SQL, op13_exact_dedup
from tidemark.llm.html_text import op6_html_extraction
from tidemark.llm.language_id import op8_language_id
from tidemark.llm.lexical_search import OP11_SQL, op11_lexical_search
from tidemark.llm.near_duplicates import op3_minhash_near_dedup
from tidemark.llm.packing import op4_packing
from tidemark.llm.piece_table import OP12_SQL, op12_fill_in_middle
from tidemark.llm.quality_classifier import op5_quality_classifier
from tidemark.llm.repeats import op1_substring_dedup
from tidemark.llm.robust_rules import op9_quality_rules
from tidemark.llm.token_counts import op7_token_counts

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_substring_dedup": op1_substring_dedup,
    "op2_decontamination": op2_decontamination,
    "op3_minhash_near_dedup": op3_minhash_near_dedup,
    "op4_packing": op4_packing,
    "op5_quality_classifier": op5_quality_classifier,
    "op6_html_extraction": op6_html_extraction,
    "op7_token_counts": op7_token_counts,
    "op8_language_id": op8_language_id,
    "op9_quality_rules": op9_quality_rules,
    "op10_chat_format": op10_chat_format,
    "op11_lexical_search": op11_lexical_search,
    "op12_fill_in_middle": op12_fill_in_middle,
    "op13_exact_dedup": op13_exact_dedup,
    "pipeline": corpus_pipeline.run,
}
SQL: dict[str, str] = {
    "op2_decontamination": OP2_SQL,
    "op10_chat_format": OP10_SQL,
    "op11_lexical_search": OP11_SQL,
    "op12_fill_in_middle": OP12_SQL,
    "op13_exact_dedup": OP13_SQL,
}
