"""The queries of this subpackage and their SQL, by name."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from quern.llm import alignment, html_text, lang_id, line_dedup, lm_scoring, mixing, near_dedup, packing, quality, substring_dedup, topk_search, transport_stream, whitening

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_lm_scoring": lm_scoring.op1_lm_scoring,
    "op2_line_dedup": line_dedup.op2_line_dedup,
    "op3_topk_search": topk_search.op3_topk_search,
    "op4_quality": quality.op4_quality,
    "op5_media": transport_stream.op5_media,
    "op6_mixing": mixing.op6_mixing,
    "op7_lang_id": lang_id.op7_lang_id,
    "op8_packing": packing.op8_packing,
    "op9_html_text": html_text.op9_html_text,
    "op10_near_dedup": near_dedup.op10_near_dedup,
    "op11_whitening": whitening.op11_whitening,
    "op12_alignment": alignment.op12_alignment,
    "op13_substring_dedup": substring_dedup.op13_substring_dedup,
}

SQL: dict[str, str] = {
    "op2_line_dedup": line_dedup.OP2_SQL,
    "op3_topk_search": topk_search.OP3_SQL,
    "op6_mixing": mixing.OP6_SQL,
    "op10_near_dedup": near_dedup.OP10_SQL,
    "op13_substring_dedup": substring_dedup.OP13_SQL,
}
