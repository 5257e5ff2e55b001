"""Queries and SQL of the corpus operators, one for each."""

from __future__ import annotations

from . import (
    chat_format,
    decontaminate,
    exact_dedup,
    html_text,
    jaccard_join,
    language_id,
    line_dedup,
    packing,
    token_counts,
    warc,
)

QUERIES = {
    "op1_html_text": html_text.op1_html_text,
    "op2_exact_dedup": exact_dedup.op2_exact_dedup,
    "op3_token_counts": token_counts.op3_token_counts,
    "op4_jaccard_join": jaccard_join.op4_jaccard_join,
    "op5_language_id": language_id.op5_language_id,
    "op6_best_fit_packing": packing.op6_best_fit_packing,
    "op7_line_dedup": line_dedup.op7_line_dedup,
    "op8_decontaminate": decontaminate.op8_decontaminate,
    "op9_warc": warc.op9_warc,
    "op10_chat_format": chat_format.op10_chat_format,
}
SQL = {
    "op2_exact_dedup": exact_dedup.OP2_SQL,
    "op4_jaccard_join": jaccard_join.OP4_SQL,
    "op7_line_dedup": line_dedup.OP7_SQL,
    "op8_decontaminate": decontaminate.OP8_SQL,
    "op9_warc": warc.OP9_SQL,
    "op10_chat_format": chat_format.OP10_SQL,
}
