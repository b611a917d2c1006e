"""Queries of this subpackage and, where SQL can express them, their DuckDB twins."""

from __future__ import annotations

import corpus_pipeline

from . import bpe, chat, fingerprint, html_text, language, mixing, near_dedup, pii, quality_classifier, quality_rules

QUERIES = {
    "op1_mixing": mixing.op1_mixing,
    "op2_near_dedup": near_dedup.op2_near_dedup,
    "op3_preferences": chat.op3_preferences,
    "op4_html_text": html_text.op4_html_text,
    "op5_quality_rules": quality_rules.op5_quality_rules,
    "op6_fingerprint": fingerprint.op6_fingerprint,
    "op7_quality": quality_classifier.op7_quality,
    "op8_language": language.op8_language,
    "op9_pii": pii.op9_pii,
    "op10_bpe": bpe.op10_bpe,
    "pipeline": corpus_pipeline.run,
}
SQL = {"op1_mixing": mixing.SQL, "op3_preferences": chat.SQL}
if corpus_pipeline.ORACLE_SQL:
    SQL["pipeline"] = corpus_pipeline.ORACLE_SQL
