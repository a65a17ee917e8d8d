"""The queries of this subpackage, by name, and DuckDB SQL for those that SQL can express."""

from __future__ import annotations

import corpus_pipeline

from . import decontamination, html_text, language_id, mixing, pii, quality_classifier, quality_rules, simhash, substrings, warc

QUERIES = {
    "op1_pii_spans": pii.query,
    "op2_mix_sources": mixing.query,
    "op3_language_id": language_id.query,
    "op4_quality_classifier": quality_classifier.query,
    "op5_quality_rules": quality_rules.query,
    "op6_simhash_near_dedup": simhash.query,
    "op7_page_text": html_text.query,
    "op8_repeated_passages": substrings.query,
    "op9_benchmark_tiling": decontamination.query,
    "op10_warc_round_trip": warc.query,
    "pipeline": corpus_pipeline.run,
}

ORACLES = {
    "op2_mix_sources": mixing.ORACLE,
    "op8_repeated_passages": substrings.ORACLE,
    "op10_warc_round_trip": warc.ORACLE,
}
if corpus_pipeline.ORACLE_SQL:
    ORACLES["pipeline"] = corpus_pipeline.ORACLE_SQL
