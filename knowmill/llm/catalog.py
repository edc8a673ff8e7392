"""Queries of the corpus operators and their SQL twins."""

from __future__ import annotations

from knowmill.llm import chat, decontaminate, html_text, near, phrases, pieces, pii, pipeline, pivots, quality, sharding, urls, vector_codes, warc


def queries() -> dict:
    return {
        "op1_warc": warc.query,
        "op2_quality_rules": quality.query,
        "op3_url_filters": urls.query,
        "op4_jump_sharding": sharding.query,
        "op5_ngram_jaccard_join": near.query,
        "op6_chat_formatting": chat.query,
        "op7_benchmark_decontamination": decontaminate.query,
        "op8_sentencepiece": pieces.query,
        "op9_html_extraction": html_text.query,
        "op10_pii": pii.query,
        "op11_vector_codes": vector_codes.query,
        "op12_phrases": phrases.query,
        "op13_permutation_index": pivots.query,
        "pipeline": pipeline.run,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op1_warc": warc.oracle(),
        "op2_quality_rules": quality.oracle(),
        "op3_url_filters": urls.oracle(),
        "op4_jump_sharding": sharding.oracle(),
        "op6_chat_formatting": chat.oracle(),
        "op7_benchmark_decontamination": decontaminate.oracle(),
        "op9_html_extraction": html_text.oracle(),
        "op11_vector_codes": vector_codes.oracle(),
        "op12_phrases": phrases.oracle(),
    }
