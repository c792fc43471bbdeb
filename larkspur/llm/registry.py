"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from larkspur.llm import bpe_codec, chat_format, embedding_dedup, html_extract, line_dedup, lm_scoring, mixing, ngram_join, oracles, quality_rules, token_counts


def queries():
    return {
        "op1_token_counts": token_counts.query,
        "op2_html_extract": html_extract.query,
        "op3_chat_format": chat_format.query,
        "op4_mixing": mixing.query,
        "op5_bpe_codec": bpe_codec.query,
        "op9_lm_scoring": lm_scoring.query,
        "op10_embedding_dedup": embedding_dedup.query,
        "op6_ngram_jaccard_join": ngram_join.query,
        "op8_line_dedup": line_dedup.query,
        "op7_quality_rules": quality_rules.query,
    }


def oracle_sql():
    return oracles.oracle_sql()
