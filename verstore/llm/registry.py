"""Queries of the ten operators and of the pipeline, and the SQL of some."""

from __future__ import annotations

from . import audio_features, jaccard_join, language_id, license_scan, mixing, secret_scan, sentence_pieces, token_output, toxicity, vector_search


def queries() -> dict:
    return {
        "op1_token_output": token_output.query,
        "op2_language_id": language_id.query,
        "op3_toxicity": toxicity.query,
        "op4_audio_features": audio_features.query,
        "op5_license_scan": license_scan.query,
        "op6_mixing": mixing.query,
        "op7_sentence_pieces": sentence_pieces.query,
        "op8_secret_scan": secret_scan.query,
        "op9_vector_search": vector_search.query,
        "op10_jaccard_join": jaccard_join.query,
    }


def oracle_sql() -> dict:
    return {"op5_license_scan": license_scan.oracle(), "op10_jaccard_join": jaccard_join.oracle()}
