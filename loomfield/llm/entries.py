"""Queries and SQL of the training-data operators."""

from __future__ import annotations

from . import anchors, bwt, decontamination, hyperminhash, language_model, merkle, mixing, pii, pipeline, quality, secrets, simhash, spelling, tokens


def queries() -> dict:
    return {
        "op1_secret_scan": secrets.op1_secret_scan,
        "op2_quality_rules": quality.op2_quality_rules,
        "op3_language_model": language_model.op3_language_model,
        "op4_substring_dedup": anchors.op4_substring_dedup,
        "op5_token_counts": tokens.op5_token_counts,
        "op6_suffix_array_dedup": bwt.op6_suffix_array_dedup,
        "op7_pii": pii.op7_pii,
        "op8_decontamination": decontamination.op8_decontamination,
        "op9_simhash": simhash.op9_simhash,
        "op10_mix_sources": mixing.op10_mix_sources,
        "op11_merkle_manifest": merkle.op11_merkle_manifest,
        "op12_hyperminhash": hyperminhash.op12_hyperminhash,
        "op13_spelling_variants": spelling.op13_spelling_variants,
        "pipeline": pipeline.run,
    }


def oracle_sql() -> dict:
    return {
        "op1_secret_scan": secrets.secrets_sql(),
        "op2_quality_rules": quality.quality_sql(),
        "op4_substring_dedup": anchors.repeats_sql(),
        "op8_decontamination": decontamination.contained_sql(),
        "op10_mix_sources": mixing.mix_sql(),
        "op11_merkle_manifest": merkle.manifest_sql(),
        "op13_spelling_variants": spelling.variants_sql(),
    }
