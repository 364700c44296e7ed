"""The queries of this subpackage and their DuckDB counterparts, by name."""

from __future__ import annotations

import corpus_pipeline
from dataheal.llm import bpe, centroids, decontaminate, html, jaccard, language, licenses, packing, quality, resample, secrets, shards, tokencounts


def queries() -> dict:
    return {
        "op1_html_extraction": html.query,
        "op2_secret_scan": secrets.query,
        "op3_ngram_join": jaccard.query,
        "op4_packing": packing.query,
        "op5_sharding": shards.query,
        "op6_quality_rules": quality.query,
        "op7_token_counts": tokencounts.query,
        "op8_license_scan": licenses.query,
        "op9_decontamination": decontaminate.query,
        "op10_language_id": language.query,
        "op11_centroid_clustering": centroids.query,
        "op12_importance_resampling": resample.query,
        "op13_bpe_round_trip": bpe.query,
        "pipeline": corpus_pipeline.run,
    }


def oracle_sql() -> dict:
    return {
        "op3_ngram_join": jaccard.sql(),
        "op8_license_scan": licenses.sql(),
        "op9_decontamination": decontaminate.sql(),
        "op11_centroid_clustering": centroids.sql(),
        "op12_importance_resampling": resample.sql(),
    }
