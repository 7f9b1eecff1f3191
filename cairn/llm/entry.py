"""The subpackage's registered queries and their SQL."""

from __future__ import annotations

import corpus_pipeline

from . import decontaminate, language_id, license_scan, ngram_join, packing, periodic, pii, quality_rules, repeats, search, secrets, sharding, token_counts


def queries() -> dict:
    return {
        "op1_ngram_join": ngram_join.query,
        "op2_language_id": language_id.query,
        "op3_sharding": sharding.query,
        "op4_token_counts": token_counts.query,
        "op5_quality_rules": quality_rules.query,
        "op6_pii_surrogates": pii.query,
        "op7_license_scan": license_scan.query,
        "op8_secret_scan": secrets.query,
        "op9_packing": packing.query,
        "op10_decontamination": decontaminate.query,
        "op11_suffix_dedup": repeats.query,
        "op12_periodic_runs": periodic.query,
        "op13_ranked_search": search.query,
        "pipeline": corpus_pipeline.run,
    }


def oracle_sql() -> dict[str, str]:
    sql = {"op3_sharding": sharding.SQL, "op13_ranked_search": search.SQL, "pipeline": corpus_pipeline.ORACLE_SQL}
    return {k: v for k, v in sql.items() if v}
