"""The registered queries of this subpackage, and their SQL."""

from __future__ import annotations

from rankloom.llm import op1_mix, op2_toxicity, op3_pii, op4_records, op5_embeddings, op6_simhash, op7_licenses, op8_packing, op9_urls, op10_quality


def queries() -> dict:
    import corpus_pipeline

    found = [
        op1_mix.op1_mix_sources,
        op2_toxicity.op2_toxicity,
        op3_pii.op3_pii,
        op4_records.op4_token_records,
        op5_embeddings.op5_embedding_near_dedup,
        op6_simhash.op6_simhash_near_dedup,
        op7_licenses.op7_license_scan,
        op8_packing.op8_best_fit_packing,
        op9_urls.op9_url_filter,
        op10_quality.op10_quality_rules,
    ]
    return {f.__name__: f for f in found} | {"pipeline": corpus_pipeline.run}


def oracle_sql() -> dict[str, str]:
    return {"op1_mix_sources": op1_mix.SQL, "op7_license_scan": op7_licenses.SQL}
