"""The registered queries of the operators and their SQL, where SQL can express them."""

from __future__ import annotations

from storyline.llm import decontaminate, fertility, licenses, packing, parity, pii, resampling, secret_scan, sharding, simhash, toxicity, urls, whitening

QUERIES = {
    "op1_license_scan": licenses.query,
    "op2_url_filter": urls.query,
    "op3_toxicity": toxicity.query,
    "op4_secret_scan": secret_scan.query,
    "op5_simhash_near_dedup": simhash.query,
    "op6_benchmark_decontamination": decontaminate.query,
    "op7_tokenizer_fertility": fertility.query,
    "op8_sharding": sharding.query,
    "op9_personal_data": pii.query,
    "op10_best_fit_packing": packing.query,
    "op11_parity_jaccard": parity.query,
    "op12_importance_resampling": resampling.query,
    "op13_whitening": whitening.query,
}
ORACLE_SQL = {"op6_benchmark_decontamination": decontaminate.ORACLE, "op12_importance_resampling": resampling.ORACLE}
