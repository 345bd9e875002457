"""The queries of this folder and their SQL."""

from __future__ import annotations

import importlib

#: Query: its module here.
QUERIES = {
    "op1_media_columns": "media",
    "op2_simhash_near_dedup": "simhash",
    "op3_best_fit_packing": "packing",
    "op4_substring_dedup": "substrings",
    "op5_token_files": "rans",
    "op6_mix_sources": "mixing",
    "op7_language_id": "langid",
    "op8_lm_scoring": "lm",
    "op9_nearest_neighbours": "ann",
    "op10_html_extraction": "html",
    "op11_toxicity": "toxicity",
    "op12_importance_resampling": "resample",
    "op13_source_divergence": "divergence",
}
ORACLES = {"op6_mix_sources": "mixing", "op12_importance_resampling": "resample", "op13_source_divergence": "divergence"}


def _of(module: str):
    return importlib.import_module(f"ledgerloom.llm.{module}")


def queries() -> dict:
    return {name: getattr(_of(module), name) for name, module in QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: _of(module).oracle() for name, module in ORACLES.items()}
