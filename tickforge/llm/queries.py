"""The queries of this subpackage and their DuckDB counterparts, where SQL can express them."""

from __future__ import annotations

from importlib import import_module

#: Query name to the module that holds it.
MODULES = {
    "op2_external_shuffle": "sharding",
    "op3_best_fit_packing": "packing",
    "op10_bpe_automaton": "bpe",
    "op4_pii_spans": "pii",
    "op7_gif_columns": "gif",
    "op9_linked_secrets": "secrets",
    "op8_toxicity_kernel_svm": "toxicity",
    "op5_minhash_tensored": "minhash",
    "op6_suffix_array_repeats": "suffixes",
    "op1_bm25_topk": "search",
}


def queries() -> dict:
    return {name: getattr(import_module(f"{__package__}.{module}"), name) for name, module in MODULES.items()}


def oracle_sql() -> dict[str, str]:
    found = {}
    for module in dict.fromkeys(MODULES.values()):
        found |= getattr(import_module(f"{__package__}.{module}"), "ORACLE_SQL", {})
    return found
