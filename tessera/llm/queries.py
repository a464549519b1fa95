"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from importlib import import_module

_MODULES = {
    "op1_warc": "warc", "op2_secret_scans": "secret_scan", "op3_bpe": "bpe", "op4_html_extraction": "html_cut",
    "op5_nearest_neighbours": "lsh_forest", "op6_exact_top_k": "histogram_topk", "op7_ngram_jaccard": "jaccard_join",
    "op8_packing": "packing", "op9_quality": "quality_gam", "op10_suffix_dedup": "suffix_dedup",
}


def _query(module: str):
    def run(spark, sf_dir):
        return import_module(f"{__package__}.{module}").query(spark, sf_dir)

    return run


def queries() -> dict:
    return {name: _query(module) for name, module in _MODULES.items()}


def oracle_sql() -> dict[str, str]:
    from . import sql

    return dict(sql.ORACLE)
