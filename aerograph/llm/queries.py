"""The registered queries of this subpackage, and their SQL."""

from __future__ import annotations

import importlib

#: Query name to module and function of this subpackage.
QUERIES = {
    "op1_media_columns": "media",
    "op2_license_scan": "licenses",
    "op3_toxicity": "toxicity",
    "op4_ctw": "ctw",
    "op5_token_counts": "tokencounts",
    "op6_decontamination": "decontam",
    "op7_pii": "pii",
    "op8_mixing": "mixing",
    "op9_near_dedup": "dedup",
    "op10_url_filters": "urls",
}
SQL = {"op2_license_scan": ("licenses", "OP2_SQL"), "op9_near_dedup": ("dedup", "OP9_SQL"), "op10_url_filters": ("urls", "OP10_SQL")}


def module(name: str):
    return importlib.import_module(f"{__package__}.{name}")


def queries() -> dict:
    import corpus_pipeline

    return {name: getattr(module(m), name) for name, m in QUERIES.items()} | {"pipeline": corpus_pipeline.run}


def oracle_sql() -> dict[str, str]:
    import corpus_pipeline

    found = {name: getattr(module(m), attr) for name, (m, attr) in SQL.items()}
    return found | ({"pipeline": corpus_pipeline.ORACLE_SQL} if corpus_pipeline.ORACLE_SQL else {})
