"""Queries of the training-data operators."""

from . import decontaminate, html_extract, near_dedup, pieces, pii, pipeline, quality_classifier, quality_rules, secrets, sharding, substring_dedup

MODULES = (near_dedup, substring_dedup, secrets, quality_classifier, pii, quality_rules, sharding, html_extract, decontaminate, pieces)


def queries() -> dict:
    out = {name: q for m in MODULES for name, q in m.QUERIES.items()}
    out["pipeline"] = pipeline.run
    return out


def oracle_sql() -> dict[str, str]:
    return {name: q for m in MODULES for name, q in m.ORACLE_SQL.items()}
