"""Every query of the library by name, and SQL for those that SQL can express."""

from __future__ import annotations

from stresslens.plans import registry


def _load() -> None:
    from stresslens.plans import corpus_queries, feature_queries, manifest_queries, metric_queries, operating_queries, stress_queries, validation_queries  # noqa: F401


def queries() -> dict[str, registry.Query]:
    _load()
    return dict(registry.QUERIES)


def oracle_sql() -> dict[str, str]:
    _load()
    return dict(registry.ORACLES)
