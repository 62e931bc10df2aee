"""All registered queries in one place."""

from __future__ import annotations

from cartlens.plans import registry, registry_effect, registry_models, registry_reports

_MODULES = (registry, registry_reports, registry_effect, registry_models)


def queries():
    return dict(registry.QUERIES)


def oracle_sql():
    return dict(registry.ORACLES)
