"""The registered queries and their SQL."""

from __future__ import annotations

from importlib import import_module

from .plans import registry

#: Modules of plans; importing one registers its queries.
MODULES = ["texts", "corpus", "webchat", "analytics", "streams", "evidences", "more", "mixtures", "formats"]
for _name in MODULES:
    import_module(f"lakemill.plans.{_name}")

QUERIES, SQL = registry.QUERIES, registry.SQL
