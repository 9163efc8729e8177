"""Loads every module of registered queries."""

from __future__ import annotations

from importlib import import_module

from palisade.plans.catalogue import QUERIES, Registered

MODULES = (
    "scoring", "summaries", "findings", "relations", "code", "inventory", "lifecycle", "guidance", "reporting", "walking", "history", "extensions", "documents",
)


def registered() -> dict[str, Registered]:
    for module in MODULES:
        import_module(f"palisade.plans.registered.{module}")
    return QUERIES
