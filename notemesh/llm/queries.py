"""Queries of the corpus-preparation operators, by problem number."""

from __future__ import annotations

import importlib

from notemesh.plans.registry import Registry

REGISTRY = Registry()

for _name in ("tokenize", "neardup", "neighbours", "names", "residue", "markup", "pii", "language", "pairs", "packing"):
    importlib.import_module(f"notemesh.llm.{_name}").register(REGISTRY)
