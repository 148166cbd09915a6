"""Registered queries: each pairs a DataFrame job with the SQL that checks it."""

from __future__ import annotations

import importlib

from benefica.plans.registry import REGISTRY

MODULES = ["fraud", "projections", "validation", "joins", "aggregates", "ordering", "scalars",
           "resolution", "graphs", "learning", "exchange", "streams",
           "surfaces"]


def load() -> dict:
    for m in MODULES:
        importlib.import_module(f"benefica.plans.{m}")
    return REGISTRY
