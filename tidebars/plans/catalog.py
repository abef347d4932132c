"""All registered queries."""

from __future__ import annotations

import importlib

MODULES = ["sources_sinks", "relational", "windows", "ledgers", "aggregates", "trading", "resampling", "streams"]


def catalog() -> dict:
    out = {}
    for m in MODULES:
        for k, v in importlib.import_module(f"tidebars.plans.{m}").Q.items():
            assert k not in out, k
            out[k] = v
    return out
