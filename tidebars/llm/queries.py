"""The registered queries of this package: name -> (function, SQL or None)."""

from __future__ import annotations

from importlib import import_module

MODULES = ("chunk_recipes", "line_dedup", "winnowing", "token_counts", "bpe_automaton", "secret_scan", "dom_marginals", "rule_ensemble", "set_join", "warc", "lexical_search", "anchor_cover", "spelling_groups")


def catalog() -> dict:
    out = {}
    for name in MODULES:
        out |= import_module(f"tidebars.llm.{name}").QUERIES
    return out
