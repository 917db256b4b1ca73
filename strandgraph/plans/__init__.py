"""Queries over the star schema, one or more for each operator."""

from __future__ import annotations

import importlib

MODULES = ["graphs", "relational", "dataflow", "programs", "context", "scalars", "lanes", "files"]


def _load():
    for m in MODULES:
        importlib.import_module(f"strandgraph.plans.{m}")
    return importlib.import_module("strandgraph.plans.registry")


def all_queries() -> dict:
    return _load().QUERIES


def all_sql() -> dict:
    return _load().SQL
