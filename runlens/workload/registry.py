"""Collects the registered queries: name -> (Spark callable, DuckDB text or None, inventory ids)."""

from __future__ import annotations

import importlib
import importlib.util
from collections.abc import Callable

QUERIES: dict[str, Callable] = {}
ORACLES: dict[str, str] = {}
COVERS: dict[str, list[str]] = {}
MODULES = ["q_scalars", "q_reports", "q_estimates", "q_placement", "q_telemetry", "q_queue", "q_inventory", "q_sources", "q_streaming"]


def query(name: str, covers: str, oracle: str | None = None):
    """Registers `fn(spark, sf_dir)`; `covers` lists the inventory ids it exercises."""

    def wrap(fn):
        if name in QUERIES:
            raise ValueError(f"query {name} registered twice")
        QUERIES[name] = fn
        COVERS[name] = covers.split()
        if oracle is not None:
            ORACLES[name] = oracle
        return fn

    return wrap


def load() -> None:
    for m in MODULES:
        if importlib.util.find_spec(f"runlens.workload.{m}"):
            importlib.import_module(f"runlens.workload.{m}")
