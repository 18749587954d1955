"""Collects the queries of all plan modules."""

from __future__ import annotations

import importlib
import pkgutil
from collections.abc import Callable

import sedge.plans as plans


def _modules() -> list:
    names = sorted(m.name for m in pkgutil.iter_modules(plans.__path__) if m.name != "registry")
    return [importlib.import_module(f"sedge.plans.{n}") for n in names]


def all_queries() -> dict[str, Callable]:
    """name -> callable(spark, sf_dir) of every plan module."""
    return {k: v for m in _modules() for k, v in m.QUERIES.items()}


def all_sql() -> dict[str, str]:
    """name -> SQL of every plan module."""
    return {k: v for m in _modules() for k, v in m.SQL.items()}
