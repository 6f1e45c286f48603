"""Registered queries by area."""

from __future__ import annotations

import importlib

from rankloom.catalog.registry import CHECKS, QUERIES

AREAS = ["derived", "scalars", "search_console", "ranks", "results", "keywords", "gaps", "pages",
         "audits", "maintenance", "recommendations", "projects", "streams"]


def _load() -> None:
    for area in AREAS:
        importlib.import_module(f"rankloom.catalog.{area}")


def all_queries() -> dict:
    _load()
    return dict(QUERIES)


def all_checks() -> dict:
    _load()
    return dict(CHECKS)
