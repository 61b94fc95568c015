"""All registered queries. Importing a section registers it."""

from __future__ import annotations

from importlib import import_module

from velotide.registry.base import ORACLES, QUERIES

SECTIONS = (
    "cleaning",
    "stations",
    "grid",
    "dims",
    "features",
    "forecast",
    "models",
    "report",
    "analysis",
    "explore",
    "sources",
)


def load():
    for section in SECTIONS:
        import_module(f"velotide.registry.{section}")
    return QUERIES, ORACLES
