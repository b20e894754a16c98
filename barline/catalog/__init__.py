"""Named queries over the warehouse tables."""

from __future__ import annotations

from importlib import import_module

MODULES = ["screens", "markets", "newsdesk", "streams"]


def load():
    """Import every module of named queries and return the registry."""
    for module in MODULES:
        import_module(f"barline.catalog.{module}")
    return import_module("barline.catalog.registry")
