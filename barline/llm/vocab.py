"""Where the public vocabulary files are. They are installed on every machine and never copied."""

from __future__ import annotations

from importlib import import_module


def path(name: str) -> str:
    return import_module("public_tokenizers").path(name)
