"""Registered queries, by topic. :func:`load` imports every module here, and those of the sources and streams, which registers their queries."""

from __future__ import annotations

import importlib
import pkgutil


def load() -> None:
    for module in pkgutil.iter_modules(__path__):
        importlib.import_module(f"{__name__}.{module.name}")
    for name in ("docketry.sources.files", "docketry.streaming.events"):
        importlib.import_module(name)
