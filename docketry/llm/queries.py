"""Imports every query module of the subpackage; ``LLM`` then holds their queries."""

from __future__ import annotations

import importlib
import pkgutil

from docketry.llm.registry import LLM

import docketry.llm as _package

for _module in pkgutil.iter_modules(_package.__path__):
    if _module.name.startswith("q_"):
        importlib.import_module(f"docketry.llm.{_module.name}")

__all__ = ["LLM"]
