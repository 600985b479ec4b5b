"""Expressions over record ids."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def tidy(column: Column | str) -> Column:
    """An id as it compares: without outer white space and letter case."""
    c = F.col(column) if isinstance(column, str) else column
    return F.lower(F.regexp_replace(c, r"^\s+|\s+$", ""))


def up_to_last_colon(column: Column) -> Column:
    """``provision:india:kpc:302:sha256-x`` to ``provision:india:kpc:302:``; '' where there is no colon."""
    return F.regexp_replace(column, "[^:]*$", "")
