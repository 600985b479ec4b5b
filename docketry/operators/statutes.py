"""Provisions of an act from the text of its pages: headings, bodies, page ranges, what is left out."""

from __future__ import annotations

import re
from bisect import bisect_right

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from docketry.functions.text import section_key

# The line that begins an act, a numbered heading, and headings of other material.
ENACTED = r"\bBE\s+it\s+enacted\b"
HEADING = r"(?m)^\s*(?P<section>[1-9]\d{0,2}[A-Z]{0,2})\.(?=\s|\(|[A-Za-z\"“\[])"
OTHER_MATERIAL = r"(?im)^\s*(?:the\s+)?(?:(?:first|second|third|fourth|fifth|sixth|seventh|eighth|ninth|tenth)\s+)?(?:schedule|appendix|state\s+amendments?)\b"

CANDIDATE = "act_id string, ord int, section string, text string, page_start int, page_end int"


def candidates(pages: list[tuple[int, str]]) -> list[tuple[str, str, int, int]]:
    """``(section, text, first page, last page)`` of every numbered heading, in order; pages are ``(number, text)``."""
    pages = sorted(pages)
    starts, whole = [], ""
    for _, text in pages:
        starts.append(len(whole))
        whole += text.rstrip("\n") + "\n"
    page = lambda at: pages[max(0, bisect_right(starts, at) - 1)][0]
    found = list(re.finditer(HEADING, whole))
    out = []
    for m, following in zip(found, [*found[1:], None], strict=True):
        end = following.start() if following else len(whole)
        other = re.search(OTHER_MATERIAL, whole[m.end() : end])
        if other:
            end = m.end() + other.start()
        body = whole[m.start("section") : end].strip()
        last = m.start("section") + len(whole[m.start("section") : end].rstrip()) - 1
        out.append((m["section"], body, page(m.start("section")), page(max(m.start("section"), last))))
    return out


def split_acts(pages: DataFrame, enacted: str = ENACTED) -> DataFrame:
    """Candidates of ``act_id, page_no, text``: an act's pages, from the one that holds its first words, go to one task."""

    def cut(frame: pd.DataFrame) -> pd.DataFrame:
        rows = sorted(zip(frame["page_no"].tolist(), frame["text"].fillna("").tolist(), strict=True))
        first = next((i for i, (_, t) in enumerate(rows) if re.search(enacted, t, re.I)), 0)
        if rows:
            m = re.search(enacted, rows[first][1], re.I)
            rows[first] = (rows[first][0], rows[first][1][m.start() if m else 0 :])
        found = candidates(rows[first:])
        return pd.DataFrame([(frame["act_id"].iloc[0], i, *c) for i, c in enumerate(found)], columns=[c.split()[0] for c in CANDIDATE.split(", ")])

    return pages.groupBy("act_id").applyInPandas(cut, CANDIDATE)


def kept(rows: DataFrame) -> DataFrame:
    """Candidates with ``kept``: a section stays if it comes after every one before it."""
    w = Window.partitionBy("act_id").orderBy("ord").rowsBetween(Window.unboundedPreceding, -1)
    key = rows.withColumn("k", section_key(F.col("section")))
    before = F.max("k").over(w)
    return key.withColumn("before", before).withColumn("kept", F.col("before").isNull() | (F.col("k") > F.col("before"))).drop("k", "before")
