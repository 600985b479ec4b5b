"""References in texts: every match with its place, by grammars over a registry of acts and reporters.

Offsets of all matches cannot be had from SQL, so one Arrow UDF finds them; everything after it is SQL.
"""

from __future__ import annotations

import hashlib
import re
from dataclasses import dataclass
from functools import cached_property

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructField, StructType

# Names of the acts (without spaces and dots, lower case) and their ids.
ACTS = {
    "indianpenalcode": "ipc", "ipc": "ipc", "penalcode": "ipc", "bharatiyanyayasanhita": "bns", "bns": "bns", "bharatiyanagariksurakshasanhita": "bnss", "bnss": "bnss",
    "codeofcriminalprocedure": "crpc", "crpc": "crpc", "evidenceact": "iea", "indianevidenceact": "iea",
}
# The acts as written, by version of the grammar.
NAMES_V1 = r"Indian\s+Penal\s+Code|IPC|Bharatiya\s+Nyaya\s+Sanhita|BNS|Code\s+of\s+Criminal\s+Procedure|CrPC"
NAMES_V2 = (
    r"Bharatiya\s+Nagarik\s+Suraksha\s+Sanhita|BNSS|Bharatiya\s+Nyaya\s+Sanhita|BNS|Code\s+of\s+Criminal\s+Procedure|Cr\.?\s*P\.?\s*C\b\.?|"
    r"Indian\s+Penal\s+Code|Penal\s+Code|I\.\s*P\.\s*C\b\.?|IPC|(?:Indian\s+)?Evidence\s+Act"
)
# The grammars of what stands before the name of an act, of articles and of reports.
SECTION_V1 = r"\b(?:section|sec\.?|s\.)\s*(?P<section>\d+[A-Za-z]?(?:\s*\(\s*\d+[A-Za-z]?\s*\))?)\s*(?:of\s+(?:the\s+)?)?"
NUMBER = r"\d{1,3}[A-Z]{0,2}(?:\s*\(\s*[0-9A-Za-z]{1,4}\s*\))*"
SECTIONS_V2 = (
    r"\b(?:sections?|secs?\.?|ss\.|s\.|u/s\.?|u/ss\.?)\s*(?P<numbers>" + NUMBER + r"(?:\s*(?:,|and|or|&|/|to|read\s+with|r/w)\s*(?:sections?\s*|ss?\.\s*)?" + NUMBER + r")*)"
    r"(?P<gap>[^.;\n]{0,40}?)"
)
ARTICLES = r"\barticles?\s*(?P<numbers>" + NUMBER + r"(?:\s*(?:,|and|or|&|/|read\s+with|r/w)\s*(?:articles?\s*)?" + NUMBER + r")*)(?P<tail>[^.;\n]{0,60})"
OTHER_INSTRUMENT = r"^\s*(?:\(\w+\)\s*)*of\s+the\s+(?!Constitution)(?:[A-Z][\w,]*\s+){0,6}(?:Act|Convention|Covenant|Treaty|Agreement|Regulations?|Rules|Charter)\b"
REPORTS = r"\(\s*(?P<year>\d{4})\s*\)\s*(?P<volume>\d+)\s*SCC\s*(?P<page>\d+)\b"
ONLINE = r"\b(?P<year>\d{4})\s+SCC\s+OnLine\s+SC\s+(?P<number>\d+)\b"

_BRACKETS = re.compile(r"\(\s*[0-9A-Za-z]{1,4}\s*\)")
_ONE = re.compile(r"\d{1,3}[A-Z]{0,2}\b", re.I)


@dataclass(frozen=True)
class Grammar:
    """``version`` 1 or 2, the acts (compact name to id) and how they are written."""

    version: int = 2
    acts: tuple[tuple[str, str], ...] = tuple(ACTS.items())
    names: str = ""

    @property
    def method(self) -> str:
        return f"indian_regex_v{self.version}"

    @cached_property
    def _sections(self) -> re.Pattern:
        names = self.names or (NAMES_V1 if self.version == 1 else NAMES_V2)
        return re.compile(SECTION_V1 + f"(?P<act>{names})\\b" if self.version == 1 else SECTIONS_V2 + f"(?P<act>{names})", re.I)

    def _act(self, name: str) -> str | None:
        return dict(self.acts).get(re.sub(r"[\s.,]", "", name).lower())

    @staticmethod
    def numbers(listed: str) -> list[str]:
        """Base numbers of a list, each once: ``302, 34 and 120B(1)`` gives 302, 34, 120B."""
        return list(dict.fromkeys(n.upper() for n in _ONE.findall(_BRACKETS.sub(" ", listed))))

    def find(self, text: str) -> list[tuple[str, str, int, int, str, str]]:
        """``(kind, relation, start, end, raw, hint)`` in order of their places."""
        out = []

        def add(kind: str, start: int, end: int, hint: str) -> None:
            out.append((kind, "cites" if kind == "case" else "refers_to_provision", start, end, text[start:end], hint))

        for m in self._sections.finditer(text):
            act = self._act(m["act"])
            if act:
                listed = [re.sub(r"\s+", "", m["section"]).lower()] if self.version == 1 else self.numbers(m["numbers"])
                for n in listed:
                    add("provision", m.start(), m.end(), f"provision:india:{act}:{n}:")
        if self.version > 1:
            for m in re.finditer(ARTICLES, text, re.I):
                if not re.match(OTHER_INSTRUMENT, m["tail"]):
                    for n in self.numbers(m["numbers"]):
                        add("provision", m.start(), m.start("tail"), f"provision:india:constitution:{n}:")
        for m in re.finditer(REPORTS, text, re.I):
            add("case", m.start(), m.end(), f"case:india:reporter:scc:{m['year']}:{m['volume']}:{m['page']}")
        for m in re.finditer(ONLINE, text, re.I):
            add("case", m.start(), m.end(), f"case:india:reporter:scc-online-sc:{m['year']}:{m['number']}")
        if self.version == 1:
            return sorted(out, key=lambda r: (r[2], r[3], r[0]))
        first = {(r[2], r[5]): r for r in reversed(out)}  # the first of equal place and hint stays
        return sorted(first.values(), key=lambda r: (r[2], out.index(r)))


_MATCHES = ArrayType(StructType([StructField(n, IntegerType() if n in ("span_start", "span_end") else StringType()) for n in ("kind", "relation_type", "span_start", "span_end", "raw_text", "canonical_hint")]))


def matches(text: Column, grammar: Grammar) -> Column:
    """All references of a text as an array."""

    @F.pandas_udf(_MATCHES)
    def find(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: [] if t is None else [dict(zip(("kind", "relation_type", "span_start", "span_end", "raw_text", "canonical_hint"), r, strict=True)) for r in grammar.find(t)])

    return find(text)


def extract(documents: DataFrame, document: str, text: str, grammar: Grammar = Grammar()) -> DataFrame:
    """Candidates of every document: the columns of the data model, ids hashed from document, kind, place and hint."""
    rows = documents.select(F.col(document).alias("document_id"), F.explode(matches(F.col(text), grammar)).alias("m")).select("document_id", "m.*")
    seed = F.concat_ws("|", "document_id", "kind", F.col("span_start").cast("string"), F.col("span_end").cast("string"), "canonical_hint")
    return rows.select(F.concat(F.lit("extract:"), F.substring(F.sha2(seed, 256), 1, 16)).alias("extraction_id"), "*", F.lit(grammar.method).alias("method"), F.lit(0.95).alias("confidence"))


def extraction_id(document: str, kind: str, start: int, end: int, hint: str) -> str:
    return "extract:" + hashlib.sha256("|".join((document, kind, str(start), str(end), hint)).encode()).hexdigest()[:16]
