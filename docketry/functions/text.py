"""Column expressions over texts: tokens, spaces, dates, masked views, dispositions, header fields."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The phrases that state an outcome, in the order in which they are masked, and the labels.
LABELS = ("allowed", "dismissed", "disposed", "partly_allowed")
_SUBJECT = r"\b(?:appeal|petition|application|writ(?:\s+petition)?|special leave petition|civil appeal|criminal appeal)s?\s+(?:(?:is|are|stands?)\s+)?"
OUTCOMES = (
    ("partly_allowed", _SUBJECT + r"(?:partly|partially)\s+allowed\b"),
    ("allowed", _SUBJECT + r"allowed\b"),
    ("dismissed", _SUBJECT + r"dismissed\b"),
    ("disposed", _SUBJECT + r"disposed(?:\s+of)?\b"),
)

# Where a judgment's body starts, by priority.
BODY_STARTS = (
    r"(?i)(?:the\s+)?judgments?\s+of\s+the\s+court\s+(?:was|were)\s+delivered\s+by",
    r"(?i)(?:CIVIL|CRIMINAL|ORIGINAL)\s+(?:APPELLATE\s+)?JURISDICTION",
    r"(?m)^\s*#*\s*(?:O\s*R\s*D\s*E\s*R|JUDGMENT|J\s*U\s*D\s*G\s*M\s*E\s*N\s*T)\s*$",
)

# The wider phrases masked in body views.
_MATTER = (
    r"(?:appeals?|petitions?|applications?|writ\s+petitions?|special\s+leave\s+petitions?|civil\s+appeals?|"
    r"criminal\s+appeals?|SLPs?|review\s+petitions?|transfer\s+petitions?|suits?|cases?|matters?)"
)
BODY_MASKS = (
    rf"(?i)\b(?:partly\s+allowing|partially\s+allowing|allowing|dismissing|disposing\s+of|disposing)\b[^.;]{{0,60}}?\b{_MATTER}",
    rf"(?i)\b{_MATTER}\b[^.;]{{0,80}}?\b(?:partly\s+allowed|partially\s+allowed|allowed|dismissed|disposed\s+of|disposed)\b",
    r"(?i)\bwe\s+(?:partly\s+|partially\s+)?(?:allow|dismiss|dispose\s+of)\b",
    r"(?i)\b(?:deserves?|liable|fit|bound)\s+to\s+be\s+(?:partly\s+|partially\s+)?(?:allowed|dismissed|set\s+aside|quashed|upheld)\b",
    r"(?i)\bHELD\b\s*[:.-]?",
)
MASK = " outcome_phrase "
BODY_SHARE, BODY_LEAST, LABEL_SHARE = 0.7, 500, 0.8

# Official disposal values and their labels.
DISPOSALS = {"appeal(s) allowed": "allowed", "case allowed": "allowed", "dismissed": "dismissed", "disposed off": "disposed", "case partly allowed": "partly_allowed"}


def terms(text: Column) -> Column:
    """Tokens of ranked retrieval: runs of a-z and 0-9 in lower case."""
    return F.regexp_extract_all(F.lower(text), F.lit("([a-z0-9]+)"), F.lit(1))


def words(text: Column) -> Column:
    """Tokens of the count-based classifier: a letter, then two letters or hyphens or more."""
    return F.regexp_extract_all(F.lower(text), F.lit("([a-z][a-z-]{2,})"), F.lit(1))


def one_space(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"[ \t\r\n\f\x0B]+", " "))


def section_number(section: Column) -> Column:
    """The number of a section such as ``32A``; NULL where it has none."""
    return F.when(section.rlike("^[0-9]+[A-Z]{0,2}$"), F.regexp_extract(section, "^([0-9]+)", 1).cast("int"))


def section_key(section: Column) -> Column:
    """Sort key (number, suffix); sections without a number come last."""
    number = section_number(section)
    return F.struct(F.coalesce(number, F.lit(1_000_000_000)).alias("number"), F.when(number.isNotNull(), F.regexp_extract(section, "^[0-9]+([A-Z]*)$", 1)).otherwise(section).alias("suffix"))


_MONTHS = "JANUARY|FEBRUARY|MARCH|APRIL|MAY|JUNE|JULY|AUGUST|SEPTEMBER|OCTOBER|NOVEMBER|DECEMBER"


def decision_date(text: Column) -> Column:
    """The first date in the first 4,000 characters: ``Month D, YYYY`` before ``D Month YYYY``; of each only the first match counts."""
    head = F.substring(text, 1, 4000)

    def first(pattern: str, month: int, day: int, year: int) -> Column:
        part = [F.regexp_extract(head, pattern, i) for i in (month, day, year)]
        return F.try_to_date(F.concat_ws(" ", F.initcap(part[0]), part[1], part[2]), "MMMM d yyyy")

    return F.coalesce(
        first(rf"(?i)\b({_MONTHS})\s+(\d{{1,2}}),?\s+(\d{{4}})\b", 1, 2, 3),
        first(rf"(?i)\b(\d{{1,2}})(?:st|nd|rd|th)?\s+({_MONTHS}),?\s+(\d{{4}})\b", 2, 1, 3),
    )


def mask(text: Column, patterns: tuple[str, ...]) -> Column:
    for pattern in patterns:
        text = F.regexp_replace(text, pattern, MASK)
    return text


def input_view(text: Column, limit: int) -> Column:
    """The first ``limit`` characters with every outcome phrase masked."""
    return mask(F.substring(text, 1, limit), tuple("(?i)" + p for _, p in OUTCOMES))


def body_start(text: Column) -> Column:
    """Zero-based offset of the body: the first pattern, by priority, that is found; NULL without any."""
    return F.coalesce(*[F.when(text.rlike(p), F.regexp_instr(text, F.lit(p)) - 1) for p in BODY_STARTS])


def body_view(text: Column, limit: int) -> Column:
    """A masked view from the body's start that never reads past 70 % of the text; NULL under 500 characters."""
    start = body_start(text)
    end = F.least(start + limit, F.floor(F.length(text) * F.lit(BODY_SHARE)).cast("int"))
    view = F.when(end - start >= BODY_LEAST, F.substring(text, start + 1, end - start))
    return mask(view, tuple("(?i)" + p for _, p in OUTCOMES) + BODY_MASKS)


def label_region(text: Column) -> Column:
    """The last fifth of a text."""
    return F.substring(text, F.floor(F.length(text) * F.lit(LABEL_SHARE)).cast("int") + 1, F.length(text))


def disposition(text: Column) -> Column:
    """The label whose phrase begins last, then ends last, then is last in the alphabet; NULL without a phrase."""
    found = []
    for label, pattern in OUTCOMES:
        before = rf"(?is)^(.*){pattern}"
        whole = rf"(?is)^(.*{pattern})"
        found.append(F.when(text.rlike("(?i)" + pattern), F.struct(F.length(F.regexp_extract(text, before, 1)).alias("start"), F.length(F.regexp_extract(text, whole, 1)).alias("end"), F.lit(label).alias("label"))))
    return F.greatest(*found)["label"]


def official_label(disposal: Column) -> Column:
    key = F.lower(one_space(disposal))
    out = F.lit(None).cast("string")
    for value, label in DISPOSALS.items():
        out = F.when(key == value, label).otherwise(out)
    return out


def bucket_split(digest: Column) -> Column:
    """train, validation or test by the first 32 bits of a hex digest, 8 : 1 : 1."""
    bucket = F.pmod(F.conv(F.substring(digest, 1, 8), 16, 10).cast("long"), F.lit(10))
    return F.when(bucket < 8, "train").when(bucket == 8, "validation").otherwise("test")


def uniform(*parts: Column) -> Column:
    """A number in [0, 1) from a hash of the parts: the same on every engine."""
    return F.conv(F.substring(F.sha2(F.concat_ws("|", *parts), 256), 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)
