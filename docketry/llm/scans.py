"""Noise in text from scanned pages: running lines, words broken across lines, misread characters.

One pass in Arrow batches cuts texts into lines and lines into words and masks them; all that looks beyond a line (neighbouring
lines, counts, choices, reflow) is SQL, with windows over the lines of one text. Words stay arrays of their line: only their
counts, and the words that are doubtful or asked for, become rows.

* Running lines. A line that is a page number within the record's pages, with or without marks around it, is one. A line
  is a running head if its letters hold the document's title and otherwise only numbers and words such as ``No.``; or if
  the line, digits and the title's words masked and glyphs brought to their skeleton, returns in ``HEAD_RECORDS`` records or
  more, of any documents, in capitals or, otherwise, mostly beside page numbers.
* Broken words. What stands before a hyphen at a line's end and what begins the next kept line (running lines between
  them do not count) is one word, with the hyphen if the corpus has that form more often than the closed one. Where it
  has neither, the hyphen stays if both sides are words.
* Misread words. Words are grouped by a skeleton that maps confusable glyphs and pairs of glyphs to one. In a group, a
  word with a digit or sign among its letters, or one ``RARER`` times rarer than another form (``SHORT_RARER`` times for
  words of up to ``SHORT`` letters, of which many differ in one glyph), is read as the most frequent form that stands elsewhere beside the same neighbour; a sign or digit is read as its letter where the group
  has no form.

Defined cases: NULL and empty texts give nothing; repeated rows count once; words of a text of many records count once, and then as often as it stands where that leaves forms alike; NULL page numbers match no page line; NULL
titles leave the second rule for heads; ties between forms go to the first in the alphabet.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docketry.session import materialise

# Line ends, marks of a broken word, single glyphs that are confused (each with its class), pairs of glyphs.
LINE_END = r"\r\n|[\n\r\f]"
HYPHENS = "[-‐¬­]"
GLYPHS, CLASSES = "0158!|@$qefbl", "oishiiasgcthi"
STROKES = [("m", "rn"), ("n", "ri"), ("u", "ii"), ("d", "ci"), ("w", "vv")]
SIGNS, LETTERS = "015!|@$", "olsilas"
HEAD_WORDS = r"\b(?:the|no|of|part|chapter|sec|section|ss?|page|[ivxlc]+)\b"
SMALL_WORDS = "of|the|and|for|in|to"

HEAD_RECORDS = 3
RARER, SHORT, SHORT_RARER = 5, 3, 50


def skeleton(word: Column) -> Column:
    """Confusable glyphs as one: ``furnish``, ``fumish`` and ``furn!sh`` have the same.

    Glyphs that are misread as two are written as the two, so the skeleton of a word is that of its glyphs in a row.
    """
    out = F.translate(F.lower(word), GLYPHS, CLASSES)
    for one, two in STROKES:
        out = F.replace(out, F.lit(one), F.lit(two))
    return out


_SPLIT = re.compile(LINE_END)
_BLANK = " \t\x0b\x1c\x1d\x1e\x1f\x85\xa0"
_MARK, _LETTER = r"(?:[^\w.]|_)", r"[^\W\d_]"
_PAGE = re.compile(rf"{_MARK}*(?:page|pg\.?|p\.)?{_MARK}*([0-9]+)(?:\s*(?:of|/)\s*[0-9]+)?{_MARK}*$")
_DIGIT = re.compile(r"\d")
_NUMBER, _NUMBERED = re.compile(r"\b\d+\b"), re.compile(rf"\b\d+{_LETTER}?\b")
_HEAD_WORD = re.compile(HEAD_WORDS)
_NO_LETTERS = re.compile(r"[\W\d_]+")
_INITIAL = re.compile(rf"(?:^|[\W_])(?!(?:{SMALL_WORDS})\b)([^\W\d_])")
_LONG = re.compile(rf"{_LETTER}{{4}}")
_EDGE = re.compile(r"^(?:[^\w!@$|]|_)+|(?:[^\w!@$|]|_)+$")
_HYPHENS = {ord(c): "-" for c in "‐¬\u00ad"}
_CLASSES = str.maketrans(GLYPHS, CLASSES)
# the same for ASCII, where bytes do
_ASCII_CLASSES = bytes(ord(chr(c).lower().translate(_CLASSES)) for c in range(128)) + bytes(128)
_ASCII_STROKES = [(one.encode(), two.encode()) for one, two in STROKES]
_ASCII_NO_LETTERS = bytes(c for c in range(128) if not chr(c).isalpha())
_ASCII_SPACED = bytes(c if c < 128 and chr(c).isalpha() else 32 for c in range(256))
_ASCII_EDGE = "".join(chr(c) for c in range(128) if not chr(c).isalnum() and chr(c) not in "!@$|")


def _skeleton(text: str) -> tuple[str, list[str]]:
    """The letters of a text's skeleton, and its words."""
    if text.isascii():
        b = text.encode().translate(_ASCII_CLASSES)
        for one, two in _ASCII_STROKES:
            b = b.replace(one, two)
        return b.translate(None, _ASCII_NO_LETTERS).decode(), b.translate(_ASCII_SPACED).decode().split()
    text = text.lower().translate(_CLASSES)
    for one, two in STROKES:
        text = text.replace(one, two)
    return _NO_LETTERS.sub("", text), _NO_LETTERS.sub(" ", text).split()


def _capital(line: str) -> bool:
    """Whether all words but small ones begin with a capital letter, one of them has four letters, and the line does not end as text does."""
    if line[-1] in ".:;,-" or _LONG.search(line) is None:
        return False
    return not any(m[1].islower() for m in _INITIAL.finditer(line))


def _words(line: str, lower: str) -> list[str]:
    """The words in lower case and without adjoining punctuation."""
    if line.isascii():
        return [w if w.isalpha() else w.strip(_ASCII_EDGE) for w in lower.split()]
    return [w if w.isalpha() else _EDGE.sub("", w) for w in lower.translate(_HYPHENS).split()]


_LINES = pa.schema([
    ("record", pa.string()), ("copy", pa.int64()), ("once", pa.bool_()), ("at", pa.int32()), ("line", pa.string()), ("first", pa.string()), ("last", pa.string()), ("words", pa.string()),
    ("is_page", pa.bool_()), ("headed", pa.bool_()), ("capital", pa.bool_()), ("asked", pa.bool_()), ("masked", pa.int64()),
])
_LINE_ROWS = "record string, copy long, once boolean, at int, line string, first string, last string, words string, is_page boolean, headed boolean, capital boolean, asked boolean, masked long"


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    titles: dict[str, tuple[str, set[str]]] = {}
    for batch in batches:
        out: list[tuple] = []
        for record, copy, once, title, text, p0, p1 in zip(*[c.to_pylist() for c in batch.columns], strict=True):
            title = title or ""
            if title not in titles:
                if len(titles) > 10_000:
                    titles.clear()
                titles[title] = _skeleton(re.sub(r"^the\b", "", _NUMBERED.sub("", title.lower())))[0], set(_skeleton(title)[1])
            bare, of_title = titles[title]
            kept = [(at, line) for at, raw in enumerate(_SPLIT.split(text)) if (line := raw.strip(_BLANK))]
            pages = [False]
            for _, line in kept:
                m = _PAGE.match(line.lower()) if len(line) < 8 or _DIGIT.search(line) else None
                pages.append(m is not None and p0 is not None and p1 is not None and p0 <= int(m[1]) <= p1)
            pages.append(False)
            for i, (at, line) in enumerate(kept):
                lower = line.lower()
                digits = _DIGIT.search(line) is not None
                letters, words = _skeleton(_NUMBERED.sub("", lower) if digits else lower)
                headed = bare != "" and bare in letters and len(_skeleton(_HEAD_WORD.sub("", _NUMBERED.sub("", lower)))[0]) <= len(bare) + 1
                left = " ".join([w for w in dict.fromkeys(_skeleton(_NUMBER.sub("", lower))[1] if digits else words) if w not in of_title])
                masked = int.from_bytes(xxhash.xxh3_64_digest(left), "little", signed=True) if left else None
                capital, raws = _capital(line), line.split()
                asked = not pages[i + 1] and (capital or pages[i] or pages[i + 2])
                out.append((record, copy, once, at, line, raws[0], raws[-1], " ".join(_words(line, lower)), pages[i + 1], headed, capital, asked, masked))
        columns = list(zip(*out, strict=True)) or [[] for _ in _LINES]
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _LINES, strict=True)], schema=_LINES)


def lines(records: DataFrame, record: str, document: str, title: str, text: str, page_start: str, page_end: str) -> DataFrame:
    """``record, copy, once, at, line, first, last, words, running`` of all lines that are not blank.

    ``copy`` is one per text of a record, ``once`` is set in one record of a text; ``first`` and ``last`` are words as printed, ``words`` all of the line, bare.
    """
    rows = records.select(F.col(record).cast("string").alias("record"), F.xxhash64(text).alias("copy"), F.col(document).alias("document"), F.col(title).cast("string").alias("title"), F.col(text).alias("text"), F.col(page_start).cast("int").alias("p0"), F.col(page_end).cast("int").alias("p1"))
    rows = rows.filter("record is not null and text is not null and text <> ''").groupBy("record", "copy").agg(F.max(F.struct("document", "title", "p0", "p1")).alias("of"), F.first("text").alias("text"))
    chosen = records.filter(F.col(record).isNotNull() & F.col(text).isNotNull()).groupBy(F.xxhash64(text).alias("copy")).agg(F.min(F.col(record).cast("string")).alias("record"))
    rows = rows.join(chosen.withColumn("once", F.lit(True)), ["record", "copy"], "left").select("record", "copy", F.coalesce("once", F.lit(False)).alias("once"), "of.title", "text", "of.p0", "of.p1")
    each = materialise(rows.mapInArrow(_cut, _LINE_ROWS))
    heads = (
        each.filter("masked is not null and not is_page").groupBy("capital", "masked")
        .agg(F.countDistinct(F.when(F.col("asked"), F.col("record"))).alias("records"), F.avg(F.col("asked").cast("int")).alias("share"))
        .filter((F.col("records") >= HEAD_RECORDS) & (F.col("share") > 0.5)).select("capital", "masked", F.lit(True).alias("returns"))
    )
    flat = lambda df, running: df.select("record", "copy", "once", "at", "line", "first", "last", "words", running.alias("running"))
    plain = F.col("is_page") | F.col("headed")
    # only the lines that may be heads meet the heads
    return flat(each.filter("not asked"), plain).unionByName(flat(each.filter("asked").join(heads, ["capital", "masked"], "left"), plain | F.coalesce("returns", F.lit(False))))


#: What a word is made of; signs that may be a misread letter count.
IN_WORD = r"\p{L}\p{N}!@$|"


def _bare_word(word: Column) -> Column:
    """A word in lower case and without adjoining punctuation."""
    return F.regexp_replace(F.translate(F.lower(word), "‐¬\u00ad", "---"), rf"^[^{IN_WORD}]+|[^{IN_WORD}]+$", "")


def tokens(marked: DataFrame, printed: bool = False) -> DataFrame:
    """``record, copy, once, at, words, other, left, right, rest, before, after`` of the kept lines; ``printed``: with ``line``.

    Of a word broken at a line's end, the last of ``words`` is the closed form, ``other`` the hyphenated one, ``left`` and
    ``right`` its parts as printed; its rest is gone from the ``words`` of the next line (``rest``). ``before`` and ``after``
    are the words beside the line.
    """
    w = Window.partitionBy("record", "copy").orderBy("at")
    kept = marked.filter("not running").select("record", "copy", "once", "at", "first", "words", F.when(F.col("last").rlike(rf"{HYPHENS}$"), F.regexp_extract("last", rf"(\S*[{IN_WORD}]){HYPHENS}$", 1)).alias("left"), *(["line"] if printed else []))
    kept = kept.withColumn("right", F.lead("first").over(w))
    breaks = F.coalesce(F.col("left").rlike(r"\p{L}") & F.col("right").rlike(r"^[\p{L}0-9!@$|]*\p{Ll}") & ~F.col("left").rlike(r"^\p{N}+$"), F.lit(False))
    kept = kept.withColumn("breaks", F.when(F.col("left").isNull(), False).otherwise(breaks))
    kept = kept.withColumn("rest", F.coalesce(F.lag("breaks").over(w), F.lit(False)))
    one = lambda mark: F.when(F.col("breaks"), _bare_word(F.concat("left", F.lit(mark), "right")))
    # what is left of the line without the rest of a word: where it was all, the line has no word and begins none
    words = F.split(F.when(F.col("rest"), F.expr("substring(words, length(substring_index(words, ' ', 1)) + 2)")).otherwise(F.col("words")), " ", -1)
    kept = kept.filter(~F.col("rest") | F.col("words").contains(" ")).withColumn("words", words)
    joined = F.when(F.col("breaks"), F.concat(F.slice("words", 1, F.size("words") - 1), F.array(one("")))).otherwise(F.col("words"))
    kept = kept.select("record", "copy", "once", "at", *(["line"] if printed else []), joined.alias("words"), one("-").alias("other"), F.when(F.col("breaks"), F.col("left")).alias("left"), F.when(F.col("breaks"), F.col("right")).alias("right"), "rest")
    return kept.withColumn("before", F.lag(F.element_at("words", -1)).over(w)).withColumn("after", F.lead(F.element_at("words", 1)).over(w))


def _printed() -> Column:
    """The words of a line of :func:`tokens` as printed, a broken one joined."""
    raw = F.split("line", r"[\s ]+")
    raw = F.when(F.col("rest"), F.slice(raw, 2, F.size(raw) - 1)).otherwise(raw)
    return F.when(F.col("other").isNotNull(), F.concat(F.slice(raw, 1, F.size(raw) - 1), F.array(F.concat("left", "right")))).otherwise(raw)


def _masked(word: Column) -> Column:
    """One number is as good a neighbour as another."""
    return F.when((word != "") & (F.translate(word, "0123456789", "") == ""), "#").otherwise(word)


def _signed(word: Column) -> Column:
    """A digit or sign among letters; section numbers and ordinals are none."""
    return word.rlike(r"\p{L}") & word.rlike(r"[0-9!@$|]") & ~word.rlike(r"^[0-9]+(\p{L}|st|nd|rd|th)?$") & ~word.rlike(r"^[0-9]{2,}") & word.rlike(r"\p{L}[^\p{L}]*\p{L}")


def _neighbours() -> Column:
    """``word, before, after`` of each word of a line."""
    n = F.size("words")
    return F.arrays_zip(F.col("words").alias("word"), F.concat(F.array("before"), F.slice("words", 1, n - 1)).alias("before"), F.concat(F.slice("words", 2, n - 1), F.array("after")).alias("after"))


def repair(rows: DataFrame) -> DataFrame:
    """``record, copy, at, k, repaired, broken, misread`` of the damaged words among ``rows`` (:func:`tokens`, materialised); ``k`` counts from 0 in ``words``.

    Whole words are counted once, with partial sums; after that only damaged words, their forms and the counts move. ``n``
    counts a text of many records once, so the misread words of a text often copied are no more frequent than their forms;
    ``m``, over all records, decides only for forms that are no rarer by ``n``.
    """
    times = F.greatest(F.sum(F.col("once").cast("int")), F.lit(1))
    whole = F.when(F.col("other").isNull(), F.col("words")).otherwise(F.slice("words", 1, F.size("words") - 1))
    known = materialise(rows.select("once", F.explode(whole).alias("word")).filter("word <> ''").groupBy("word").agg(times.alias("n"), F.count(F.lit(1)).alias("m")))
    parts = known.select(F.explode(F.split("word", "-")).alias("part"), "n", "m").filter("part <> ''").groupBy("part").agg(F.sum("n").alias("n"), F.sum("m").alias("m"))
    parts = materialise(parts.withColumn("skeleton", skeleton(F.col("part"))))
    z = lambda c: F.coalesce(c, F.lit(0))
    # broken words: the closed or the hyphenated form; a damaged one is counted by its group
    last = F.when(F.size("words") > 1, F.element_at("words", -2)).otherwise(F.col("before"))
    broken = rows.filter("other is not null").select("record", "copy", "at", (F.size("words") - 1).alias("k"), F.element_at("words", -1).alias("word"), "other", last.alias("before"), "after").withColumns({"before": _masked(F.col("before")), "after": _masked(F.col("after"))})
    ends = broken.select("word", "other").distinct().withColumn("a", F.regexp_extract("other", r"([^-]+)-[^-]*$", 1)).withColumn("b", F.regexp_extract("other", r"([^-]+)$", 1))
    count = lambda name, key, table=known, col="word": table.select(F.col(col).alias(key), F.col("n").alias(name))
    groups = known.groupBy(skeleton(F.col("word")).alias("s")).agg(F.max("n").alias("n"))
    sized = (
        ends.join(count("n_closed", "word"), "word", "left").join(count("n_open", "other"), "other", "left")
        .withColumn("s1", skeleton(F.col("word"))).withColumn("s2", skeleton(F.col("other")))
        .join(count("g_closed", "s1", groups, "s"), "s1", "left").join(count("g_open", "s2", groups, "s"), "s2", "left")
        .join(count("n_a", "a", parts, "part"), "a", "left").join(count("n_b", "b", parts, "part"), "b", "left")
    )
    seen, group_seen = (z("n_closed") + z("n_open")) > 0, (z("g_closed") + z("g_open")) > 0
    keep = F.when(seen, z("n_open") > z("n_closed")).when(group_seen, z("g_open") > z("g_closed")).otherwise((z("n_a") > 0) & (z("n_b") > 0) & (F.length("a") > 2) & (F.length("b") > 2))
    forms = sized.select("word", "other", F.when(keep, F.col("other")).otherwise(F.col("word")).alias("now"))
    broken = materialise(broken.join(forms, ["word", "other"]).select("record", "copy", "at", "k", "now", "before", "after"))
    # misread words, part by part
    odd = known.select(F.col("word").alias("now")).unionByName(broken.select("now")).distinct().select("now", F.posexplode(F.split("now", "-")).alias("i", "part")).filter(F.length("part") > 1)
    odd = odd.join(parts.select("part", "n", "m"), "part", "left").withColumn("n", z("n")).withColumn("m", z("m")).withColumn("skeleton", skeleton(F.col("part"))).withColumn("signed", _signed(F.col("part")))
    better = parts.filter(~F.col("part").rlike(r"[^\p{L}]") & (F.length("part") > 1)).select("skeleton", F.col("part").alias("form"), F.col("n").alias("n_form"), F.col("m").alias("m_form"))
    rarer = lambda n: F.when(F.length("part") <= SHORT, SHORT_RARER).otherwise(RARER) * F.greatest(n, F.lit(1))
    frequent = (F.col("n_form") >= rarer("n")) | ((F.col("n_form") >= F.col("n")) & (F.col("m_form") >= rarer("m")))
    pairs = odd.join(better, "skeleton", "left").filter((F.col("form") != F.col("part")) & (F.col("signed") | frequent) | (F.col("signed") & F.col("form").isNull()))
    pairs = materialise(pairs.select("now", "i", "part", "signed", F.coalesce("form", F.translate("part", SIGNS, LETTERS)).alias("form"), z("n_form").alias("n_form"), z("m_form").alias("m_form")))
    # of a word's several damaged parts the others take their most frequent form
    best = pairs.groupBy("now", "i").agg(F.min_by("form", F.struct((-F.col("n_form")).alias("n"), (-F.col("m_form")).alias("m"), "form")).alias("form"))
    every = best.groupBy("now").agg(F.map_from_entries(F.collect_list(F.struct("i", "form"))).alias("best"))
    candidates = pairs.join(every, "now").select(
        "now", "signed", "n_form", "m_form",
        F.array_join(F.transform(F.split("now", "-"), lambda p, i: F.when(i == F.col("i"), F.col("form")).otherwise(F.coalesce(F.element_at("best", i), p))), "-").alias("form"),
    )
    candidates = materialise(candidates.groupBy("now", "form").agg(F.max("signed").alias("signed"), F.max("n_form").alias("n_form"), F.max("m_form").alias("m_form")))
    # the words that are doubtful or a form asked for, with their neighbours: all others stay in their lines
    wanted = candidates.select(F.col("form").alias("word")).withColumn("form", F.lit(True)).unionByName(candidates.select(F.col("now").alias("word")).withColumn("form", F.lit(False)))
    wanted = wanted.groupBy("word").agg(F.max("form").alias("is_form"), F.min("form").alias("only_form"))
    around = rows.select("record", "copy", "once", "at", "other", F.size("words").alias("size"), F.posexplode(_neighbours()).alias("k", "of")).select("record", "copy", "once", "at", "k", "of.word", (F.col("other").isNotNull() & (F.col("k") == F.col("size") - 1)).alias("joined"), "of.before", "of.after")
    around = materialise(around.join(wanted, "word").withColumns({"before": _masked(F.col("before")), "after": _masked(F.col("after"))}))
    doubtful = around.filter("not only_form and not joined").select("record", "copy", "at", "k", F.col("word").alias("now"), "before", "after")
    hits = materialise(doubtful.withColumn("broken", F.lit(False)).unionByName(broken.withColumn("broken", F.lit(True))).join(candidates, "now", "left"))
    # how often a form stands beside the same neighbour: pairs of words in which the first or the second is asked for
    first = around.filter("is_form").groupBy(F.col("word").alias("form"), "after").agg(times.alias("n_after"))
    second = around.filter("is_form").groupBy("before", F.col("word").alias("form")).agg(times.alias("n_before"))
    scored = hits.filter("form is not null").join(second, ["before", "form"], "left").join(first, ["form", "after"], "left").withColumn("support", z("n_before") + z("n_after")).filter("signed or support > 0")
    picked = scored.groupBy("record", "copy", "at", "k").agg(F.min_by("form", F.struct((F.col("support") == 0).alias("alone"), (-F.col("n_form")).alias("n"), (-F.col("m_form")).alias("m"), "form")).alias("picked"))
    damaged = hits.select("record", "copy", "at", "k", "now", "broken").distinct().join(picked, ["record", "copy", "at", "k"], "left").filter("broken or picked is not null")
    return damaged.select("record", "copy", "at", "k", F.coalesce("picked", "now").alias("repaired"), "broken", F.col("picked").isNotNull().alias("misread"))


def paragraphs(marked: DataFrame, rows: DataFrame, damaged: DataFrame) -> DataFrame:
    """``record, copy, paragraph, text``: the words as they should read, in continuous paragraphs.

    A paragraph ends where a blank line did (a jump in line numbers without a running line) after a sentence's end.
    """
    w = Window.partitionBy("record", "copy").orderBy("at")
    ended = F.lag("line").over(w).rlike(r"[.:;]$")
    gap = F.col("at") - F.lag("at").over(w) - (F.col("seen") - F.lag("seen").over(w)) > 1
    starts = marked.withColumn("seen", F.sum(F.col("running").cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0))).filter("not running")
    starts = starts.withColumn("start", F.coalesce(ended & (gap | F.col("line").rlike(r"^\(\d+\)")), F.lit(False)).cast("int"))
    numbered = starts.select("record", "copy", "at", F.sum("start").over(w.rowsBetween(Window.unboundedPreceding, 0)).alias("paragraph"))
    # the word as printed, its letters as repaired: what adjoined it stays
    edge = rf"[^{IN_WORD}]*"
    def shown(raw: Column, repaired: Column) -> Column:
        capital = F.regexp_extract(raw, rf"([{IN_WORD}])", 1)
        cased = F.when(capital.rlike(r"^\p{Lu}"), F.concat(F.upper(F.substring(repaired, 1, 1)), F.substring(repaired, F.lit(2), F.length(repaired)))).otherwise(repaired)
        return F.concat(F.regexp_extract(raw, rf"^({edge})", 1), cased, F.regexp_extract(raw, rf"({edge})$", 1))
    repairs = damaged.groupBy("record", "copy", "at").agg(F.map_from_entries(F.collect_list(F.struct("k", "repaired"))).alias("repairs"))
    mended = F.transform(_printed(), lambda raw, k: F.when(F.element_at("repairs", k).isNotNull(), shown(raw, F.element_at("repairs", k))).otherwise(raw))
    shown_line = F.array_join(F.when(F.col("repairs").isNull(), _printed()).otherwise(mended), " ")
    whole = rows.join(repairs, ["record", "copy", "at"], "left").select("record", "copy", "at", shown_line.alias("shown"))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "shown"))), lambda x: x["shown"]), " ")
    return whole.join(numbered, ["record", "copy", "at"]).groupBy("record", "copy", "paragraph").agg(text.alias("text"))
