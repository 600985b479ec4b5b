"""Text layers of report pages: margin letters, page numbers and running headers out, wrapped lines joined.

Headers are counted over the lines of all pages of a document. Whether a line begins a paragraph is decided by the line
before it, so joining is a window, a running sum of beginnings and a grouping; a document's lines are one group.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from docketry.functions.text import one_space

# What a margin letter, a page number, a report's header, a heading and a sentence's end look like.
MARGIN = r"^[\s.,:;'`\"]*[A-H][\s.,:;'`\"]*$"
NUMBER = r"^\d{1,4}$"
REPORTS = r"(?i)SUPREME\s+COURT\s+REPORTS"
HEADING = r"^[A-Z][A-Z .&()/:-]{2,40}$"
ENDED = r"""[.:;?!"')\]]$"""
#: Headers stand in the first lines of a page and come back on so many pages; their key has so many letters.
FIRST_LINES, LEAST_PAGES, LEAST_LETTERS = 4, 3, 6


def lines(pages: DataFrame) -> DataFrame:
    """``document_id, page_no, pos, line`` of ``document_id, page_no, text`` without what the page itself printed."""
    rows = pages.select("document_id", "page_no", F.posexplode(F.split(F.regexp_replace("text", "\r", "\n"), "\n")).alias("at", "line")).withColumn("line", one_space(F.col("line"))).filter("line <> ''")
    order = F.array_sort(F.collect_list(F.struct("at", "line")))
    rows = rows.groupBy("document_id", "page_no").agg(order.alias("l")).select("document_id", "page_no", F.posexplode("l").alias("pos", "l")).select("document_id", "page_no", "pos", "l.line")
    key = F.regexp_replace(F.lower("line"), r"[\d\W_]+", "")
    rows = rows.withColumn("key", F.when((F.col("pos") < FIRST_LINES) & (F.length(key) >= LEAST_LETTERS), key))
    heads = rows.filter("key is not null").groupBy("document_id", "key").agg(F.countDistinct("page_no").alias("pages")).filter(F.col("pages") >= LEAST_PAGES).select("document_id", "key", F.lit(True).alias("head"))
    printed = F.col("line").rlike(MARGIN) | F.col("line").rlike(NUMBER) | (F.col("line").rlike(REPORTS) & (F.length("line") <= 80))
    return rows.filter(~printed).join(heads, ["document_id", "key"], "left").filter("head is null").select("document_id", "page_no", "pos", "line")


def paragraphs(kept: DataFrame) -> DataFrame:
    """``document_id, paragraph, text``: lines joined over their wraps.

    A heading stands alone; after a sentence's end a capital, a digit or a bracket begins a paragraph. A hyphen between
    a letter and a small letter on the next line goes.
    """
    w = Window.partitionBy("document_id").orderBy("page_no", "pos")
    before = F.lag("line").over(w)
    opens = F.col("line").rlike(r"^[\p{Lu}\p{Nd}(]")
    begins = before.isNull() | before.rlike(HEADING) | F.col("line").rlike(HEADING) | (before.rlike(ENDED) & opens)
    rows = kept.select("document_id", "page_no", "pos", "line", begins.alias("begins"))
    rows = rows.withColumn("wrapped", ~F.col("begins") & F.lag("line").over(w).rlike(r"\p{L}-$") & F.col("line").rlike(r"^\p{Ll}"))
    rows = rows.withColumn("paragraph", F.sum(F.col("begins").cast("int")).over(w)).withColumn("splits", F.coalesce(F.lead("wrapped").over(w), F.lit(False)))
    own = F.when(F.col("splits"), F.regexp_replace("line", "-$", "")).otherwise(F.col("line"))
    part = F.concat(F.when(F.col("begins") | F.col("wrapped"), "").otherwise(" "), own)
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("page_no", "pos", part.alias("part")))), lambda x: x["part"]), "")
    return rows.groupBy("document_id", "paragraph").agg(text.alias("text"))


def clean(pages: DataFrame) -> DataFrame:
    """``document_id, text``: a paragraph a line."""
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("paragraph", "text"))), lambda x: x["text"]), "\n")
    return paragraphs(lines(pages)).groupBy("document_id").agg(text.alias("text"))
