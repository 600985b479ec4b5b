"""Archives of a year: members of tar files, metadata joined to the documents they describe, counters of what is missing."""

from __future__ import annotations

import hashlib
import io
import json
import tarfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MEMBER = "archive string, archive_sha256 string, name string, content binary"


def _members(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for frame in frames:
        for path, content in zip(frame["path"], frame["content"], strict=True):
            digest, rows = hashlib.sha256(content).hexdigest(), []
            with tarfile.open(fileobj=io.BytesIO(content), mode="r:*") as archive:
                for member in archive:
                    if member.isfile():
                        rows.append((path, digest, member.name, archive.extractfile(member).read()))
                        if len(rows) == 64:  # an archive is put out in small batches
                            yield pd.DataFrame(rows, columns=["archive", "archive_sha256", "name", "content"])
                            rows = []
            yield pd.DataFrame(rows, columns=["archive", "archive_sha256", "name", "content"])


def members(spark: SparkSession, path: str) -> DataFrame:
    """A row per file in the tar files of ``path``; an archive is a task's, as it can only be read from its start."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.tar*").load(path).select("path", "content")
    return files.mapInPandas(_members, MEMBER)


def refuse_changed(found: DataFrame, pinned: dict[str, str]) -> None:
    """Raise where an archive's hash is not the one pinned for its name; names without a pin pass."""
    known = found.sparkSession.createDataFrame(list(pinned.items()) or [("", "")], "name string, pin string")
    seen = found.select(F.element_at(F.split("archive", "/"), -1).alias("name"), "archive_sha256").distinct()
    bad = [r.name for r in seen.join(F.broadcast(known), "name").filter("archive_sha256 <> pin").limit(3).collect()]
    if bad:
        raise ValueError(f"changed archives: {bad}")


def paired(metadata: DataFrame, documents: DataFrame, suffix: str = "_EN.pdf") -> tuple[DataFrame, DataFrame]:
    """Metadata joined to the document of its stem, and counters: metadata, documents, documents without metadata, pairs."""
    stem = lambda c: F.regexp_replace(F.element_at(F.split(c, "/"), -1), r"\.json$|\Q" + suffix + r"\E$", "")
    a = metadata.select(stem(F.col("name")).alias("stem"), F.col("content").cast("string").alias("raw"), F.sha2("content", 256).alias("metadata_sha256"))
    b = documents.select(stem(F.col("name")).alias("stem"), F.col("content").alias("document"), F.sha2("content", 256).alias("pdf_sha256"))
    both = a.join(b, "stem", "full")
    counters = both.agg(F.count("raw").alias("metadata_records"), F.count("document").alias("pdfs"), F.count_if(F.col("raw").isNull()).alias("pdf_without_metadata"), F.count_if(F.col("raw").isNotNull() & F.col("document").isNotNull()).alias("extracted"))
    return both.filter("raw is not null and document is not null"), counters


def index_parts(index: str) -> list[str]:
    """Names of the parts that an archive's index lists, in order."""
    payload = json.loads(index)
    parts = payload.get("parts", payload) if isinstance(payload, dict) else payload
    return [p if isinstance(p, str) else str(p["name"]) for p in parts]
