"""Sinks and lineage: canonical JSON, content ids, manifests, refusing and atomic writes, freezing a folder."""

from __future__ import annotations

import hashlib
import json
import uuid
from datetime import UTC, datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docketry.session import _path


def canonical_json(payload: object) -> bytes:
    """Keys in order, no spaces, ASCII only: equal payloads are equal bytes."""
    return json.dumps(payload, sort_keys=True, separators=(",", ":"), ensure_ascii=True).encode()


def content_id(payload: object) -> str:
    return hashlib.sha256(canonical_json(payload)).hexdigest()


def row_digests(df: DataFrame, key: str) -> DataFrame:
    """``key, digest`` of every row: a hash of its JSON with the columns in order and maps sorted by key."""
    tidy = [F.map_from_entries(F.array_sort(F.map_entries(c))).alias(c) if t.startswith("map<") else F.col(c) for c, t in sorted(df.dtypes)]
    return df.select(key, F.sha2(F.to_json(F.struct(*tidy)), 256).alias("digest"))


def table_digest(df: DataFrame, key: str) -> str:
    """A digest of a table that does not depend on the order of its rows, combined per prefix of the row digests first."""
    rows = row_digests(df, key).select("digest")
    blocks = rows.groupBy(F.substring("digest", 1, 2).alias("p")).agg(F.count(F.lit(1)).alias("n"), *[F.sum(F.conv(F.substring("digest", 1 + 8 * i, 8), 16, 10).cast("decimal(38,0)")).cast("string").alias(f"s{i}") for i in range(8)])
    return content_id(sorted([list(r) for r in blocks.collect()]))  # at most 256 rows


def write_new(df: DataFrame, path: str, **options: str) -> None:
    """Write where nothing is: into a staging folder of this write's own, then one rename. Nothing that stands is deleted."""
    target, fs = _path(df.sparkSession, path)
    if fs.exists(target):
        raise FileExistsError(f"{path} is there")
    staging = f"{path}.{uuid.uuid4().hex}.staging"
    try:
        df.write.options(**options).parquet(staging)
        fs.mkdirs(target.getParent())
        # a rename does not replace a folder that another writer has made meanwhile: it would move into it or fail
        if fs.exists(target) or not fs.rename(_path(df.sparkSession, staging)[0], target):
            raise FileExistsError(f"{path} is there")
    finally:
        fs.delete(_path(df.sparkSession, staging)[0], True)


def write_json_lines(df: DataFrame, path: str, *order: str) -> None:
    """Rows in order as gzip JSON lines; each file is sorted and the files follow one another."""
    df.repartitionByRange(*order).sortWithinPartitions(*order).write.mode("errorifexists").json(path, compression="gzip")


def manifest(artifact: str, version: str, counts: dict[str, int], digests: dict[str, str], sources: list[str]) -> dict[str, object]:
    """What an artifact is and what it was made from; its id leaves the time out."""
    body = {"artifact": artifact, "version": version, "counts": counts, "digests": digests, "sources": sorted(sources)}
    return body | {"content_id": content_id(body), "created_at": datetime.now(UTC).isoformat()}


def same_manifests(a: dict, b: dict, fields: list[str]) -> list[str]:
    """The fields in which two manifests differ; a rebuild is accepted if there are none."""
    return [f for f in fields if a.get(f) != b.get(f)]


def file_hashes(spark: SparkSession, root: str) -> DataFrame:
    """``name, sha256`` of every file below a folder."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    return files.select(F.substring_index("path", root.split("://")[-1].rstrip("/") + "/", -1).alias("name"), F.sha2("content", 256).alias("sha256"))


def frozen_changes(frozen: DataFrame, now: DataFrame) -> DataFrame:
    """``name, change`` of files that were changed, added or lost since they were frozen."""
    a, b = frozen.select("name", F.col("sha256").alias("was")), now.select("name", F.col("sha256").alias("is"))
    change = F.when(F.col("was").isNull(), "added").when(F.col("is").isNull(), "lost").when(F.col("was") != F.col("is"), "changed")
    return a.join(b, "name", "full").select("name", change.alias("change")).filter("change is not null")


def markdown(df: DataFrame, limit: int = 1000) -> str:
    """A small report as a Markdown table."""
    rows = df.limit(limit).collect()
    line = lambda cells: "| " + " | ".join("" if c is None else str(c) for c in cells) + " |"
    return "\n".join([line(df.columns), line(["---"] * len(df.columns)), *map(line, rows)])
