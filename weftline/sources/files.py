"""Directory walks, snapshots and session files."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.functions import text as tx

# Directories and extensions of a source walk.
SKIPPED_DIRS = ["target", "node_modules", "dist", "build"]
SESSION = "conv_id bigint, turn bigint, role string, text string"


def listing(spark: SparkSession, root: str) -> DataFrame:
    """``(path, name, size, modified, depth)`` of every file below ``root``; contents are not read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    relative = F.regexp_replace(F.col("path"), rf"^.*?{tx.regex_escape(os.path.abspath(root).rstrip('/'))}/", "")
    rows = files.select(relative.alias("path"), F.col("length").alias("size"), F.col("modificationTime").alias("modified"))
    return rows.withColumn("name", tx.file_name(F.col("path"))).withColumn("depth", F.size(F.split("path", "/")))


def visible(files: DataFrame, extensions: list[str] | None = None, max_depth: int | None = None) -> DataFrame:
    """Without hidden files, skipped directories and other extensions."""
    parts = F.split("path", "/")
    hidden = F.exists(parts, lambda p: F.startswith(p, F.lit(".")) | p.isin(SKIPPED_DIRS))
    out = files.filter(~hidden)
    if extensions is not None:
        out = out.filter(tx.extension(F.col("path")).isin(extensions))
    return out if max_depth is None else out.filter(F.col("depth") <= max_depth)


def newer(files: DataFrame, cached: DataFrame, limit: int = 500) -> DataFrame:
    """At most ``limit`` files, in path order, that are unknown or modified after their cached time."""
    seen = cached.select("path", F.col("modified").alias("_seen"))
    fresh = files.join(seen, "path", "left").filter(F.col("_seen").isNull() | (F.col("modified") > F.col("_seen")))
    return fresh.drop("_seen").orderBy("path").limit(limit)


def contents(spark: SparkSession, root: str, extensions: list[str]) -> DataFrame:
    """``(path, content)`` of visible text files; files that are not UTF-8 are left out."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    relative = F.regexp_replace(F.col("path"), rf"^.*?{tx.regex_escape(os.path.abspath(root).rstrip('/'))}/", "")
    rows = files.select(relative.alias("path"), F.col("content").cast("string").alias("content")).filter(F.is_valid_utf8("content"))
    return visible(rows.withColumn("depth", F.size(F.split("path", "/"))), extensions).drop("depth")


def snapshot_path(base: str, project: str) -> str:
    """Where a project's index lives: a name hashed from its path."""
    import hashlib

    return os.path.join(base, "index-" + hashlib.sha256(project.encode()).hexdigest()[:16])


def save_snapshot(tables: dict[str, DataFrame], base: str, project: str) -> str:
    path = snapshot_path(base, project)
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(os.path.join(path, name))
    return path


def load_snapshot(spark: SparkSession, path: str, name: str) -> DataFrame:
    return spark.read.parquet(os.path.join(path, name))


def write_sessions(messages: DataFrame, path: str) -> None:
    messages.select("conv_id", "turn", "role", "text").write.mode("overwrite").json(path)


def read_sessions(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(SESSION).json(path)


def append_lines(df: DataFrame, path: str) -> None:
    df.write.mode("append").text(path)
