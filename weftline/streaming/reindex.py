"""An index of chunks and their vectors, built and kept up to date from a stream of file changes.

A change is ``(file_id, version, text)``; a null text removes the file. Each micro-batch replaces the chunks of its files: the
buckets those files fall into are read, the files' old rows leave, their new chunks enter, and just these buckets are
overwritten. A file leaves a mark of its last version behind (``chunk_no`` -1), so a change that comes late, or a batch that is
run again after a failure, changes nothing: the result depends on the changes and not on how often or in which batches they came.

Vectors are kept by the hash of their text. A batch embeds only texts the table does not have, so text that moves, comes back or
stands in many files is embedded once. The model is a function from ``(hash, text)`` rows to ``(hash, vector)`` rows and gets a
batch's new texts as one table.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.operators.chunking import line_chunks
from weftline.operators.postings import all_terms
from weftline.session import cut_lineage

CHUNKS = "file_id bigint, version bigint, chunk_no int, line_start int, line_end int, hash string, text string, bucket int"
VECTORS = "hash string, vector array<double>, bucket int"
REPORT = "batch_id bigint, files_modified bigint, files_deleted bigint, chunks bigint, embedded bigint"
BUCKETS = 16


def term_vectors(texts: DataFrame) -> DataFrame:
    """The offline stand-in for a model: hashed term vectors, zero for a text without terms."""
    return all_terms(texts, "hash", F.col("text")).select("hash", "vector")


def _bucket(key: str, buckets: int):
    return F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int").alias("bucket")


def _replace(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(path)


@dataclass(frozen=True)
class ChunkIndex:
    """Tables under ``path``: ``chunks`` by bucket of the file, ``vectors`` by bucket of the hash, ``reports`` by batch."""

    spark: SparkSession
    path: str
    window: int = 20
    buckets: int = BUCKETS
    model: Callable[[DataFrame], DataFrame] = term_vectors

    def _read(self, name: str, schema: str) -> DataFrame:
        folder = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        if not folder.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(folder):
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(f"{self.path}/{name}")

    def chunks(self) -> DataFrame:
        return self._read("chunks", CHUNKS).filter("chunk_no >= 0").drop("bucket")

    def files(self) -> DataFrame:
        """Last version of every file that was ever seen, and whether it is there."""
        rows = self._read("chunks", CHUNKS)
        return rows.groupBy("file_id").agg(F.max("version").alias("version"), (F.max("chunk_no") >= 0).alias("present"))

    def vectors(self) -> DataFrame:
        return self._read("vectors", VECTORS).drop("bucket")

    def reports(self) -> DataFrame:
        return self._read("reports", REPORT)

    def embed_new(self, texts: DataFrame) -> int:
        """Embed the ``(hash, text)`` rows whose hash has no vector yet; returns how many."""
        at = [r.bucket for r in texts.select(_bucket("hash", self.buckets)).distinct().collect()]  # one row a bucket at most
        known = self._read("vectors", VECTORS)
        before = known.count()
        # by the same key as the texts, so that these are dealt once
        new = texts.select("hash", "text").dropDuplicates(["hash"]).join(known.filter(F.col("bucket").isin(at)).select("hash"), "hash", "left_anti")
        rows = self.model(new).select("hash", "vector", _bucket("hash", self.buckets))
        rows.write.mode("append").partitionBy("bucket").parquet(f"{self.path}/vectors")
        return self._read("vectors", VECTORS).count() - before

    def apply(self, changes: DataFrame, batch_id: int) -> None:
        """Merge one batch of changes."""
        rows = changes.select(F.col("file_id").cast("bigint"), F.col("version").cast("bigint"), "text").filter("file_id IS NOT NULL AND version IS NOT NULL")
        at = [r.bucket for r in rows.select(_bucket("file_id", self.buckets)).distinct().collect()]  # one row a bucket at most
        if not at:
            return
        # of one file's changes the last counts; of equal versions the removal, then the greatest text
        order = F.struct("version", F.col("text").isNull().alias("gone"), F.coalesce("text", F.lit("")).alias("text"))
        last = rows.groupBy("file_id").agg(F.max(order).alias("_last"))
        last = last.select("file_id", "_last.version", F.when(~F.col("_last.gone"), F.col("_last.text")).alias("text"), _bucket("file_id", self.buckets))
        held = self._read("chunks", CHUNKS).filter(F.col("bucket").isin(at))
        seen = held.filter("chunk_no = -1").select("file_id", F.col("version").alias("_seen"))
        newer = cut_lineage(last.join(seen, "file_id", "left").filter("_seen IS NULL OR version >= _seen").drop("_seen"), "newer")
        file = F.struct("file_id", "version", "bucket").alias("file")
        pieces = line_chunks(newer.filter("text IS NOT NULL").select(file, "text"), "file", "text", self.window)
        number = ((F.col("line_start") - 1) / self.window).cast("int").alias("chunk_no")
        pieces = pieces.select("file.file_id", "file.version", number, "line_start", "line_end", F.sha2("text", 256).alias("hash"), "text", "file.bucket")
        embedded = self.embed_new(pieces.select("hash", "text"))
        none = F.lit(None)
        marks = newer.select("file_id", "version", F.lit(-1).alias("chunk_no"), none.cast("int").alias("line_start"), none.cast("int").alias("line_end"), none.cast("string").alias("hash"), none.cast("string").alias("text"), "bucket")
        merged = held.join(newer.select("file_id"), "file_id", "left_anti").select(*marks.columns).unionByName(marks).unionByName(pieces)
        _replace(merged, f"{self.path}/chunks")
        counts = newer.agg(F.count("text").alias("files_modified"), F.count_if(F.col("text").isNull()).alias("files_deleted"))
        report = counts.select(F.lit(batch_id).cast("bigint").alias("batch_id"), "files_modified", "files_deleted", F.lit(pieces.count()).cast("bigint").alias("chunks"), F.lit(embedded).cast("bigint").alias("embedded"))
        report.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch_id").parquet(f"{self.path}/reports")

    def follow(self, stream: DataFrame, checkpoint: str) -> None:
        """Apply what a stream of changes holds now; a later call with the same checkpoint goes on behind it."""
        stream.writeStream.foreachBatch(self.apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def change_stream(spark: SparkSession, folder: str, files_a_batch: int = 1) -> DataFrame:
    return spark.readStream.schema("file_id bigint, version bigint, text string").option("maxFilesPerTrigger", files_a_batch).parquet(folder)
