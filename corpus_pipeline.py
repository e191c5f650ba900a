"""A corpus from raw documents to packed sequences, stage by stage.

Every stage takes ``(spark, docs, sf_dir)`` and works on all that the stage before kept; all but the last return the columns of
``documents``. Each result is written to the shared folder and read again, so a lost executor costs no earlier stage.

Defined cases: rows without doc_id go through under an id drawn from their text; of rows equal in doc_id and text the
near-duplicate stage keeps one; null texts are empty; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.llm.classifier import scored, train
from weftline.llm.decontamination import contaminated
from weftline.llm.packing import packed
from weftline.llm.simhash import near_duplicates
from weftline.llm.suffix_dedup import without_repeats
from weftline.session import cut_lineage
from weftline.sources.tables import table

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")

# Fingerprints of five-word shingles link at seven or fewer differing bits. One half then differs in three or fewer, and each half
# is covered for three, so the covering misses no link; it is judged on all 64 bits.
PRINTS = {"shingle": 5, "radius": 7, "parts": 2}

# The exact measure, `jaccard.near_duplicates`; no stage uses it.
NEAR = {"shingle": 5, "similarity": 0.8}


def _with_ids(docs: DataFrame) -> DataFrame:
    """``_key``: the doc_id, or a negative number drawn from the text where it is null."""
    drawn = -1 - F.xxhash64(F.coalesce("text", F.lit(""))).bitwiseAND((1 << 62) - 1)
    return docs.select(*COLUMNS, F.coalesce(F.col("doc_id").cast("long"), drawn).alias("_key"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("_same"))


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, trained on the labelled ones, rejects go."""
    docs = docs.select(*COLUMNS)
    weights = train(docs, table(spark, sf_dir, "labels"))
    return scored(docs, weights, COLUMNS).filter("score >= 0.5").drop("score")


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates by SimHash stays: the one of the smallest doc_id."""
    rows = _with_ids(docs).withColumn("_row", F.xxhash64("_key", "_same"))
    found = near_duplicates(rows.select(F.col("_row").alias("doc_id"), "text"), **PRINTS)
    found = found.select(F.col("doc_id").alias("_row"), "component_id").distinct().join(rows.select("_row", "_key").dropDuplicates(["_row"]), "_row")
    first = found.groupBy("component_id").agg(F.min(F.struct("_key", "_row")).alias("first"))
    return rows.join(cut_lineage(first.select("first._row"), "first"), "_row", "left_semi").dropDuplicates(["_row"]).select(*COLUMNS)


def repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later copies of passages of 200 bytes or more are taken out; a document of which no word is left goes."""
    cut = without_repeats(docs, carry=("lang", "source"))
    left = cut.filter((F.col("n_removed") == 0) | F.col("text").rlike("[^ \\t-\\r]"))
    return left.select("doc_id", "text", "rest.lang", "rest.source", F.char_length("text").cast("long").alias("n_chars"))


def leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that overlap a benchmark item go."""
    rows = _with_ids(docs)
    rows = rows.withColumn("_row", F.xxhash64("_key", "_same"))
    found = contaminated(rows.select(F.col("_row").alias("doc_id"), "text"), table(spark, sf_dir, "benchmark"))
    hit = cut_lineage(found.select(F.col("doc_id").alias("_row")).distinct(), "hit")
    return rows.join(hit, "_row", "left_anti").select(*COLUMNS)


def sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences with their ids, in the proportions of the sources."""
    return packed(docs)


STAGES = [("quality classifier", quality), ("near duplicates", near), ("repeated passages", repeats), ("benchmark leaks", leaks), ("packing", sequences)]

#: No stage but the fourth can be said in SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = cut_lineage(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
