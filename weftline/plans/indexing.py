"""The chunk index over ``documents``: changes in several batches with a restart must give what one full build gives."""

from __future__ import annotations

from pyspark.sql import functions as F

from weftline.plans.text import LINES
from weftline.registry import query
from weftline.session import scratch_path
from weftline.sources.tables import table
from weftline.streaming.reindex import ChunkIndex, change_stream

#: All but every ninth document come first; then every fifth is edited and the rest is added; then every seventh is removed, and
#: old versions of edited documents come late.
_EDITED = "CASE WHEN doc_id % 5 = 0 THEN text || chr(10) || 'edited' ELSE text END"
_BATCHES = (
    ("doc_id % 9 <> 0", "1", "text"),
    ("doc_id % 5 = 0 OR doc_id % 9 = 0", "2", _EDITED),
    ("doc_id % 7 = 0 OR doc_id % 5 = 0", "CASE WHEN doc_id % 7 = 0 THEN 3 ELSE 1 END", "CASE WHEN doc_id % 7 = 0 THEN CAST(NULL AS STRING) ELSE text END"),
)
_WINDOW = 20

_FULL = f"""d AS (SELECT doc_id AS file_id, {_EDITED} AS text FROM documents WHERE doc_id % 7 <> 0), l AS (SELECT file_id, text, {LINES} AS ls FROM d), s AS (SELECT *, unnest(range(0, greatest(len(ls), 1), {_WINDOW})) AS s FROM l),
c AS (SELECT file_id, CAST(s // {_WINDOW} AS INTEGER) AS chunk_no, CAST(s + 1 AS INTEGER) AS line_start, CAST(least(s + {_WINDOW}, len(ls)) AS INTEGER) AS line_end, CASE WHEN len(ls) <= {_WINDOW} THEN text ELSE array_to_string(ls[s + 1:s + {_WINDOW}], chr(10)) END AS text FROM s)"""


def _followed(spark, sf) -> ChunkIndex:
    """The index after the first batch, a restart, and the others. A batch has as many files as one set of changes is written in:
    each rewrites all buckets, so their number must not grow with the input."""
    documents, folder = table(spark, sf, "documents"), scratch_path(spark, "changes")
    index, checkpoint = ChunkIndex(spark, scratch_path(spark, "index"), _WINDOW), scratch_path(spark, "index-checkpoint")
    for k, (some, version, text) in enumerate(_BATCHES):
        changes = documents.filter(some).selectExpr("doc_id AS file_id", f"CAST({version} AS BIGINT) AS version", f"{text} AS text")
        changes.write.mode("append").parquet(folder)
        if k != 1:  # the second and third arrive together, after the restart
            index.follow(change_stream(spark, folder, max(documents.rdd.getNumPartitions(), 1)), checkpoint)
    return index


@query("chunk_index", "VR14 SM5 CH2 SC15", f"WITH {_FULL} SELECT file_id, chunk_no, line_start, line_end, sha256(text) AS hash FROM c")
def chunk_index(spark, sf):
    """Chunks after all batches: those of a full build over the last version of every file."""
    return _followed(spark, sf).chunks().select("file_id", "chunk_no", "line_start", "line_end", "hash")


@query("chunk_index_totals", "VR14 CX7 AG1", f"WITH {_FULL} SELECT count(DISTINCT file_id) AS files, count(*) AS chunks, count(DISTINCT text) AS texts, 64 AS dimension FROM c")
def chunk_index_totals(spark, sf):
    """What the index holds; every chunk's text has one vector."""
    index = _followed(spark, sf)
    chunks = index.chunks().select("file_id", "hash").join(index.vectors().select("hash", F.size("vector").alias("size")), "hash")
    return chunks.agg(F.count_distinct("file_id").alias("files"), F.count("*").alias("chunks"), F.count_distinct("hash").alias("texts"), F.max("size").alias("dimension"))


@query("chunk_index_files", "SM5 SM4 VR14", f"""SELECT doc_id AS file_id, CAST(CASE WHEN doc_id % 7 = 0 THEN 3 WHEN doc_id % 5 = 0 OR doc_id % 9 = 0 THEN 2 ELSE 1 END AS BIGINT) AS version, doc_id % 7 <> 0 AS present FROM documents""")
def chunk_index_files(spark, sf):
    """The version each file stands at; removed files are known, late old versions changed nothing."""
    return _followed(spark, sf).files()


@query("embedding_cache", "VR1 SC15 DM11", """SELECT 1 AS run, count(*) AS texts, count(DISTINCT text) AS embedded FROM documents WHERE doc_id % 2 = 0
UNION ALL SELECT 2, count(*), count(DISTINCT text) FILTER (text NOT IN (SELECT text FROM documents WHERE doc_id % 2 = 0)) FROM documents UNION ALL SELECT 3, count(*), 0 FROM documents""")
def embedding_cache(spark, sf):
    """Half of the documents, then all, then all again: only texts without a vector are embedded."""
    texts = table(spark, sf, "documents").select(F.sha2("text", 256).alias("hash"), "text", "doc_id")
    index = ChunkIndex(spark, scratch_path(spark, "cache"))
    runs = []
    for k, rows in enumerate((texts.filter("doc_id % 2 = 0"), texts, texts), 1):
        runs.append(rows.agg(F.lit(k).alias("run"), F.count("*").alias("texts"), F.lit(index.embed_new(rows)).cast("bigint").alias("embedded")))
    return runs[0].unionByName(runs[1]).unionByName(runs[2])
