"""Placement of rows on shards by a permutation-filled lookup table.

Every shard prefers the slots of a prime-sized table in an order of its own: a start and a step drawn from its name. Shards
take turns, and each claims the first slot of its order that is still free, until no slot is left. Shares differ by one slot
at most, and adding or removing a shard moves few other slots. The table depends on the shards' names alone and has ``size``
slots whatever the data, so it is broadcast; a row's slot is the hash of its key modulo ``size``.

Defined cases: a row without doc_id is placed by its text, so such rows spread; rows of one key share a shard; an empty table
gives an empty result. Columns other than doc_id and text are not read.
"""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.llm.registry import llm_query
from weftline.sources.tables import table

SIZE = 65_537
SHARDS = tuple(f"shard-{k:03d}" for k in range(64))


def _number(text: str) -> int:
    return int(hashlib.md5(text.encode()).hexdigest()[:15], 16)


def lookup(shards: list[str] | tuple[str, ...], size: int = SIZE) -> list[int]:
    """Index of the shard that owns each of ``size`` (a prime) slots."""
    if len(set(shards)) != len(shards) or not 0 < len(shards) <= size or any(size % k == 0 for k in range(2, int(size**0.5) + 1)):
        raise ValueError("shards must differ, and there must be a prime number of slots, no fewer than shards")
    at = [_number(f"start:{s}") % size for s in shards]
    step = [_number(f"step:{s}") % (size - 1) + 1 if size > 2 else 1 for s in shards]
    owner, free = [-1] * size, size
    while free:
        for k in range(len(shards)):
            while owner[at[k]] >= 0:
                at[k] = (at[k] + step[k]) % size
            owner[at[k]] = k
            free -= 1
            if not free:
                break
    return owner


def lookup_table(spark: SparkSession, shards, size: int = SIZE) -> DataFrame:
    """``slot, shard`` of every slot: ``size`` rows."""
    owners, names = json.dumps(lookup(shards, size)), json.dumps(list(shards))
    one = spark.range(1).select(F.from_json(F.lit(names), "array<string>").alias("names"), F.posexplode(F.from_json(F.lit(owners), "array<int>")).alias("slot", "owner"))
    return one.select("slot", F.element_at("names", F.col("owner") + 1).alias("shard"))


def key() -> Column:
    return F.coalesce(F.col("doc_id").cast("long").cast("string"), F.concat(F.lit("text:"), F.md5(F.coalesce("text", F.lit("")).cast("binary"))))


def placed(docs: DataFrame, shards=SHARDS, size: int = SIZE) -> DataFrame:
    """``doc_id, slot, shard`` of every row of ``docs``."""
    slot = F.pmod(F.conv(F.substring(F.md5(key().cast("binary")), 1, 15), 16, 10).cast("long"), F.lit(size)).cast("int")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), slot.alias("slot"))
    return rows.join(F.broadcast(lookup_table(docs.sparkSession, shards, size)), "slot").select("doc_id", "slot", "shard")


def _sql(shards=SHARDS, size: int = SIZE) -> str:
    return f"""
WITH t AS (SELECT unnest(range({size})) AS slot, unnest({lookup(shards, size)}) AS owner),
     d AS (SELECT doc_id, coalesce(CAST(doc_id AS VARCHAR), 'text:' || md5(coalesce(text, ''))) AS key FROM documents),
     s AS (SELECT doc_id, CAST(CAST('0x' || substr(md5(key), 1, 15) AS BIGINT) % {size} AS INTEGER) AS slot FROM d)
SELECT s.doc_id, s.slot, 'shard-' || lpad(CAST(t.owner AS VARCHAR), 3, '0') AS shard FROM s JOIN t ON s.slot = t.slot
"""


@llm_query("op2_sharding", _sql())
def op2_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return placed(table(spark, sf_dir, "documents"))
