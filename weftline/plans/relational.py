"""Store queries: sessions and messages are ``conversations``, files are ``documents``, projects are ``customer``."""

from __future__ import annotations

from pyspark.sql import functions as F

from weftline.functions import text as tx
from weftline.operators import relational as r
from weftline.plans.corpus import cte, derived
from weftline.registry import query
from weftline.sources.tables import spread, table


@query("key_lookup", "FLT1 SRC6 TK1", "SELECT o_orderkey, o_orderstatus, o_totalprice FROM orders WHERE o_custkey = 7 ORDER BY o_orderkey")
def key_lookup(spark, sf):
    return table(spark, sf, "orders").filter(F.col("o_custkey") == 7).select("o_orderkey", "o_orderstatus", "o_totalprice").orderBy("o_orderkey")


@query("conjunctive_filter", "FLT2 PRJ1", "SELECT l_orderkey AS order_id, l_linenumber AS line_no, l_quantity AS quantity FROM lineitem WHERE l_suppkey = 5 AND l_returnflag = 'R'")
def conjunctive_filter(spark, sf):
    return (table(spark, sf, "lineitem").filter((F.col("l_suppkey") == 5) & (F.col("l_returnflag") == "R"))
            .select(F.col("l_orderkey").alias("order_id"), F.col("l_linenumber").alias("line_no"), F.col("l_quantity").alias("quantity")))


@query("path_lookup_first", "FLT3", f"""WITH {cte("src_files")}
SELECT file_id, path FROM src_files WHERE path = 'web/unit_27.js' OR path LIKE '%unit_2_.rs' ORDER BY file_id LIMIT 1""")
def path_lookup_first(spark, sf):
    f = derived(spark, sf, "src_files")
    return f.filter((F.col("path") == "web/unit_27.js") | F.col("path").like("%unit_2_.rs")).select("file_id", "path").orderBy("file_id").limit(1)


@query("message_like_search", "FLT4 SC2 TK2", """SELECT conv_id, turn, role FROM conversations WHERE lower(text) LIKE '%the re%' ORDER BY conv_id DESC, turn LIMIT 20""")
def message_like_search(spark, sf):
    return (table(spark, sf, "conversations").filter(F.contains(F.lower("text"), F.lit("the re"))).select("conv_id", "turn", "role")
            .orderBy(F.desc("conv_id"), "turn").limit(20))


_SEARCH_INDEX = """search_index AS (SELECT 'symbol' AS entity_type, p_partkey AS entity_id, lower(p_name || ' ' || p_brand) AS content FROM part
 UNION ALL SELECT 'file', s_suppkey, lower(s_name) FROM supplier UNION ALL SELECT 'symbol', p_partkey, lower(p_type) FROM part)"""


@query("symbol_search", "JN3 ST3 CX13 FLT4", f"""WITH {_SEARCH_INDEX}
SELECT DISTINCT p.p_partkey, p.p_name FROM part p JOIN search_index s ON s.entity_id = p.p_partkey AND s.entity_type = 'symbol'
WHERE s.content LIKE '%e%' AND s.content LIKE '%brand#1%' ORDER BY p.p_name, p.p_partkey LIMIT 30""")
def symbol_search(spark, sf):
    part = table(spark, sf, "part")
    index = (part.select(F.lit("symbol").alias("entity_type"), F.col("p_partkey").alias("entity_id"), F.lower(F.concat_ws(" ", "p_name", "p_brand")).alias("content"))
             .unionByName(table(spark, sf, "supplier").select(F.lit("file").alias("entity_type"), F.col("s_suppkey").alias("entity_id"), F.lower("s_name").alias("content")))
             .unionByName(part.select(F.lit("symbol").alias("entity_type"), F.col("p_partkey").alias("entity_id"), F.lower("p_type").alias("content"))))
    hits = index.filter(F.contains("content", F.lit("e")) & F.contains("content", F.lit("brand#1")))
    on = (hits.entity_id == part.p_partkey) & (hits.entity_type == "symbol")
    return part.join(hits, on).select("p_partkey", "p_name").distinct().orderBy("p_name", "p_partkey").limit(30)


@query("path_or_language_search", "FLT5 FLT6", f"""WITH {cte("src_files")}
SELECT file_id, path FROM src_files WHERE contains(lower(path), 'unit_1') OR contains(lower(language), 'rust')""")
def path_or_language_search(spark, sf):
    f = derived(spark, sf, "src_files")
    return f.filter(F.contains(F.lower("path"), F.lit("unit_1")) | F.contains(F.lower("language"), F.lit("rust"))).select("file_id", "path")


@query("tag_search", "FLT6 SC25", """WITH t AS (SELECT p_partkey, string_split(lower(p_name || ' ' || p_type), ' ') AS tags FROM part)
SELECT p_partkey, array_to_string(list_distinct_sorted, ',') AS tags FROM (SELECT p_partkey, list_sort(list_distinct(tags)) AS list_distinct_sorted FROM t
 WHERE len(list_filter(tags, lambda x: contains(x, 'ed'))) > 0 OR list_contains(tags, 'widget'))""")
def tag_search(spark, sf):
    t = table(spark, sf, "part").select("p_partkey", F.split(F.lower(F.concat_ws(" ", "p_name", "p_type")), " ").alias("tags"))
    wanted = F.exists("tags", lambda x: F.contains(x, F.lit("ed"))) | F.array_contains("tags", "widget")
    return t.filter(wanted).select("p_partkey", F.array_join(F.sort_array(F.array_distinct("tags")), ",").alias("tags"))


@query("chunks_with_files", "JN1 JN2 JN4", """SELECT e.vec_id, d.lang, d.source, l.quality FROM embeddings e JOIN documents d ON d.doc_id = e.vec_id LEFT JOIN labels l ON l.doc_id = d.doc_id""")
def chunks_with_files(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", "lang", "source")
    e = table(spark, sf, "embeddings").select("vec_id")
    labels = table(spark, sf, "labels").select("doc_id", "quality")
    return e.join(d, e.vec_id == d.doc_id).join(labels, "doc_id", "left").select("vec_id", "lang", "source", "quality")


@query("embedding_stats", "AG1 CX7", """SELECT count(*) AS total_chunks, count(DISTINCT d.source) AS total_files, count(DISTINCT d.lang) AS total_languages
 FROM embeddings e JOIN documents d ON d.doc_id = e.vec_id""")
def embedding_stats(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", "lang", "source")
    e = table(spark, sf, "embeddings").select("vec_id")
    per_group = e.join(d, e.vec_id == d.doc_id).groupBy("source", "lang").count()
    return per_group.agg(F.sum("count").alias("total_chunks"), F.count_distinct("source").alias("total_files"), F.count_distinct("lang").alias("total_languages"))


_LINES_SQL = "CASE WHEN text = '' THEN 0 ELSE len(string_split_regex(regexp_replace(text, '\\r?\\n\\z', ''), '\\r?\\n')) END"


@query("index_summary", "AG2 AG3 TK6 SC12 SC13", f"""
WITH f AS (SELECT lang, strlen(text) AS size, {_LINES_SQL} AS n FROM documents),
g AS (SELECT lang, count(*) AS files, CAST(sum(n) AS BIGINT) AS lines, CAST(sum(size) AS BIGINT) AS bytes FROM f GROUP BY lang
 UNION ALL SELECT '(all)', count(*), CAST(sum(n) AS BIGINT), CAST(sum(size) AS BIGINT) FROM f)
SELECT lang, files, lines, bytes, CASE WHEN bytes >= 1073741824 THEN printf('%.2f GB', bytes / 1073741824) WHEN bytes >= 1048576 THEN printf('%.2f MB', bytes / 1048576)
 WHEN bytes >= 1024 THEN printf('%.2f KB', bytes / 1024) ELSE bytes || ' bytes' END AS size_text,
 CASE WHEN lines >= 1000000 THEN printf('%.1fM', lines / 1000000) WHEN lines >= 1000 THEN printf('%.1fk', lines / 1000) ELSE CAST(lines AS VARCHAR) END AS lines_text
FROM g ORDER BY lines DESC, lang LIMIT 11""")
def index_summary(spark, sf):
    f = spread(table(spark, sf, "documents").select("lang", "text"))
    f = f.select("lang", F.octet_length("text").alias("size"), F.size(tx.lines(F.col("text"))).alias("n"))
    g = f.rollup("lang").agg(F.grouping("lang").alias("whole"), F.count("*").alias("files"), F.sum("n").alias("lines"), F.sum("size").alias("bytes"))
    g = g.withColumn("lang", F.when(F.col("whole") == 1, "(all)").otherwise(F.col("lang"))).drop("whole")
    return g.withColumn("size_text", tx.format_size(F.col("bytes"))).withColumn("lines_text", tx.format_count(F.col("lines"))).orderBy(F.desc("lines"), "lang").limit(11)


@query("recent_messages", "WN2", """SELECT conv_id, turn, role FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS rn FROM conversations) WHERE rn <= 3""")
def recent_messages(spark, sf):
    return r.last_n(table(spark, sf, "conversations").select("conv_id", "turn", "role"), ["conv_id"], F.desc("turn"), 3)


@query("bounded_history", "WN3", """
WITH c AS (SELECT *, count(*) FILTER (role = 'system') OVER (PARTITION BY conv_id) AS systems FROM conversations),
n AS (SELECT *, row_number() OVER (PARTITION BY conv_id, role = 'system' ORDER BY turn DESC) AS rn FROM c)
SELECT conv_id, turn, role FROM n WHERE role = 'system' OR rn <= greatest(4 - systems, 0)""")
def bounded_history(spark, sf):
    """Keep every system message and the newest others within a history of four."""
    c = table(spark, sf, "conversations").select("conv_id", "turn", "role")
    system = c.filter(F.col("role") == "system")
    per_conv = system.groupBy("conv_id").agg(F.count("*").alias("systems"))
    newest = c.filter(F.col("role") != "system").withColumn("rn", F.row_number().over(_newest("conv_id"))).filter("rn <= 4")
    kept = newest.join(per_conv, "conv_id", "left").filter(F.col("rn") <= F.greatest(4 - F.coalesce("systems", F.lit(0)), F.lit(0)))
    return system.unionByName(kept.select("conv_id", "turn", "role"))


def _newest(key):
    from pyspark.sql import Window

    return Window.partitionBy(key).orderBy(F.desc("turn"))


@query("session_tokens", "DM4 DM5 SC14 TK10", """
WITH t AS (SELECT conv_id, turn, greatest(strlen(text) // 4, 1) AS tokens FROM conversations),
s AS (SELECT conv_id, CAST(10 AS BIGINT) AS total_tokens FROM conversations WHERE turn = 0)
SELECT s.conv_id, CAST(s.total_tokens + sum(t.tokens) AS BIGINT) AS total_tokens, count(*) AS messages FROM s JOIN t USING (conv_id) GROUP BY s.conv_id, s.total_tokens
ORDER BY total_tokens DESC, s.conv_id LIMIT 100""")
def session_tokens(spark, sf):
    c = table(spark, sf, "conversations")
    sessions = c.filter("turn = 0").select("conv_id", F.lit(10).cast("bigint").alias("total_tokens"), F.lit(0).cast("bigint").alias("messages"))
    spent = c.select("conv_id", tx.token_estimate(F.col("text")).alias("total_tokens"), F.lit(1).cast("bigint").alias("messages"))
    known = spent.join(sessions.select("conv_id"), "conv_id", "left_semi")
    return r.accumulate(sessions, known, ["conv_id"], ["total_tokens", "messages"]).orderBy(F.desc("total_tokens"), "conv_id").limit(100)


@query("add_tokens", "DM5 DM6", """
SELECT c_custkey, c_acctbal + coalesce((SELECT sum(o_totalprice) FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'F'), 0) AS balance,
 CASE WHEN c_mktsegment = 'BUILDING' THEN 'moved' ELSE c_mktsegment END AS segment FROM customer""")
def add_tokens(spark, sf):
    c = table(spark, sf, "customer").select("c_custkey", F.col("c_acctbal").alias("balance"), "c_mktsegment")
    delta = table(spark, sf, "orders").filter("o_orderstatus = 'F'").select(F.col("o_custkey").alias("c_custkey"), F.col("o_totalprice").alias("balance"))
    moved = F.when(F.col("c_mktsegment") == "BUILDING", "moved").otherwise(F.col("c_mktsegment"))
    return r.add_to(c, delta, ["c_custkey"], "balance").select("c_custkey", F.round("balance", 6).alias("balance"), moved.alias("segment"))


_OLD = "old AS (SELECT doc_id, source, n_chars, 'v1' AS ver FROM documents WHERE doc_id % 7 <> 0)"
_NEW = "new AS (SELECT doc_id, source || 'x' AS source, n_chars + 1 AS n_chars, 'v2' AS ver FROM documents WHERE doc_id % 5 = 0)"


def _versions(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", "source", "n_chars")
    old = d.filter("doc_id % 7 <> 0").withColumn("ver", F.lit("v1"))
    new = d.filter("doc_id % 5 = 0").select("doc_id", F.concat("source", F.lit("x")).alias("source"), (F.col("n_chars") + 1).alias("n_chars")).withColumn("ver", F.lit("v2"))
    return old, new


@query("upsert_files", "DM2 DM3 CX2", f"""WITH {_OLD}, {_NEW}
SELECT coalesce(o.doc_id, n.doc_id) AS doc_id, CASE WHEN o.doc_id IS NULL THEN n.source ELSE o.source END AS source,
 CASE WHEN n.doc_id IS NOT NULL THEN n.n_chars ELSE o.n_chars END AS n_chars, CASE WHEN n.doc_id IS NOT NULL THEN n.ver ELSE o.ver END AS ver
FROM old o FULL JOIN new n ON o.doc_id = n.doc_id""")
def upsert_files(spark, sf):
    return r.upsert(*_versions(spark, sf), ["doc_id"], ["n_chars", "ver"])


@query("insert_latest_wins", "DM1 DM3", f"""WITH {_OLD}, {_NEW}, u AS (SELECT * FROM old UNION ALL SELECT * FROM new)
SELECT doc_id, arg_max(source, ver) AS source, arg_max(n_chars, ver) AS n_chars, max(ver) AS ver FROM u GROUP BY doc_id""")
def insert_latest_wins(spark, sf):
    old, new = _versions(spark, sf)
    return r.latest(old.unionByName(new), ["doc_id"], F.col("ver")).select("doc_id", "source", "n_chars", "ver")


@query("index_metadata", "DM4 VR14", f"""WITH {_OLD}, {_NEW}, u AS (SELECT * FROM old UNION ALL SELECT * FROM new)
SELECT source, count(*) AS total_chunks, CAST(sum(n_chars) AS BIGINT) AS total_chars FROM u GROUP BY source""")
def index_metadata(spark, sf):
    old, new = (df.select("source", F.lit(1).cast("bigint").alias("total_chunks"), F.col("n_chars").alias("total_chars")) for df in _versions(spark, sf))
    return r.accumulate(old, new, ["source"], ["total_chunks", "total_chars"])


@query("cascade_delete", "JN12 DM7", """SELECT o_orderstatus, count(*) AS orders_left, (SELECT count(*) FROM lineitem l WHERE EXISTS (
  SELECT 1 FROM orders o2 JOIN customer c ON c.c_custkey = o2.o_custkey WHERE o2.o_orderkey = l.l_orderkey AND c.c_mktsegment <> 'BUILDING')) AS lines_left
FROM orders o JOIN customer c ON c.c_custkey = o.o_custkey WHERE c.c_mktsegment <> 'BUILDING' GROUP BY o_orderstatus""")
def cascade_delete(spark, sf):
    gone = table(spark, sf, "customer").filter("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("o_custkey"))
    orders = table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_orderstatus")
    gone_orders = orders.join(gone, "o_custkey", "left_semi").select(F.col("o_orderkey").alias("l_orderkey"))
    lines = r.delete_cascade(gone_orders, table(spark, sf, "lineitem").select("l_orderkey"), "l_orderkey").agg(F.count("*").alias("n"))
    left = r.delete_cascade(gone, orders, "o_custkey").groupBy("o_orderstatus").agg(F.count("*").alias("orders_left"))
    return left.withColumn("lines_left", lines.scalar())


@query("cascade_set_null", "JN12", """SELECT o_orderkey, CASE WHEN c.c_mktsegment = 'BUILDING' THEN NULL ELSE o_custkey END AS o_custkey FROM orders o JOIN customer c ON c.c_custkey = o.o_custkey""")
def cascade_set_null(spark, sf):
    gone = table(spark, sf, "customer").filter("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("o_custkey"))
    return r.set_null(gone, table(spark, sf, "orders").select("o_orderkey", "o_custkey"), "o_custkey").select("o_orderkey", "o_custkey")


_EXPIRY = "CASE WHEN event_id % 11 = 0 THEN NULL ELSE ts + to_seconds(CAST(floor(value * 3600) AS BIGINT)) END"


@query("ttl_evict", "FLT9 DM8 SC27 SC28", f"""WITH e AS (SELECT event_id, ts, {_EXPIRY} AS expires_at FROM events)
SELECT event_id, CASE WHEN expires_at IS NULL THEN NULL ELSE CAST(greatest(0, floor(epoch(expires_at) - epoch(TIMESTAMP '2024-01-20 00:00:00'))) AS BIGINT) END AS remaining_s
FROM e WHERE expires_at IS NULL OR TIMESTAMP '2024-01-20 00:00:00' <= expires_at""")
def ttl_evict(spark, sf):
    as_of = F.lit("2024-01-20 00:00:00").cast("timestamp_ntz")
    expires = F.when(F.col("event_id") % 11 != 0, F.col("ts") + F.make_dt_interval(secs=F.floor(F.col("value") * 3600).cast("decimal(18,6)")))
    e = table(spark, sf, "events").select("event_id", expires.alias("expires_at"))
    left = F.greatest(F.lit(0), F.timestamp_diff("SECOND", as_of, F.col("expires_at"))).cast("bigint")
    return e.filter(r.alive(F.col("expires_at"), as_of)).select("event_id", F.when(F.col("expires_at").isNotNull(), left).alias("remaining_s"))


@query("snapshot_validity", "FLT10 SM7", """SELECT user_id, max(ts) >= TIMESTAMP '2024-01-30 00:00:00' - INTERVAL 1 DAY + INTERVAL 1 MICROSECOND AS valid FROM events WHERE ts <= TIMESTAMP '2024-01-30 00:00:00' GROUP BY user_id""")
def snapshot_validity(spark, sf):
    """A snapshot serves for strictly less than 24 hours."""
    as_of = F.lit("2024-01-30 00:00:00").cast("timestamp_ntz")
    last = table(spark, sf, "events").filter(F.col("ts") <= as_of).groupBy("user_id").agg(F.max("ts").alias("saved_at"))
    return last.select("user_id", (F.timestamp_diff("MICROSECOND", F.col("saved_at"), as_of) < 86_400_000_000).alias("valid"))


@query("capacity_cap", "DM9", "SELECT event_id, user_id FROM events ORDER BY event_id LIMIT 10000")
def capacity_cap(spark, sf):
    """Inserts beyond the capacity tier (10,000 entries below 4 GB) are ignored."""
    return table(spark, sf, "events").select("event_id", "user_id").orderBy("event_id").limit(10_000)


@query("lru_survivors", "DM10", """SELECT user_id, max(event_id) AS last_event FROM (SELECT user_id, event_id, ts FROM events) GROUP BY user_id ORDER BY max((ts, event_id)) DESC LIMIT 100""")
def lru_survivors(spark, sf):
    kept = r.lru_survivors(table(spark, sf, "events"), "user_id", ["ts", "event_id"], 100)
    return kept.select("user_id", F.col("last_access.event_id").alias("last_event"))


@query("cache_memory", "DM11 CX14", """SELECT (SELECT count(*) FROM embeddings) * 6144 + (SELECT count(*) FROM documents) * 32 AS bytes,
 CAST(least(100, ((SELECT count(*) FROM embeddings) + 99) // 100 * 100 * 100 // (SELECT count(*) FROM documents)) AS BIGINT) AS loaded_percent""")
def cache_memory(spark, sf):
    vectors = table(spark, sf, "embeddings").agg(F.count("*").alias("vectors"))
    docs = table(spark, sf, "documents").agg(F.count("*").alias("n"))
    both = vectors.withColumn("docs", docs.scalar())
    batches = F.ceil(F.col("vectors") / 100) * 100
    return both.select((F.col("vectors") * 6144 + F.col("docs") * 32).alias("bytes"),
                       F.least(F.lit(100), F.floor(batches * 100 / F.col("docs"))).cast("bigint").alias("loaded_percent"))


@query("snapshot_diff", "JN6 JN7 JN8 SM4", """
WITH old AS (SELECT doc_id, 100 AS mtime FROM documents WHERE doc_id % 9 <> 0), new AS (SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN 200 WHEN doc_id % 5 = 1 THEN 50 ELSE 100 END AS mtime FROM documents WHERE doc_id % 7 <> 0)
SELECT doc_id, 'added' AS change FROM new WHERE doc_id NOT IN (SELECT doc_id FROM old) UNION ALL SELECT doc_id, 'deleted' FROM old WHERE doc_id NOT IN (SELECT doc_id FROM new)
UNION ALL SELECT n.doc_id, 'modified' FROM new n JOIN old o ON n.doc_id = o.doc_id WHERE n.mtime > o.mtime""")
def snapshot_diff(spark, sf):
    d = table(spark, sf, "documents").select("doc_id")
    old = d.filter("doc_id % 9 <> 0").withColumn("mtime", F.lit(100))
    new = d.filter("doc_id % 7 <> 0").withColumn("mtime", F.expr("CASE WHEN doc_id % 5 = 0 THEN 200 WHEN doc_id % 5 = 1 THEN 50 ELSE 100 END"))
    return r.snapshot_diff(old, new, "doc_id", "mtime")


@query("hash_changes", "SM6 SC15", """
WITH old AS (SELECT doc_id, sha256(text) AS h FROM documents WHERE doc_id % 4 <> 0),
new AS (SELECT doc_id, sha256(CASE WHEN doc_id % 3 = 0 THEN text || '!' ELSE text END) AS h FROM documents)
SELECT n.doc_id, n.h AS hash FROM new n LEFT JOIN old o USING (doc_id) WHERE o.h IS NULL OR o.h <> n.h""")
def hash_changes(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", "text")
    old = d.filter("doc_id % 4 <> 0").select("doc_id", F.sha2("text", 256).alias("hash"))
    edited = F.when(F.col("doc_id") % 3 == 0, F.concat("text", F.lit("!"))).otherwise(F.col("text"))
    return r.hash_changes(old, d.select("doc_id", F.sha2(edited, 256).alias("hash")), "doc_id", "hash")


_PLAN_EVENTS = "CASE event_type WHEN 'signup' THEN 'pending' WHEN 'view' THEN 'in_progress' WHEN 'click' THEN 'skipped' WHEN 'purchase' THEN 'completed' ELSE 'failed' END"


@query("plan_progress", "CL13 CX10 CX15 AG19", f"""
WITH s AS (SELECT user_id, event_id % 6 AS step, arg_max({_PLAN_EVENTS}, (ts, event_id)) AS status FROM events GROUP BY 1, 2)
SELECT user_id, count(*) AS steps, CASE WHEN bool_and(status IN ('completed', 'skipped')) THEN 'Completed' WHEN bool_or(status = 'failed') THEN 'Failed'
 WHEN bool_or(status = 'in_progress') THEN 'InProgress' ELSE 'Pending' END AS plan_status, min(step) FILTER (status = 'pending') AS next_step,
 round(count(*) FILTER (status = 'completed') * 100.0 / count(*), 6) AS percent FROM s GROUP BY user_id""")
def plan_progress(spark, sf):
    """Latest event wins per step; a plan's status follows from its steps."""
    steps = table(spark, sf, "events").withColumn("step", F.col("event_id") % 6).groupBy("user_id", "step").agg(
        F.max_by(F.expr(_PLAN_EVENTS), F.struct("ts", "event_id")).alias("status"))
    status = F.col("status")
    plan = (F.when(F.bool_and(status.isin("completed", "skipped")), "Completed").when(F.bool_or(status == "failed"), "Failed")
            .when(F.bool_or(status == "in_progress"), "InProgress").otherwise("Pending"))
    return steps.groupBy("user_id").agg(
        F.count("*").alias("steps"), plan.alias("plan_status"), F.min(F.when(status == "pending", F.col("step"))).alias("next_step"),
        F.round(F.count_if(status == "completed") * 100.0 / F.count("*"), 6).alias("percent"))


@query("commands_by_category", "CX11 AG15", """SELECT p_type AS category, count(*) AS n, string_agg(DISTINCT p_brand, ',' ORDER BY p_brand) AS names FROM part GROUP BY 1""")
def commands_by_category(spark, sf):
    g = table(spark, sf, "part").groupBy(F.col("p_type").alias("category"))
    return g.agg(F.count("*").alias("n"), F.array_join(F.sort_array(F.collect_set("p_brand")), ",").alias("names"))


@query("clear_store", "CX8", "SELECT lang, count(*) AS files FROM documents WHERE false GROUP BY lang UNION ALL SELECT '(total)', count(*) FROM documents WHERE false")
def clear_store(spark, sf):
    """Clearing keeps the schema and no rows."""
    emptied = table(spark, sf, "documents").filter(F.lit(False))
    return emptied.groupBy("lang").agg(F.count("*").alias("files")).unionByName(
        emptied.agg(F.count("*").alias("files")).select(F.lit("(total)").alias("lang"), "files"))


@query("config_precedence", "CX19 SC23 SC24", """
WITH c AS (SELECT event_id, try_cast(json_extract_string(props, '$.k') AS DOUBLE) / 40 AS file_temp, CASE WHEN event_id % 3 = 0 THEN value / 100 END AS env_temp,
 CASE WHEN event_id % 5 = 0 THEN '' ELSE event_type END AS model FROM events),
v AS (SELECT event_id, coalesce(CASE WHEN event_id % 2 = 0 THEN file_temp END, env_temp, 0.7) AS temperature, model FROM c)
SELECT event_id, round(temperature, 6) AS temperature, rtrim(CASE WHEN temperature < 0 OR temperature > 2 THEN 'temperature;' ELSE '' END || CASE WHEN model = '' THEN 'model;' ELSE '' END, ';') AS violations FROM v""")
def config_precedence(spark, sf):
    """Explicit file value, else environment value, else default; violations listed."""
    file_temp = F.when(F.col("event_id") % 2 == 0, F.get_json_object("props", "$.k").try_cast("double") / 40)
    env_temp = F.when(F.col("event_id") % 3 == 0, F.col("value") / 100)
    model = F.when(F.col("event_id") % 5 == 0, "").otherwise(F.col("event_type"))
    c = table(spark, sf, "events").select("event_id", F.coalesce(file_temp, env_temp, F.lit(0.7)).alias("temperature"), model.alias("model"))
    bad = F.array_compact(F.array(F.when((F.col("temperature") < 0) | (F.col("temperature") > 2), F.lit("temperature")), F.when(F.col("model") == "", F.lit("model"))))
    return c.select("event_id", F.round("temperature", 6).alias("temperature"), F.array_join(bad, ";").alias("violations"))
