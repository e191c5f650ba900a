"""Vector, retrieval and clustering queries over ``embeddings`` and ``documents``."""

from __future__ import annotations

from pyspark.sql import functions as F

from weftline import fixed
from weftline.functions import text as tx
from weftline.functions import vectors as vx
from weftline.operators import clustering, postings, retrieval
from weftline.operators.nearest import nearest
from weftline.registry import query
from weftline.sources.tables import spread, table

_Q = [0, 1, 2, 3, 4]
V = "CAST(embedding AS DOUBLE[])"
SIMS = f"""sims AS (SELECT q.vec_id AS query_id, e.vec_id, list_cosine_similarity(CAST(e.embedding AS DOUBLE[]), CAST(q.embedding AS DOUBLE[])) AS similarity FROM embeddings e, embeddings q WHERE q.vec_id IN (0, 1, 2, 3, 4))"""


def _emb(spark, sf):
    return table(spark, sf, "embeddings")


def _queries(spark, sf):
    return retrieval.query_vectors(_emb(spark, sf), "vec_id", "embedding", _Q)


@query("cosine_topk", "VR2 SC17 TK4 TK5 JN5", f"""WITH {SIMS}, r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, vec_id) AS rank FROM sims)
SELECT query_id, vec_id, round(similarity, 6) AS similarity, CAST(rank AS INTEGER) AS rank FROM r WHERE rank <= 10""")
def cosine_topk(spark, sf):
    found = retrieval.top_k(_emb(spark, sf), "vec_id", "embedding", _queries(spark, sf), 10)
    return found.select("query_id", "vec_id", F.round("similarity", 6).alias("similarity"), "rank")


@query("cosine_threshold", "FLT8 SC17", f"WITH {SIMS} SELECT query_id, vec_id, round(similarity, 6) AS similarity FROM sims WHERE similarity >= 0.3")
def cosine_threshold(spark, sf):
    found = retrieval.above(_emb(spark, sf), "vec_id", "embedding", _queries(spark, sf), fixed.SIMILARITY_THRESHOLD)
    return found.withColumn("similarity", F.round("similarity", 6))


_CENTROIDS = """cells AS (SELECT label, unnest(embedding) AS v, unnest(range(0, len(embedding))) AS pos FROM embeddings), means AS (SELECT label, pos, avg(CAST(v AS DOUBLE)) AS v FROM cells GROUP BY 1, 2),
cents AS (SELECT label, list(v ORDER BY pos) AS c FROM means GROUP BY label)"""


@query("centroid_by_label", "AG14", f"WITH {_CENTROIDS} SELECT label, CAST(pos AS INTEGER) AS pos, round(v, 6) AS value FROM means")
def centroid_by_label(spark, sf):
    c = retrieval.centroids(_emb(spark, sf), "label", "embedding")
    return c.select("label", F.posexplode("centroid").alias("pos", "value")).withColumn("value", F.round("value", 6))


@query("nearest_summaries", "VR3 JN4", f"""WITH {_CENTROIDS}, s AS (SELECT e.vec_id AS query_id, CAST(label_c AS BIGINT) AS summary_id, similarity FROM (SELECT e.vec_id, c.label AS label_c, list_cosine_similarity(CAST(e.embedding AS DOUBLE[]), c.c) AS similarity FROM embeddings e, cents c WHERE e.vec_id <= 4) e),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, summary_id) AS rank FROM s) SELECT query_id, summary_id, round(similarity, 6) AS similarity FROM r WHERE rank <= 3""")
def nearest_summaries(spark, sf):
    c = retrieval.centroids(_emb(spark, sf), "label", "embedding").withColumnRenamed("label", "summary_id")
    return retrieval.top_k(c, "summary_id", "centroid", _queries(spark, sf), 3).select("query_id", "summary_id", F.round("similarity", 6).alias("similarity"))


@query("retrieve_with_context", "VR9 VR3 VR2", f"""WITH {_CENTROIDS}, {SIMS}, s AS (SELECT e.vec_id AS query_id, CAST(c.label AS BIGINT) AS id, list_cosine_similarity(CAST(e.embedding AS DOUBLE[]), c.c) AS similarity FROM embeddings e, cents c WHERE e.vec_id <= 4),
a AS (SELECT 'summary' AS kind, query_id, id, similarity, row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, id) AS rn FROM s), b AS (SELECT 'chunk' AS kind, query_id, vec_id AS id, similarity, row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, vec_id) AS rn FROM sims)
SELECT kind, query_id, id, round(similarity, 6) AS similarity, CASE WHEN kind = 'summary' THEN 'label ' || id ELSE substr(d.text, 1, 150) END AS text FROM (SELECT * FROM a WHERE rn <= 3 UNION ALL SELECT * FROM b WHERE rn <= 6) u LEFT JOIN documents d ON d.doc_id = u.id WHERE kind = 'summary' OR d.doc_id IS NOT NULL""")
def retrieve_with_context(spark, sf):
    """Top summaries and top chunks per query; texts are fetched only for what was found."""
    emb, asked = _emb(spark, sf), _queries(spark, sf)
    c = retrieval.centroids(emb, "label", "embedding").withColumnRenamed("label", "id")
    summaries = retrieval.top_k(c, "id", "centroid", asked, 3).select(F.lit("summary").alias("kind"), "query_id", "id", "similarity", F.concat(F.lit("label "), F.col("id").cast("string")).alias("text"))
    hits = retrieval.top_k(emb, "vec_id", "embedding", asked, 6).select("query_id", F.col("vec_id").alias("id"), "similarity")
    docs = table(spark, sf, "documents").select(F.col("doc_id").alias("id"), F.substring("text", 1, 150).alias("text"))
    chunks = docs.join(F.broadcast(hits), "id").select(F.lit("chunk").alias("kind"), "query_id", "id", "similarity", "text")
    return summaries.unionByName(chunks).withColumn("similarity", F.round("similarity", 6))


@query("l2_normalised", "SC18", f"""WITH n AS (SELECT vec_id, {V} AS v, sqrt(list_sum(list_transform({V}, lambda x: x * x))) AS n FROM embeddings)
SELECT vec_id, round(n, 6) AS norm, round(v[1] / n, 6) AS first, round(v[64] / n, 6) AS last, round(list_sum(v) / n, 6) AS total FROM n""")
def l2_normalised(spark, sf):
    e = spread(_emb(spark, sf)).select("vec_id", vx.norm(F.col("embedding")).alias("norm"), vx.l2_normalise(F.col("embedding")).alias("u"))
    total = F.aggregate("u", F.lit(0.0), lambda a, x: a + x)
    return e.select("vec_id", F.round("norm", 6).alias("norm"), F.round(F.col("u")[0], 6).alias("first"), F.round(F.element_at("u", -1), 6).alias("last"), F.round(total, 6).alias("total"))


# One unit of the last half-precision place below x; single-precision values are exact in double.
_UNIT = "pow(2, greatest(floor(log2(abs(x))), -14) - 10)"
_HALVES = f"list_transform({V}, lambda x: CASE WHEN x = 0 THEN 0.0 ELSE sign(x) * floor(abs(x) / {_UNIT}) * {_UNIT} END)"


@query("half_round_trip", "SC19 SC20", f"""WITH h AS (SELECT vec_id, {V} AS v, {_HALVES} AS w FROM embeddings)
SELECT vec_id, CAST(2 * len(v) AS INTEGER) AS bytes, round(list_distance(v, w), 6) AS error, round(list_cosine_similarity(v, w), 6) AS similarity FROM h""")
def half_round_trip(spark, sf):
    """Half-precision size and error per vector."""
    e = _emb(spark, sf).withColumn("half", vx.to_half(F.col("embedding"))).withColumn("back", vx.from_half(F.col("half")))
    return e.select("vec_id", F.octet_length("half").alias("bytes"), F.round(vx.l2_distance(F.col("embedding"), F.col("back")), 6).alias("error"), F.round(vx.cosine(F.col("embedding"), F.col("back")), 6).alias("similarity"))


@query("quantisation_error", "SC20", f"""SELECT vec_id, round(sqrt(list_sum(list_transform({V}, lambda x: (x - floor(x * 128) / 128) * (x - floor(x * 128) / 128)))), 6) AS error FROM embeddings""")
def quantisation_error(spark, sf):
    coarse = F.transform("embedding", lambda x: F.floor(x.cast("double") * 128) / 128)
    return _emb(spark, sf).select("vec_id", F.round(vx.l2_distance(F.col("embedding"), coarse), 6).alias("error"))


@query("blob_round_trip", "SC21", "SELECT vec_id, CAST(4 * len(embedding) AS INTEGER) AS bytes, true AS same FROM embeddings")
def blob_round_trip(spark, sf):
    e = _emb(spark, sf).withColumn("blob", vx.to_blob(F.col("embedding")))
    return e.select("vec_id", F.octet_length("blob").alias("bytes"), (vx.from_blob(F.col("blob")) == F.col("embedding")).alias("same"))


def _bm25_sql(terms: list[str]) -> str:
    tf = ", ".join(f"len(list_filter(t, lambda x: x = '{w}')) AS tf{i}" for i, w in enumerate(terms))
    df = ", ".join(f"(SELECT count(*) FROM tok WHERE tf{i} > 0) AS df{i}" for i in range(len(terms)))
    score = " + ".join(f"greatest(ln((nd - df{i} + 0.5) / (df{i} + 0.5)), 0.000001) * tf{i} * 2.2 / (tf{i} + 1.2 * (0.25 + 0.75 * dl / avgdl))" for i in range(len(terms)))
    held = " AND ".join(f"tf{i} > 0" for i in range(len(terms)))
    return f"""t0 AS (SELECT doc_id, list_filter(string_split_regex(strip_accents(lower(text || ' ' || source || ' ' || lang)), '[^\\p{{L}}\\p{{N}}]+'), lambda x: x <> '') AS t FROM documents),
tok AS (SELECT doc_id, len(t) AS dl, {tf} FROM t0), st AS (SELECT count(*) AS nd, avg(dl) AS avgdl, {df} FROM tok),
ranked AS (SELECT doc_id, -({score}) AS rank FROM tok, st WHERE {held}), cand AS (SELECT * FROM ranked ORDER BY rank, doc_id LIMIT 50)"""


def _docs(spark, sf):
    return spread(table(spark, sf, "documents").select("doc_id", F.concat_ws(" ", "text", "source", "lang").alias("indexed")))


@query("bm25_top50", "VR11 TK3", f"WITH {_bm25_sql(['the', 'and'])} SELECT doc_id, round(rank, 6) AS rank FROM cand")
def bm25_top50(spark, sf):
    return retrieval.candidates(_docs(spark, sf), "doc_id", F.col("indexed"), ["the", "and"]).withColumn("rank", F.round("rank", 6))


@query("bm25_folded", "VR11", f"WITH {_bm25_sql(['etre', 'de'])} SELECT doc_id, round(rank, 6) AS rank FROM cand")
def bm25_folded(spark, sf):
    return retrieval.candidates(_docs(spark, sf), "doc_id", F.col("indexed"), ["etre", "de"]).withColumn("rank", F.round("rank", 6))


_HYBRID = """j AS (SELECT c.doc_id, c.rank, CAST(e.embedding AS DOUBLE[]) AS v FROM cand c JOIN embeddings e ON e.vec_id = c.doc_id), qv AS (SELECT v AS q FROM j ORDER BY rank, doc_id LIMIT 1), h AS (SELECT doc_id, rank, list_cosine_similarity(v, q) AS similarity FROM j, qv)"""


@query("hybrid_search", "VR12 FLT8 VR11", f"WITH {_bm25_sql(['the', 'and'])}, {_HYBRID} SELECT doc_id, round(rank, 6) AS rank, round(similarity, 6) AS similarity FROM h WHERE similarity >= 0.3 ORDER BY similarity DESC, doc_id LIMIT 10")
def hybrid_search(spark, sf):
    found = retrieval.hybrid(_docs(spark, sf), "doc_id", F.col("indexed"), _emb(spark, sf), "vec_id", "embedding", ["the", "and"], 10)
    return found.select("doc_id", F.round("rank", 6).alias("rank"), F.round("similarity", 6).alias("similarity"))


@query("hybrid_search_ordered", "VR12", f"WITH {_bm25_sql(['the', 'of'])}, {_HYBRID} SELECT doc_id, round(rank, 6) AS rank, round(similarity, 6) AS similarity FROM h ORDER BY similarity DESC, doc_id LIMIT 10")
def hybrid_search_ordered(spark, sf):
    found = retrieval.hybrid(_docs(spark, sf), "doc_id", F.col("indexed"), _emb(spark, sf), "vec_id", "embedding", ["the", "of"], 10, threshold=None)
    return found.select("doc_id", F.round("rank", 6).alias("rank"), F.round("similarity", 6).alias("similarity"))


_FOLDED = "[x for x in string_split_regex(strip_accents(lower({})), '[^\\p{{L}}\\p{{N}}]+') if x <> '']"
_TERM_VECTOR = "SELECT {key}, CAST('0x' || substr(md5(term), 1, 2) AS INTEGER) % 64 AS dim, sum(CASE WHEN substr(md5(term), 3, 1) < '8' THEN 1 ELSE -1 END * {weight}) AS v FROM {rows} GROUP BY 1, 2"


def _hybrid_benchmark_sql() -> str:
    return f"""WITH dt AS (SELECT doc_id, {_FOLDED.format("text || ' ' || source || ' ' || lang")} AS t FROM documents), tt AS (SELECT doc_id, len(t) AS dl, unnest(t) AS term FROM dt),
terms AS (SELECT doc_id, dl, term, count(*) AS tf FROM tt GROUP BY ALL), ii AS (SELECT item_id, unnest({_FOLDED.format("text")}) AS term FROM benchmark),
wanted AS (SELECT DISTINCT item_id, term FROM ii), st AS (SELECT count(*) AS docs, avg(len(t)) AS avgdl FROM dt),
fr AS (SELECT term, count(*) AS df FROM terms WHERE term IN (SELECT term FROM wanted) GROUP BY 1), needed AS (SELECT item_id, count(*) AS needed FROM wanted GROUP BY 1),
sc AS (SELECT item_id, doc_id, count(*) AS held, round(-sum(greatest(ln((docs - df + 0.5) / (df + 0.5)), 0.000001) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / avgdl))), 9) AS rank FROM terms JOIN wanted USING (term) JOIN fr USING (term), st GROUP BY 1, 2),
best AS (SELECT item_id, doc_id, rank FROM sc JOIN needed USING (item_id) WHERE held = needed QUALIFY row_number() OVER (PARTITION BY item_id ORDER BY rank, doc_id) <= 50),
pairs AS (SELECT * FROM best UNION ALL SELECT DISTINCT item_id, doc_id, CAST(NULL AS DOUBLE) FROM ii, terms WHERE item_id NOT IN (SELECT item_id FROM best)),
{_VECTORS},
sim AS (SELECT item_id, doc_id, rank, round(CASE WHEN dn.s * qn.s > 0 THEN coalesce(dot, 0) / (dn.s * qn.s) ELSE 0 END, 9) AS similarity FROM pairs LEFT JOIN dots USING (item_id, doc_id) JOIN dn USING (doc_id) JOIN qn USING (item_id))
SELECT item_id, doc_id, round(rank, 6) AS rank, round(similarity, 6) AS similarity FROM sim WHERE similarity >= 0.3 QUALIFY row_number() OVER (PARTITION BY item_id ORDER BY sim.similarity DESC, doc_id) <= 10"""


# Vectors of texts (from ``terms``) and questions (from ``ii``), their lengths and products; all sums are whole numbers.
_VECTORS = f"""dv AS ({_TERM_VECTOR.format(key="doc_id", weight="tf", rows="terms")}), qv AS ({_TERM_VECTOR.format(key="item_id", weight="1", rows="ii")}),
dn AS (SELECT doc_id, sqrt(sum(v * v)) AS s FROM dv GROUP BY 1), qn AS (SELECT item_id, sqrt(sum(v * v)) AS s FROM qv GROUP BY 1),
dots AS (SELECT item_id, doc_id, sum(dv.v * qv.v) AS dot FROM dv JOIN qv USING (dim) GROUP BY 1, 2)"""


@query("hybrid_benchmark", "VR12 VR13 FLT8 VR11 TK3", _hybrid_benchmark_sql())
def hybrid_benchmark(spark, sf):
    """Every benchmark text asks with all its words; a question whose words no text holds together is compared with every vector."""
    index = postings.build(table(spark, sf, "documents").select("doc_id", F.concat_ws(" ", "text", "source", "lang").alias("indexed")), "doc_id", F.col("indexed"))
    found = postings.search(index, table(spark, sf, "benchmark").select("item_id", "text"), "item_id", F.col("text"), 10, fixed.CANDIDATES, fixed.SIMILARITY_THRESHOLD)
    return found.select("item_id", "doc_id", F.round("rank", 6).alias("rank"), F.round("similarity", 6).alias("similarity"))


@query("bm25_questions", "VR11 TK3", f"""WITH dt AS (SELECT doc_id, {_FOLDED.format("text || ' ' || source || ' ' || lang")} AS t FROM documents), tt AS (SELECT doc_id, len(t) AS dl, unnest(t) AS term FROM dt),
terms AS (SELECT doc_id, dl, term, count(*) AS tf FROM tt GROUP BY ALL), wanted AS (SELECT DISTINCT conv_id, term FROM (SELECT conv_id, unnest(array_slice({_FOLDED.format("text")}, 1, 3)) AS term FROM conversations WHERE turn = 0)),
st AS (SELECT count(*) AS docs, avg(len(t)) AS avgdl FROM dt), fr AS (SELECT term, count(*) AS df FROM terms GROUP BY 1), needed AS (SELECT conv_id, count(*) AS needed FROM wanted GROUP BY 1),
sc AS (SELECT conv_id, doc_id, count(*) AS held, round(-sum(greatest(ln((docs - df + 0.5) / (df + 0.5)), 0.000001) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / avgdl))), 9) AS rank FROM terms JOIN wanted USING (term) JOIN fr USING (term), st GROUP BY 1, 2)
SELECT conv_id, doc_id, round(rank, 6) AS rank FROM sc JOIN needed USING (conv_id) WHERE held = needed QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY sc.rank, doc_id) <= 10""")
def bm25_questions(spark, sf):
    """The opening words of every conversation ask; the ten best texts that hold them."""
    index = postings.build(table(spark, sf, "documents").select("doc_id", F.concat_ws(" ", "text", "source", "lang").alias("indexed")), "doc_id", F.col("indexed"))
    opening = table(spark, sf, "conversations").filter("turn = 0").select("conv_id", F.array_join(F.slice(tx.terms(F.col("text")), 1, 3), " ").alias("text"))
    found = postings.candidates(index, postings.asked(index, opening, "conv_id", F.col("text")), "conv_id", 10)
    return found.select("conv_id", "doc_id", F.round("rank", 6).alias("rank"))


@query("hybrid_fallback", "VR13 FLT8", f"WITH {SIMS} SELECT vec_id AS doc_id, round(similarity, 6) AS similarity FROM sims WHERE query_id = 3 AND similarity >= 0.3 ORDER BY sims.similarity DESC, vec_id LIMIT 10")
def hybrid_fallback(spark, sf):
    """No document holds the term, so every vector is scored."""
    asked = _queries(spark, sf)[3]
    found = retrieval.hybrid(_docs(spark, sf), "doc_id", F.col("indexed"), _emb(spark, sf), "vec_id", "embedding", ["qqqzzzqqq"], 10, query_vector=asked)
    return found.select("doc_id", F.round("similarity", 6).alias("similarity"))


@query("embedded_topk", "VR1 VR10 TK5 VR2", f"""WITH dt AS (SELECT doc_id, {_FOLDED.format("text")} AS t FROM documents WHERE doc_id NOT IN (SELECT vec_id FROM embeddings)), tt AS (SELECT doc_id, unnest(t) AS term FROM dt),
terms AS (SELECT doc_id, term, count(*) AS tf FROM tt GROUP BY ALL), ii AS (SELECT item_id, unnest({_FOLDED.format("text")}) AS term FROM benchmark), {_VECTORS},
sim AS (SELECT qn.item_id AS query_id, dn.doc_id, CASE WHEN dn.s * qn.s > 0 THEN coalesce(dot, 0) / (qn.s * dn.s) ELSE 0 END AS similarity FROM qn CROSS JOIN dn LEFT JOIN dots ON dots.item_id = qn.item_id AND dots.doc_id = dn.doc_id)
SELECT query_id, doc_id, round(similarity, 6) AS similarity, CAST(row_number() OVER (PARTITION BY query_id ORDER BY sim.similarity DESC, doc_id) AS INTEGER) AS rank FROM sim QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY sim.similarity DESC, doc_id) <= 5""")
def embedded_topk(spark, sf):
    """Documents without a stored vector are embedded and searched for every benchmark text; questions are a table as well."""
    docs = spread(table(spark, sf, "documents").select("doc_id", "text"))
    bare = docs.join(_emb(spark, sf).select(F.col("vec_id").alias("doc_id")), "doc_id", "left_anti")
    vectors = postings.own_terms(bare, "doc_id", F.col("text"))
    asked = postings.own_terms(table(spark, sf, "benchmark"), "item_id", F.col("text"))
    return nearest(asked, "item_id", "vector", vectors, "doc_id", "vector", 5).withColumn("similarity", F.round("similarity", 6))


@query("nearest_of_many", "VR2 TK4 TK5 SC17", f"""WITH s AS (SELECT q.vec_id AS query_id, e.vec_id, round(list_cosine_similarity({V.replace('embedding', 'e.embedding')}, {V.replace('embedding', 'q.embedding')}), 9) AS similarity FROM embeddings e, embeddings q WHERE q.vec_id % 20 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, vec_id) AS rank FROM s) SELECT query_id, vec_id, round(similarity, 6) AS similarity, CAST(rank AS INTEGER) AS rank FROM r WHERE rank <= 10""")
def nearest_of_many(spark, sf):
    """Every vector whose id is divisible by 20 asks for its ten nearest of all vectors."""
    e = _emb(spark, sf)
    found = nearest(e.filter("vec_id % 20 = 0"), "vec_id", "embedding", e, "vec_id", "embedding", 10)
    return found.withColumn("similarity", F.round("similarity", 6))


_TREE_THRESHOLD = 0.2


def _leaves(spark, sf):
    return _emb(spark, sf).select(F.col("vec_id").alias("id"), F.transform("embedding", lambda x: x.cast("double")).alias("vec"))


@query("greedy_clusters", "VR4 VR5")
def greedy_clusters(spark, sf):
    leaves = _leaves(spark, sf)
    return clustering.cluster(leaves, _TREE_THRESHOLD, leaves.count()).select("block", F.col("parent").alias("cluster_id"), F.col("child").alias("vec_id"))


@query("cluster_tree", "VR6 VR7")
def cluster_tree(spark, sf):
    return clustering.with_parents(*clustering.build_tree(_leaves(spark, sf), _TREE_THRESHOLD))


@query("tree_search", "VR8")
def tree_search(spark, sf):
    nodes, edges = clustering.build_tree(_leaves(spark, sf), _TREE_THRESHOLD)
    return clustering.tree_search(nodes, edges, _queries(spark, sf), 10).withColumn("similarity", F.round("similarity", 6))
