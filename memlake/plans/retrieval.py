"""Retrieval queries and their SQL: scope, keyword lane, vectors, ranking, and the whole search."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from memlake.functions.text import tokens
from memlake.operators import lexical, rank, vector, work
from memlake.operators.scope import Scope, metadata_filter, scoped
from memlake.sources import datasets as D

QUERIES, ORACLES = {}, {}


def query(sql: str):
    def add(f):
        QUERIES[f.__name__], ORACLES[f.__name__] = f, sql
        return f

    return add


def with_(*parts: str, body: str) -> str:
    return "WITH " + ",\n".join(parts) + "\n" + body


def now():
    return F.lit(D.NOW).cast("timestamp")


@query(with_(D.CHUNKS, body="SELECT chunk_id, source_id FROM chunks WHERE is_active AND (visibility = 'public' OR (visibility = 'org' AND org_id IN ('org1', 'org2')) OR (visibility = 'private' AND user_id = 'u3')) AND source_class <> 'reference'"))
def scope_filter(spark: SparkSession, sf: str) -> DataFrame:
    return scoped(D.chunks(spark, sf), Scope("ws1", "u3", ("org1", "org2"))).select("chunk_id", "source_id")


@query(with_(D.CHUNKS, D.LINKS, body="SELECT chunk_id FROM chunks WHERE is_active AND (visibility = 'public' OR (visibility = 'private' AND user_id = 'u3')) AND (source_class <> 'reference' OR chunk_id IN (SELECT chunk_id FROM links WHERE project_id = 'p1' AND workspace_id = 'ws0'))"))
def reference_policy(spark: SparkSession, sf: str) -> DataFrame:
    return scoped(D.chunks(spark, sf), Scope("ws0", "u3", project_id="p1"), D.project_links(spark, sf)).select("chunk_id")


@query(with_(D.CHUNKS, body="SELECT chunk_id FROM chunks WHERE is_active AND source_class = 'reference'"))
def reference_only(spark: SparkSession, sf: str) -> DataFrame:
    return scoped(D.chunks(spark, sf), Scope(reference_only=True)).select("chunk_id")


@query(with_(D.CHUNKS, body="SELECT chunk_id FROM chunks WHERE is_active AND source_class <> 'reference' AND scope_key = 'repo:src1' AND source_type = 'github_issue' AND len(list_intersect(list_transform(labels, lambda x: lower(trim(x))), ['de', 'src1'])) > 0"))
def category_overlap(spark: SparkSession, sf: str) -> DataFrame:
    return scoped(D.chunks(spark, sf), Scope(scope_key="repo:src1", source_type="github_issue", categories=("DE ", "src1"))).select("chunk_id")


@query(with_(D.CHUNKS, body="SELECT chunk_id FROM chunks WHERE is_active AND (visibility = 'public' OR (visibility = 'private' AND user_id = 'u1')) AND coalesce(repo, '') <> 'src0' AND repo IN ('src1', 'src2', 'src3')"))
def vector_where(spark: SparkSession, sf: str) -> DataFrame:
    where = {"$and": [{"$or": [{"visibility": "public"}, {"$and": [{"visibility": "private"}, {"user_id": {"$eq": "u1"}}]}]}, {"repo": {"$ne": "src0"}}, {"repo": {"$in": ["src1", "src2", "src3"]}}]}
    return D.chunks(spark, sf).where(F.col("is_active") & metadata_filter(where)).select("chunk_id")


@query(with_(D.CHUNKS, body="SELECT chunk_id, text_hash FROM chunks WHERE doc_id % 97 IN (1, 2, 3) AND is_active"))
def get_chunks_bulk(spark: SparkSession, sf: str) -> DataFrame:
    c = D.chunks(spark, sf)
    ids = c.where("doc_id % 97 IN (1, 2, 3)").select("chunk_id")
    return c.where("is_active").join(ids, "chunk_id", "left_semi").select("chunk_id", "text_hash")


BM25 = """tok AS (SELECT chunk_id, unnest(regexp_extract_all(lower(text), '[a-z0-9]+') || regexp_extract_all(lower(summary), '[a-z0-9]+')) AS term FROM chunks),
tf AS (SELECT chunk_id, term, count(*) AS tf FROM tok GROUP BY ALL), dl AS (SELECT chunk_id, count(*) AS length FROM tok GROUP BY ALL),
tot AS (SELECT (SELECT count(*) FROM chunks) AS n, (SELECT count(*) FROM tok) AS w), df AS (SELECT term, count(*) AS df FROM tf GROUP BY ALL),
asked AS (SELECT DISTINCT query_id, unnest(regexp_extract_all(lower(query), '[a-z0-9]+')) AS term FROM queries),
lex AS (SELECT query_id, chunk_id, round(sum((CASE WHEN ln((n - df + 0.5) / (df + 0.5)) <= 0 THEN 1e-6 ELSE ln((n - df + 0.5) / (df + 0.5)) END) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * length / (w / n)))), 6) AS bm25
  FROM asked JOIN tf USING (term) JOIN df USING (term) JOIN dl USING (chunk_id), tot GROUP BY ALL),
lane AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY bm25 DESC, chunk_id) AS rank FROM lex)"""


@query(with_(D.CHUNKS, D.QUERIES, BM25, body="SELECT query_id, chunk_id, bm25, CAST(rank AS INTEGER) AS rank FROM lane WHERE rank <= 200"))
def topk_bm25(spark: SparkSession, sf: str) -> DataFrame:
    return lexical.bm25(D.stored_index(spark, sf), D.search_queries(spark, sf))


SYMBOLIC = """(CASE WHEN len(qt) = 0 THEN 0.0 ELSE least(1.0, len(list_intersect(qt, list_distinct(regexp_extract_all(lower(text), '[a-z0-9]+') || regexp_extract_all(lower(summary), '[a-z0-9]+')))) / CAST(len(qt) AS DOUBLE)
  + CASE WHEN len(list_filter(qt, lambda t: contains(lower(source_id), t))) > 0 THEN 0.2 ELSE 0.0 END + CASE WHEN len(list_intersect(qt, regexp_extract_all(lower(array_to_string(labels, ',')), '[a-z0-9]+'))) > 0 THEN 0.1 ELSE 0.0 END) END)"""


@query(with_(D.CHUNKS, D.QUERIES, "q AS (SELECT query_id, list_distinct(regexp_extract_all(lower(query), '[a-z0-9]+')) AS qt FROM queries)", f"s AS (SELECT query_id, chunk_id, round({SYMBOLIC}, 6) AS symbolic FROM q, chunks WHERE is_active)", "r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY symbolic DESC, chunk_id) AS rank FROM s WHERE symbolic > 0)", body="SELECT query_id, chunk_id, symbolic FROM r WHERE rank <= 20"))
def symbolic(spark: SparkSession, sf: str) -> DataFrame:
    found = lexical.symbolic_scores(D.stored_index(spark, sf), D.chunks(spark, sf).where("is_active"), D.search_queries(spark, sf))
    return lexical.best(found.where("symbolic > 0"), "symbolic", 20).drop("rank")


def cos(a: str, b: str) -> str:
    return f"coalesce(list_cosine_similarity({a}, {b}), 0)"


ASKED = "asked_v AS (SELECT vec_id AS query_id, v AS q FROM vectors WHERE vec_id % 100 = 0)"
KNN = f"knn AS (SELECT query_id, vec_id, round({cos('q', 'v')}, 6) AS similarity FROM asked_v, vectors WHERE query_id <> vec_id), knn_r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, vec_id) AS rank FROM knn)"


def asked_vectors(spark: SparkSession, sf: str) -> DataFrame:
    return D.vectors(spark, sf).where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), F.col("v").alias("q"))


def others(spark: SparkSession, sf: str, k: int) -> DataFrame:
    found = vector.nearest(asked_vectors(spark, sf), D.vectors(spark, sf), k + 1, "query_id", "vec_id").where("query_id <> vec_id")
    return found.withColumn("rank", F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("similarity"), "vec_id"))).where(F.col("rank") <= k)


@query(with_(D.VECTORS, ASKED, KNN, body="SELECT query_id, vec_id, similarity, CAST(rank AS INTEGER) AS rank FROM knn_r WHERE rank <= 16"))
def vec_topk(spark: SparkSession, sf: str) -> DataFrame:
    return others(spark, sf, 16)


@query(with_(D.VECTORS, ASKED, KNN, body="SELECT query_id, vec_id, round(greatest(0, least(1, similarity)), 6) AS normalised, round(CASE WHEN max(greatest(0, least(1, similarity))) OVER (PARTITION BY query_id) > 0 THEN greatest(0, least(1, similarity)) / max(greatest(0, least(1, similarity))) OVER (PARTITION BY query_id) ELSE greatest(0, least(1, similarity)) END, 6) AS stretched FROM knn_r WHERE rank <= 16"))
def vec_stretch(spark: SparkSession, sf: str) -> DataFrame:
    v = others(spark, sf, 16).withColumn("normalised", vector.clamp(F.col("similarity")))
    return v.select("query_id", "vec_id", F.round("normalised", 6).alias("normalised"), F.round(vector.stretched("normalised", "query_id"), 6).alias("stretched"))


@query(with_(D.VECTORS, ASKED, KNN, body="SELECT query_id, max(similarity) AS top, round(avg(1 - similarity), 6) AS mean_distance FROM knn_r WHERE rank <= 16 GROUP BY query_id"))
def agg_vector_stats(spark: SparkSession, sf: str) -> DataFrame:
    return others(spark, sf, 16).groupBy("query_id").agg(F.max("similarity").alias("top"), F.round(F.avg(1 - F.col("similarity")), 6).alias("mean_distance"))


BEST = f"best AS (SELECT vec_id, category_id, status, project_id, round({cos('v', 'centre')}, 6) AS similarity FROM vectors, categories)"


def _best(spark: SparkSession, sf: str, keep: str, least: float, k: int) -> DataFrame:
    c = D.categories(spark, sf).where(keep).select("category_id", "centre")
    return vector.nearest(D.vectors(spark, sf).withColumnRenamed("v", "q"), c, k, "vec_id", "category_id", "q", "centre", least)


@query(with_(D.VECTORS, D.CATEGORIES, BEST, body="SELECT vec_id, category_id, similarity FROM best WHERE status = 'active' AND (project_id IS NULL OR project_id = 'p1') AND similarity >= 0.55 QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY similarity DESC, category_id) = 1"))
def link_deductive(spark: SparkSession, sf: str) -> DataFrame:
    return _best(spark, sf, "status = 'active' AND (project_id IS NULL OR project_id = 'p1')", 0.55, 1).drop("rank")


@query(with_(D.VECTORS, D.CATEGORIES, BEST, body="SELECT vec_id, category_id, similarity, CAST(row_number() OVER (PARTITION BY vec_id ORDER BY similarity DESC, category_id) AS INTEGER) AS rank FROM best QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY similarity DESC, category_id) <= 3"))
def topk_category(spark: SparkSession, sf: str) -> DataFrame:
    return vector.nearest(D.vectors(spark, sf).withColumnRenamed("v", "q"), D.categories(spark, sf), 3, "vec_id", "category_id", "q", "centre")


@query(with_(D.VECTORS, D.CATEGORIES, BEST, body="SELECT vec_id, list_sort(list(category_id)) AS category_ids FROM (SELECT * FROM best WHERE status = 'active' AND similarity >= 0.2 AND vec_id % 100 = 0 QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY similarity DESC, category_id) <= 8) GROUP BY vec_id"))
def query_categories(spark: SparkSession, sf: str) -> DataFrame:
    q = D.vectors(spark, sf).where("vec_id % 100 = 0").withColumnRenamed("v", "q")
    found = vector.nearest(q, D.categories(spark, sf).where("status = 'active'"), 8, "vec_id", "category_id", "q", "centre", 0.2)
    return found.groupBy("vec_id").agg(F.sort_array(F.collect_list("category_id")).alias("category_ids"))


@query(with_(D.VECTORS, ASKED, f"n AS (SELECT query_id, max(round({cos('q', 'v')}, 6)) AS similarity, arg_max(vec_id, (round({cos('q', 'v')}, 6), -vec_id)) AS vec_id FROM asked_v, vectors WHERE vec_id < query_id GROUP BY query_id)", body="SELECT query_id, CASE WHEN similarity >= 0.85 THEN vec_id END AS reused, similarity FROM n"))
def nearest_question(spark: SparkSession, sf: str) -> DataFrame:
    top = vector.nearest(asked_vectors(spark, sf), D.vectors(spark, sf), 1, "query_id", "vec_id", before=True)
    return top.select("query_id", F.when(F.col("similarity") >= 0.85, F.col("vec_id")).alias("reused"), "similarity")


@query(with_(D.VECTORS, f"pair AS (SELECT a.vec_id AS job, round({cos('a.v', 'b.v')}, 6) AS cosine FROM vectors a JOIN vectors b ON b.vec_id = a.vec_id + 1 WHERE a.vec_id % 2 = 0)", body="SELECT job, cosine, CASE WHEN cosine >= 0.5 THEN 'verified' ELSE 'diverged' END AS verdict FROM pair"))
def pair_verdict(spark: SparkSession, sf: str) -> DataFrame:
    a = D.vectors(spark, sf)
    b = a.select((F.col("vec_id") - 1).alias("vec_id"), F.col("v").alias("w"))
    c = a.where("vec_id % 2 = 0").join(b, "vec_id").select(F.col("vec_id").alias("job"), F.round(vector.cosine(F.col("v"), F.col("w")), 6).alias("cosine"))
    return c.withColumn("verdict", F.when(F.col("cosine") >= 0.5, "verified").otherwise("diverged"))


STAGES = f"""stages AS (SELECT doc_id, chunk_id, created_at, greatest(0, least(1, (doc_id * 13 % 101) / 100.0::DOUBLE)) AS vector, (doc_id * 7 % 53) / 52.0::DOUBLE AS symbolic,
  greatest(0, 1 - (epoch_us(TIMESTAMP '{D.NOW}') - epoch_us(created_at)) / 86400000000.0::DOUBLE / 30) AS recency, CASE WHEN doc_id % 9 = 0 THEN 1.0 ELSE 0.0 END::DOUBLE AS affinity,
  CASE WHEN doc_id % 3 = 0 THEN NULL ELSE (doc_id % 5) / 4.0::DOUBLE END AS feedback, CASE WHEN doc_id % 4 = 0 THEN NULL ELSE (doc_id % 8) / 7.0::DOUBLE END AS advisor,
  (doc_id % 2)::DOUBLE AS predicted, (doc_id % 6 = 0)::INT::DOUBLE AS hint, (doc_id % 5 = 0)::INT::DOUBLE AS category, (doc_id % 11 = 0)::INT::DOUBLE AS project FROM chunks)"""


def stages(spark: SparkSession, sf: str) -> DataFrame:
    i = F.col("doc_id")
    flag = lambda n: (i % n == 0).cast("double")
    return D.chunks(spark, sf).select("doc_id", "chunk_id", "created_at", vector.clamp(i * 13 % 101 / 100).alias("vector"), (i * 7 % 53 / 52).alias("symbolic"), rank.recency(F.col("created_at"), now()).alias("recency"), flag(9).alias("affinity"), F.when(i % 3 != 0, i % 5 / 4).alias("feedback"), F.when(i % 4 != 0, i % 8 / 7).alias("advisor"), (i % 2).cast("double").alias("predicted"), flag(6).alias("hint"), flag(5).alias("category"), flag(11).alias("project"))


STRONG = "((vector > 0.5)::INT + (symbolic > 0.3)::INT + (recency > 0.8)::INT + (affinity > 0)::INT + coalesce(advisor > 0.7, false)::INT)"
V1 = f"""(CASE WHEN {STRONG} >= 3 THEN 0.12 WHEN {STRONG} = 2 THEN 0.06 ELSE 0.0 END + 0.3 * vector + 0.2 * symbolic + 0.1 * recency + 0.1 * affinity + 0.15 * (2 * coalesce(feedback, 0.5) - 1)
  + 0.15 * coalesce(advisor, 0.5) + 0.05 * predicted + 0.08 * hint + 0.08 * category + 0.08 * project - CASE WHEN coalesce(feedback, 0.5) < 0.3 THEN 0.1 ELSE 0.0 END)"""


@query(with_(D.CHUNKS, STAGES, body=f"SELECT chunk_id, round({V1}, 6) AS score FROM stages"))
def score_v1(spark: SparkSession, sf: str) -> DataFrame:
    return stages(spark, sf).select("chunk_id", F.round(rank.score_v1(), 6).alias("score"))


@query(with_(D.CHUNKS, STAGES, body="SELECT chunk_id, round(least(1, least(1, 1 / (1 + exp(-(-1.5 + 2.0 * vector + 1.0 * symbolic + 0.5 * recency + 0.25 * affinity))) + 0.08 * category) + 0.08 * project), 6) AS score FROM stages"))
def score_v2(spark: SparkSession, sf: str) -> DataFrame:
    return stages(spark, sf).select("chunk_id", F.round(rank.score_v2(-1.5, {"vector": 2.0, "symbolic": 1.0, "recency": 0.5, "affinity": 0.25}), 6).alias("score"))


@query(with_(D.CHUNKS, STAGES, body=f"SELECT chunk_id, round(CASE WHEN doc_id % 8 < 6 THEN least(1, {V1} + 0.04 * least(doc_id % 8, 5)) ELSE {V1} END, 6) AS score FROM stages"))
def task_boost(spark: SparkSession, sf: str) -> DataFrame:
    relevance = F.when(F.col("doc_id") % 8 < 6, F.col("doc_id") % 8)
    return stages(spark, sf).select("chunk_id", F.round(rank.with_task_boost(rank.score_v1(), relevance.cast("double")), 6).alias("score"))


@query(with_(D.CHUNKS, STAGES, body="SELECT chunk_id, list_filter([CASE WHEN vector > 0.5 THEN 'embedding_similarity' END, CASE WHEN symbolic > 0.3 THEN 'token_overlap' END, CASE WHEN recency > 0.8 THEN 'recent_chunk' END, CASE WHEN affinity > 0 THEN 'source_affinity_match' END, CASE WHEN advisor > 0.7 THEN 'llm_advisor_high' END, CASE WHEN doc_id % 17 = 0 THEN 'session-recency' END], lambda x: x IS NOT NULL) AS reasons FROM stages"))
def reasons(spark: SparkSession, sf: str) -> DataFrame:
    return stages(spark, sf).select("chunk_id", rank.reasons(F.col("doc_id") % 17 == 0).alias("reasons"))


@query(with_(D.CHUNKS, STAGES, f"g AS (SELECT doc_id % 20 AS query_id, chunk_id, CASE WHEN doc_id % 17 = 0 THEN greatest(round({V1}, 6), 0.5) ELSE round({V1}, 6) END AS score, doc_id % 17 = 0 AS is_session FROM stages)", "a AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY is_session DESC, score DESC, chunk_id) AS f FROM g)", body="SELECT query_id, chunk_id, score, is_session, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS INTEGER) AS place FROM a WHERE f <= 8"))
def topk_reserved(spark: SparkSession, sf: str) -> DataFrame:
    s = stages(spark, sf).select((F.col("doc_id") % 20).alias("query_id"), "chunk_id", F.round(rank.score_v1(), 6).alias("score"), (F.col("doc_id") % 17 == 0).alias("is_session"))
    out = rank.admitted(s, 8)
    return out.withColumn("place", F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "chunk_id")))


@query(with_(D.QUERIES, body="SELECT query_id, CASE WHEN CAST('0x' || substr(sha256(query), 1, 8) AS BIGINT) % 2 = 0 THEN 'v2' ELSE 'v1' END AS version FROM queries"))
def ab_split(spark: SparkSession, sf: str) -> DataFrame:
    return D.search_queries(spark, sf).select("query_id", rank.picked_version(F.col("query")).alias("version"))


def search_(index: lexical.Index, chunks: DataFrame, queries: DataFrame, scope: Scope, at, k: int = 8, links: DataFrame | None = None, feedback: DataFrame | None = None, vectors: DataFrame | None = None, session: DataFrame | None = None) -> DataFrame:
    """Hybrid search for many queries: candidates of the keyword, vector and session lanes, within the scope, scored and
    admitted.  No text is read: what texts share with queries comes from the postings.

    `vectors` (query_id, chunk_id, vector) are the vector lane's candidates, `session` (chunk_id) the session's thread,
    `feedback` (chunk_id, feedback) ratings.
    """
    known = lexical.matches(index, queries)
    lane = lexical.best(known, "bm25", 200).select("query_id", "chunk_id")
    if vectors is not None:
        lane = lane.unionByName(vectors.select("query_id", "chunk_id"))
    if session is not None:  # a few chunks with every query
        lane = lane.unionByName(queries.select("query_id").crossJoin(F.broadcast(session.select("chunk_id"))))
    rows = lane.distinct().join(scoped(chunks, scope, links).drop("text"), "chunk_id").join(known.select("query_id", "chunk_id", "shared"), ["query_id", "chunk_id"], "left")
    rows = rows.join(F.broadcast(queries.select("query_id", tokens(F.col("query")).alias("qt"))), "query_id")
    symbolic = lexical.symbolic(F.coalesce("shared", F.lit(0)), F.size("qt"), lexical.named_by(F.col("qt"), F.col("source_id")), lexical.labelled_by(F.col("qt"), F.col("labels")))
    rows = rows.withColumns({"symbolic": symbolic, "recency": rank.recency(F.col("created_at"), at)})
    rows = rows.join(vectors, ["query_id", "chunk_id"], "left") if vectors is not None else rows.withColumn("vector", F.lit(0.0))
    rows = rows.join(feedback, "chunk_id", "left") if feedback is not None else rows.withColumn("feedback", F.lit(None).cast("double"))
    zeros = {c: F.lit(0.0) for c in ("affinity", "predicted", "hint", "category")} | {"advisor": F.lit(None).cast("double")}
    if links is not None and scope.project_id is not None:
        own = links.where(F.col("project_id") == scope.project_id).select("chunk_id", F.lit(1.0).alias("project")).distinct()
        rows = rows.join(own, "chunk_id", "left")
    else:
        zeros["project"] = F.lit(0.0)
    if session is not None:
        rows = rows.join(F.broadcast(session.select("chunk_id", F.lit(True).alias("thread")).distinct()), "chunk_id", "left").withColumn("is_session", F.coalesce("thread", F.lit(False)))
    else:
        rows = rows.withColumn("is_session", F.lit(False))
    scored = rows.withColumns(zeros).withColumn("score", F.round(rank.score_v1(), 6)).withColumn("reasons", rank.reasons(F.col("is_session")))
    return rank.admitted(scored.select("query_id", "chunk_id", "source_id", "symbolic", "recency", "score", "reasons", "is_session"), k).drop("is_session")


SEARCH = f"""vlane AS (SELECT a.vec_id AS query_id, c.chunk_id, greatest(0, least(1, round({cos('a.v', 'b.v')}, 6))) AS vector, row_number() OVER (PARTITION BY a.vec_id ORDER BY round({cos('a.v', 'b.v')}, 6) DESC, c.chunk_id) AS n
  FROM vectors a JOIN queries q ON q.query_id = a.vec_id, vectors b JOIN chunks c ON c.doc_id = b.vec_id),
sess AS (SELECT chunk_id FROM chunks WHERE is_active AND source_type = 'conversation_summary' AND workspace_id = 'ws0' ORDER BY created_at DESC, chunk_id LIMIT 3),
fb AS (SELECT chunk_id, greatest(0, least(1, (avg(event_id % 6) - 1) / 4)) AS feedback FROM events JOIN chunks ON doc_id = events.user_id WHERE event_id % 6 > 0 GROUP BY chunk_id),
cand AS (SELECT query_id, chunk_id FROM lane WHERE rank <= 200 UNION SELECT query_id, chunk_id FROM vlane WHERE n <= 50 UNION SELECT query_id, chunk_id FROM queries, sess),
p AS (SELECT cand.query_id, c.chunk_id, c.source_id, {SYMBOLIC} AS symbolic, greatest(0, 1 - (epoch_us(TIMESTAMP '{D.NOW}') - epoch_us(created_at)) / 86400000000.0::DOUBLE / 30) AS recency,
    CASE WHEN c.chunk_id IN (SELECT chunk_id FROM links) THEN 1.0 ELSE 0.0 END AS project, coalesce(v.vector, 0) AS vector, coalesce(fb.feedback, 0.5) AS feedback, c.chunk_id IN (SELECT chunk_id FROM sess) AS is_session
  FROM cand JOIN chunks c USING (chunk_id) JOIN (SELECT query_id, list_distinct(regexp_extract_all(lower(query), '[a-z0-9]+')) AS qt FROM queries) q ON q.query_id = cand.query_id
  LEFT JOIN (SELECT * FROM vlane WHERE n <= 50) v ON v.query_id = cand.query_id AND v.chunk_id = cand.chunk_id LEFT JOIN fb ON fb.chunk_id = c.chunk_id
  WHERE is_active AND (visibility = 'public' OR (visibility = 'org' AND org_id = 'org1') OR (visibility = 'private' AND user_id = 'u3')) AND (source_class <> 'reference' OR c.chunk_id IN (SELECT chunk_id FROM links WHERE workspace_id = 'ws0'))),
st AS (SELECT *, (vector > 0.5)::INT + (symbolic > 0.3)::INT + (recency > 0.8)::INT AS strong FROM p),
sc AS (SELECT *, round(CASE WHEN strong = 3 THEN 0.12 WHEN strong = 2 THEN 0.06 ELSE 0.0 END + 0.3 * vector + 0.2 * symbolic + 0.1 * recency + 0.15 * (2 * feedback - 1) + 0.075 + 0.08 * project - CASE WHEN feedback < 0.3 THEN 0.1 ELSE 0.0 END, 6) AS raw FROM st),
f AS (SELECT *, CASE WHEN is_session THEN greatest(raw, 0.5) ELSE raw END AS score FROM sc),
adm AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY is_session DESC, score DESC, chunk_id) AS first FROM f),
won AS (SELECT query_id, chunk_id, source_id, score, is_session, vector, symbolic, recency, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS place FROM adm WHERE first <= 8)"""
FOUND = """SELECT query_id, chunk_id, source_id, round(score, 4) AS score, CAST(place AS INTEGER) AS place,
  list_filter([CASE WHEN vector > 0.5 THEN 'embedding_similarity' END, CASE WHEN symbolic > 0.3 THEN 'token_overlap' END, CASE WHEN recency > 0.8 THEN 'recent_chunk' END, CASE WHEN is_session THEN 'session-recency' END], lambda x: x IS NOT NULL) AS reasons FROM won"""


@query(with_(D.CHUNKS, D.LINKS, D.QUERIES, D.VECTORS, BM25, SEARCH, body=FOUND))
def search(spark: SparkSession, sf: str) -> DataFrame:
    """Every benchmark item against all chunks; documents' embeddings are their chunks', an item's is that of its number."""
    scope, c, queries = Scope("ws0", "u3", ("org1",), project_id="p1"), D.chunks(spark, sf), D.search_queries(spark, sf)
    v = D.vectors(spark, sf)
    asked = v.join(F.broadcast(queries.select(F.col("query_id").alias("vec_id"))), "vec_id", "left_semi").select(F.col("vec_id").alias("query_id"), F.col("v").alias("q"))
    items = v.join(c.select(F.col("doc_id").alias("vec_id"), "chunk_id"), "vec_id").select("chunk_id", "v")
    near = vector.nearest(asked, items, 50, "query_id", "chunk_id").select("query_id", "chunk_id", vector.clamp(F.col("similarity")).alias("vector"))
    thread = c.where("is_active AND source_type = 'conversation_summary' AND workspace_id = 'ws0'").orderBy(F.desc("created_at"), "chunk_id").limit(3).select("chunk_id")
    rated = D.table(spark, sf, "events").select(F.col("user_id").alias("doc_id"), (F.col("event_id") % 6).cast("string").alias("signal")).join(c.select("doc_id", "chunk_id"), "doc_id")
    out = search_(D.stored_index(spark, sf), c, queries, scope, now(), links=D.project_links(spark, sf), feedback=work.feedback(rated), vectors=near, session=thread)
    return out.select("query_id", "chunk_id", "source_id", F.round("score", 4).alias("score"), "place", "reasons")


def compress_prompt(spark: SparkSession, sf: str) -> DataFrame:
    hits = search(spark, sf).join(D.chunks(spark, sf).select("chunk_id", "text", "summary", "labels"), "chunk_id")
    entries = F.transform(F.array_sort(F.collect_list(F.struct("place", "source_id", "text", "summary", "labels"))), lambda e: F.struct(e["source_id"].alias("source_id"), e["text"].alias("text"), e["summary"].alias("summary"), e["labels"].alias("labels")))
    return hits.groupBy("query_id").agg(entries.alias("entries")).select("query_id", rank.compressed(F.col("entries"), 1200).alias("prompt"))


QUERIES["compress_prompt"] = compress_prompt
