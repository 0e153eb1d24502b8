"""Queries on records, logs, goals, tasks, jobs, workspaces and context, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from memlake.functions import text as T
from memlake.operators import ingest, memory, vector, work
from memlake.plans.retrieval import cos, with_
from memlake.sources import datasets as D

QUERIES, ORACLES = {}, {}


def query(sql: str):
    def add(f):
        QUERIES[f.__name__], ORACLES[f.__name__] = f, sql
        return f

    return add


def events(spark: SparkSession, sf: str) -> DataFrame:
    return D.table(spark, sf, "events")


def pick(n, *xs):
    """One of some values by an integer column."""
    return F.element_at(F.array(*(F.lit(x) for x in xs)), (n % len(xs) + 1).cast("int"))


#: Turns of conversations as chunks of a source.
TURNS = "turns AS (SELECT 'conv:' || conv_id AS source_id, 'turn:' || conv_id || ':' || turn AS chunk_id, turn AS ordinal, text, role, length(text) % 5 <> 4 AS is_active FROM conversations)"


def turns(spark: SparkSession, sf: str) -> DataFrame:
    c, conv, turn = D.table(spark, sf, "conversations"), F.col("conv_id").cast("string"), F.col("turn").cast("string")
    return c.select(F.concat(F.lit("conv:"), conv).alias("source_id"), F.concat(F.lit("turn:"), conv, F.lit(":"), turn).alias("chunk_id"), F.col("turn").alias("ordinal"), "text", "role", (F.length("text") % 5 != 4).alias("is_active"))


SOUGHT = "sought AS (SELECT DISTINCT 'conv:' || conv_id AS source_id FROM conversations WHERE role = 'system')"


def sought(spark: SparkSession, sf: str) -> DataFrame:
    return turns(spark, sf).where("role = 'system'").select("source_id").distinct()


# -- records


@query(with_(D.CHUNKS, body="SELECT source_id, any_value(repo) AS repo, any_value(visibility) AS visibility, any_value(scope_key) AS scope_key FROM chunks WHERE source_id IN (SELECT 'doc:' || doc_id FROM labels) GROUP BY source_id"))
def get_source(spark: SparkSession, sf: str) -> DataFrame:
    """Sources of labelled documents."""
    ids = D.table(spark, sf, "labels").select(F.concat(F.lit("doc:"), F.col("doc_id").cast("string")).alias("source_id"))
    return D.chunks(spark, sf).select("source_id", "repo", "visibility", "scope_key").join(ids, "source_id", "left_semi")


@query(with_(D.CHUNKS, body="SELECT chunk_id, source_id, text_hash FROM chunks WHERE is_active AND doc_id IN (SELECT doc_id FROM labels WHERE toxic = 1)"))
def get_chunk(spark: SparkSession, sf: str) -> DataFrame:
    ids = D.table(spark, sf, "labels").where("toxic = 1").select("doc_id")
    return D.chunks(spark, sf).where("is_active").join(ids, "doc_id", "left_semi").select("chunk_id", "source_id", "text_hash")


@query(with_(TURNS, SOUGHT, body="SELECT source_id, chunk_id, CAST(row_number() OVER (PARTITION BY source_id ORDER BY ordinal, chunk_id) AS INTEGER) AS place FROM turns WHERE is_active AND source_id IN (SELECT source_id FROM sought)"))
def chunks_by_source(spark: SparkSession, sf: str) -> DataFrame:
    return memory.by_source(turns(spark, sf), sought(spark, sf)).select("source_id", "chunk_id", "place")


@query(with_(TURNS, SOUGHT, body="SELECT source_id, count(*) AS deactivated FROM turns WHERE is_active AND source_id IN (SELECT source_id FROM sought) GROUP BY source_id"))
def deactivate(spark: SparkSession, sf: str) -> DataFrame:
    return memory.deactivated(turns(spark, sf), sought(spark, sf)).groupBy("source_id").agg(F.count("*").alias("deactivated"))


@query(with_(TURNS, "l AS (SELECT chunk_id, lead(chunk_id) OVER (PARTITION BY source_id ORDER BY ordinal, chunk_id) AS superseded_by FROM turns WHERE role = 'user')", body="SELECT chunk_id, superseded_by, is_active AND superseded_by IS NULL AS is_active FROM turns LEFT JOIN l USING (chunk_id)"))
def supersede(spark: SparkSession, sf: str) -> DataFrame:
    """Each user turn is superseded by the conversation's next one."""
    t = turns(spark, sf)
    following = F.lead("chunk_id").over(W.partitionBy("source_id").orderBy("ordinal", "chunk_id"))
    return memory.superseded(t, t.where("role = 'user'").select("chunk_id", following.alias("superseded_by"))).select("chunk_id", "superseded_by", "is_active")


RATINGS = "ratings AS (SELECT event_id, user_id AS chunk_id, CASE WHEN user_id % 3 > 0 THEN user_id % 10 END AS task_id, CASE WHEN event_type = 'error' THEN 'good' ELSE CAST(CAST(floor(value) AS BIGINT) % 7 AS VARCHAR) END AS signal FROM events)"


def ratings(spark: SparkSession, sf: str) -> DataFrame:
    signal = F.when(F.col("event_type") == "error", "good").otherwise((F.floor("value") % 7).cast("string"))
    return events(spark, sf).select("event_id", F.col("user_id").alias("chunk_id"), F.when(F.col("user_id") % 3 > 0, F.col("user_id") % 10).alias("task_id"), signal.alias("signal"))


@query(with_(RATINGS, body="SELECT event_id, signal, signal IN ('1', '2', '3', '4', '5') AS accepted FROM ratings"))
def add_feedback(spark: SparkSession, sf: str) -> DataFrame:
    return ratings(spark, sf).select("event_id", "signal", memory.valid_rating(F.col("signal")).alias("accepted"))


@query(with_(RATINGS, body="SELECT task_id, chunk_id, least(5.0, sum(CASE signal WHEN '4' THEN 0.5::DOUBLE ELSE 1.0::DOUBLE END)) AS relevance FROM ratings WHERE signal IN ('4', '5') AND task_id IS NOT NULL GROUP BY ALL"))
def feedback_links(spark: SparkSession, sf: str) -> DataFrame:
    return memory.feedback_links(ratings(spark, sf))


@query("SELECT conv_id, turn, substr(coalesce(text, ''), 1, 500) AS prompt, substr(coalesce(text, ''), 1, 800) AS response FROM conversations")
def log_events(spark: SparkSession, sf: str) -> DataFrame:
    c = D.table(spark, sf, "conversations").select("conv_id", "turn", F.col("text").alias("prompt"), F.col("text").alias("response"))
    return memory.truncated(c, prompt="prompt", response="response")


@query("SELECT conv_id, turn, to_json({'role': role, 'turn': turn}) AS line FROM conversations")
def memory_jsonl(spark: SparkSession, sf: str) -> DataFrame:
    return D.table(spark, sf, "conversations").select("conv_id", "turn", F.to_json(F.struct("role", "turn")).alias("line"))


UPSERTS = "upserts AS (SELECT vec_id, label, v, vec_id % 100 AS id FROM vectors)"


@query(with_(D.VECTORS, UPSERTS, body="SELECT id, arg_max(label, vec_id) AS label, arg_max(v, vec_id) AS v FROM upserts GROUP BY id"))
def vector_upsert(spark: SparkSession, sf: str) -> DataFrame:
    """The last vector written under each id, with its metadata."""
    return ingest.current(D.vectors(spark, sf).withColumn("id", F.col("vec_id") % 100), ["id"], [F.col("vec_id")]).select("id", "label", "v")


@query(with_(D.VECTORS, body="SELECT doc_id, v[1] AS x FROM labels JOIN vectors ON doc_id = vec_id WHERE len(v) > 0"))
def vector_get(spark: SparkSession, sf: str) -> DataFrame:
    ids = D.table(spark, sf, "labels").select("doc_id", F.col("doc_id").alias("vec_id"))
    return ids.join(D.vectors(spark, sf).where(F.size("v") > 0), "vec_id").select("doc_id", F.col("v")[0].alias("x"))


@query("SELECT user_id AS chunk_id, event_type AS category, arg_max(value, event_id) AS confidence FROM events GROUP BY ALL")
def link_category(spark: SparkSession, sf: str) -> DataFrame:
    e = events(spark, sf).select(F.col("user_id").alias("chunk_id"), F.col("event_type").alias("category"), F.col("value").alias("confidence"), "event_id")
    return ingest.current(e, ["chunk_id", "category"], [F.col("event_id")]).drop("event_id")


@query("SELECT user_id AS chunk_id, event_type AS project_id, min(event_id) AS written, arg_min(ts, event_id) AS created_at FROM events GROUP BY ALL")
def link_project(spark: SparkSession, sf: str) -> DataFrame:
    e = events(spark, sf).select(F.col("user_id").alias("chunk_id"), F.col("event_type").alias("project_id"), F.col("event_id").alias("written"), F.col("ts").alias("created_at"))
    return ingest.first_written(e, ["chunk_id", "project_id"], [F.col("written")])


@query("WITH t AS (SELECT user_id // 100 AS batch, event_type AS a, lead(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS b FROM events), c AS (SELECT batch, a AS from_topic, b AS to_topic, count(*) AS n FROM t WHERE a <> b GROUP BY ALL) SELECT from_topic, to_topic, arg_max(n, batch) AS count FROM c GROUP BY ALL")
def persist_transitions(spark: SparkSession, sf: str) -> DataFrame:
    """Counts of each batch of users overwrite those of the one before."""
    e = events(spark, sf).withColumn("batch", F.floor(F.col("user_id") / 100))
    following = F.lead("event_type").over(W.partitionBy("user_id").orderBy("ts", "event_id"))
    moved = e.select("batch", F.col("event_type").alias("from_topic"), following.alias("to_topic")).where("from_topic <> to_topic").groupBy("batch", "from_topic", "to_topic").agg(F.count("*").alias("count"))
    return ingest.current(moved, ["from_topic", "to_topic"], [F.col("batch")]).drop("batch")


@query("SELECT page_id, 'site:issue:' || page_id AS source_id, sha256('# ' || url || chr(10) || chr(10) || coalesce(html, '')) AS content_hash FROM pages")
def github_issues(spark: SparkSession, sf: str) -> DataFrame:
    issues = D.table(spark, sf, "pages").select("page_id", F.lit("site").alias("repo"), F.col("page_id").alias("number"), F.col("url").alias("title"), F.col("html").alias("body"))
    return memory.issue_sources(issues).select(F.regexp_extract("source_id", r"(\d+)$", 1).cast("long").alias("page_id"), "source_id", "content_hash")


@query("SELECT doc_id, list_filter(string_split(replace(text, '. ', chr(10) || '- →'), chr(10)), lambda x: starts_with(x, '- →'))[1:5] AS lines FROM documents")
def wiki_connections(spark: SparkSession, sf: str) -> DataFrame:
    return D.table(spark, sf, "documents").select("doc_id", memory.connections(F.replace("text", F.lit(". "), F.lit("\n- →")), 5).alias("lines"))


@query("SELECT page_id, coalesce(lower(regexp_extract(url, '\\.([^./]+)$', 1)) IN ('png', 'jpg', 'jpeg', 'gif', 'webp', 'bmp', 'svg', 'com', 'org'), false) AND NOT lower(regexp_extract(url, '\\.([^./]+)$', 1)) IN ('com', 'org') AS is_image FROM pages")
def image_file(spark: SparkSession, sf: str) -> DataFrame:
    return D.table(spark, sf, "pages").select("page_id", memory.is_image(F.col("url")).alias("is_image"))


@query(with_(D.CHUNKS, body="SELECT chunk_id, CASE source_type WHEN 'conversation_summary' THEN 'social' ELSE 'code' END AS codebook FROM chunks"))
def codebook(spark: SparkSession, sf: str) -> DataFrame:
    return D.chunks(spark, sf).select("chunk_id", memory.codebook(F.col("source_type")).alias("codebook"))


EMBEDDED = """counted AS (SELECT doc_id, list_transform(['0', '1', '2', '3', '4', '5', '6', '7', '8', '9', 'a', 'b', 'c', 'd', 'e', 'f'], lambda d: CAST(len(list_filter(list_transform(regexp_extract_all(lower(substr(coalesce(text, ''), 1, 500)), '[a-z0-9]+'), lambda w: substr(md5(w), 1, 1)), lambda x: x = d)) AS DOUBLE)) AS c FROM documents),
embedded AS (SELECT doc_id, CASE WHEN list_sum(c) > 0 THEN list_transform(c, lambda x: x / sqrt(list_dot_product(c, c))) END AS v FROM counted)"""


@query(with_(EMBEDDED, body="SELECT doc_id, v FROM embedded"))
def embed(spark: SparkSession, sf: str) -> DataFrame:
    return D.table(spark, sf, "documents").select("doc_id", memory.embedded(F.col("text")).alias("v"))


@query(with_(EMBEDDED, f"pair AS (SELECT doc_id, round({cos('a.v', 'b.v')}, 4) AS score FROM embedded a JOIN (SELECT doc_id - 1 AS doc_id, v FROM embedded) b USING (doc_id))", body="SELECT doc_id, score, score >= 0.65 AS was_referenced FROM pair"))
def compute_feedback(spark: SparkSession, sf: str) -> DataFrame:
    """Each document is a context, its successor the response."""
    e = D.table(spark, sf, "documents").select("doc_id", memory.embedded(F.col("text")).alias("v"))
    both = e.join(e.select((F.col("doc_id") - 1).alias("doc_id"), F.col("v").alias("w")), "doc_id")
    return both.select("doc_id", F.round(vector.cosine(F.col("v"), F.col("w")), 4).alias("score")).withColumn("was_referenced", F.col("score") >= 0.65)


# -- goals, todos, tasks

GOALS = f"""goals AS (SELECT vec_id AS goal_id, 'w' || (vec_id % 40) AS workspace_id, CASE WHEN vec_id % 13 = 0 THEN ' ' ELSE ' Goal ' || (vec_id % 60) END AS text, v, vec_id < 100 AS known FROM vectors),
n AS (SELECT *, lower(trim(text)) AS name FROM goals WHERE trim(text) <> ''),
ex AS (SELECT workspace_id, name, min(goal_id) AS exact FROM n WHERE known GROUP BY ALL), fi AS (SELECT workspace_id, name, min(goal_id) AS first FROM n WHERE NOT known GROUP BY ALL),
near AS (SELECT a.goal_id, arg_max(b.goal_id, (round({cos('a.v', 'b.v')}, 6), -b.goal_id)) AS near FROM n a JOIN n b ON a.workspace_id = b.workspace_id AND b.known AND NOT a.known WHERE round({cos('a.v', 'b.v')}, 6) >= 0.2 GROUP BY a.goal_id)"""


def goals(spark: SparkSession, sf: str) -> DataFrame:
    i = F.col("vec_id")
    text = F.when(i % 13 == 0, " ").otherwise(F.concat(F.lit(" Goal "), (i % 60).cast("string")))
    return D.vectors(spark, sf).select(i.alias("goal_id"), F.concat(F.lit("w"), (i % 40).cast("string")).alias("workspace_id"), text.alias("text"), "v")


@query(with_(D.VECTORS, GOALS, body="SELECT n.goal_id, coalesce(exact, near, first) AS canonical_id, CASE WHEN exact IS NOT NULL THEN 'exact' WHEN near IS NOT NULL THEN 'near' ELSE 'new' END AS how FROM n LEFT JOIN ex USING (workspace_id, name) LEFT JOIN near ON near.goal_id = n.goal_id JOIN fi USING (workspace_id, name) WHERE NOT known"))
def goal_canonical(spark: SparkSession, sf: str) -> DataFrame:
    g = goals(spark, sf)
    return memory.canonical_goals(g.where("goal_id >= 100"), g.where("goal_id < 100"), 0.2)


@query(with_(D.VECTORS, GOALS, "c AS (SELECT coalesce(exact, near, first) AS canonical_id FROM n LEFT JOIN ex USING (workspace_id, name) LEFT JOIN near ON near.goal_id = n.goal_id JOIN fi USING (workspace_id, name) WHERE NOT known)", body="SELECT canonical_id, count(*) AS occurrences FROM c GROUP BY ALL"))
def upsert_goal(spark: SparkSession, sf: str) -> DataFrame:
    """How often each canonical goal occurred in a batch."""
    return goal_canonical(spark, sf).groupBy("canonical_id").agg(F.count("*").alias("occurrences"))


@query(with_(D.VECTORS, f"s AS (SELECT a.vec_id AS id, max(round({cos('a.v', 'b.v')}, 6)) AS top FROM vectors a, vectors b WHERE a.vec_id % 100 = 0 AND b.vec_id % 100 <> 0 GROUP BY a.vec_id)", body="SELECT id FROM s WHERE top < 0.5"))
def todo_dedup(spark: SparkSession, sf: str) -> DataFrame:
    """Derived todos: the stated queries; open ones: all other vectors."""
    v = D.vectors(spark, sf)
    return memory.fresh_todos(v.where("vec_id % 100 = 0").select(F.col("vec_id").alias("id"), F.col("v").alias("q")), v.where("vec_id % 100 <> 0").select(F.col("vec_id").alias("todo_id"), "v"), 0.5).select("id")


@query("SELECT user_id AS task_id, arg_max(CASE event_type WHEN 'purchase' THEN 'done' ELSE event_type END, event_id) AS status, min(ts) AS created_at, CASE WHEN arg_max(event_type, event_id) = 'purchase' THEN arg_max(ts, event_id) END AS completed_at FROM events GROUP BY user_id")
def task_state(spark: SparkSession, sf: str) -> DataFrame:
    e = events(spark, sf).select(F.col("user_id").alias("task_id"), F.col("event_id").alias("seq"), "ts", F.when(F.col("event_type") == "purchase", "done").otherwise(F.col("event_type")).alias("status"))
    return memory.task_states(e)


@query("SELECT o_orderkey FROM orders WHERE o_custkey % 4 = 1 AND o_orderstatus = 'O' AND o_orderpriority IN ('1-URGENT', '2-HIGH') AND o_orderpriority = '1-URGENT'")
def list_tasks(spark: SparkSession, sf: str) -> DataFrame:
    tags = F.concat_ws(", ", F.col("o_orderstatus"), F.split("o_orderpriority", "-")[1], F.lit("URGENTLY"))
    t = D.table(spark, sf, "orders").select("o_orderkey", F.concat(F.lit("w"), (F.col("o_custkey") % 4).cast("string")).alias("workspace_id"), F.col("o_orderstatus").alias("status"), F.col("o_orderpriority").alias("priority"), tags.alias("tags"))
    return memory.listed_tasks(t, "w1", status="O", priority="1-URGENT", tag="URGENT").select("o_orderkey")


# -- devices, jobs, roles, workspaces


@query("SELECT user_id AS device_id, max(ts) AS last_seen, count(*) AS events FROM events GROUP BY user_id")
def hook_event(spark: SparkSession, sf: str) -> DataFrame:
    """Every hook event is a heartbeat of its device."""
    return events(spark, sf).groupBy(F.col("user_id").alias("device_id")).agg(F.max("ts").alias("last_seen"), F.count("*").alias("events"))


@query("SELECT user_id AS device_id, CASE WHEN arg_max(event_type, event_id) NOT IN ('click', 'error') THEN arg_max(ts, event_id) END AS quarantined_until FROM events GROUP BY user_id")
def quarantine(spark: SparkSession, sf: str) -> DataFrame:
    until = F.when(F.col("event_type") == "click", " ").when(F.col("event_type") != "error", F.col("ts").cast("string"))
    return memory.quarantines(events(spark, sf).select(F.col("user_id").alias("device_id"), F.col("event_id").alias("seq"), F.coalesce(until, F.lit("")).alias("until")))


JOBS = "jobs AS (SELECT o_orderkey AS embed_id, o_orderdate AS created_at, CASE o_orderstatus WHEN 'O' THEN 'queued' WHEN 'P' THEN 'claimed_one' ELSE 'diverged' END AS status, o_orderpriority = '5-LOW' AS is_golden, o_orderpriority <> '1-URGENT' AS is_audit FROM orders)"


def jobs(spark: SparkSession, sf: str) -> DataFrame:
    status = F.when(F.col("o_orderstatus") == "O", "queued").when(F.col("o_orderstatus") == "P", "claimed_one").otherwise("diverged")
    return D.table(spark, sf, "orders").select(F.col("o_orderkey").alias("embed_id"), F.col("o_orderdate").alias("created_at"), status.alias("status"), (F.col("o_orderpriority") == "5-LOW").alias("is_golden"), (F.col("o_orderpriority") != "1-URGENT").alias("is_audit"))


@query(with_(JOBS, body="SELECT embed_id, created_at FROM jobs WHERE status IN ('queued', 'claimed_one') AND NOT is_golden ORDER BY created_at, embed_id LIMIT 20"))
def claim_order(spark: SparkSession, sf: str) -> DataFrame:
    return memory.open_jobs(jobs(spark, sf)).select("embed_id", "created_at")


@query(with_(JOBS, "f AS (SELECT l_orderkey AS embed_id, l_suppkey AS device, min(l_linenumber) AS seq FROM lineitem GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY embed_id ORDER BY seq, device) AS slot FROM f), p AS (SELECT embed_id, max(device) FILTER (slot = 1) AS a, max(device) FILTER (slot = 2) AS b FROM r GROUP BY embed_id)", body="SELECT embed_id, a AS device_a, CASE WHEN NOT is_golden THEN b END AS device_b, CASE WHEN a IS NULL THEN 'queued' WHEN is_golden OR b IS NULL THEN 'claimed_one' ELSE 'claimed_two' END AS status FROM jobs LEFT JOIN p USING (embed_id)"))
def job_slots(spark: SparkSession, sf: str) -> DataFrame:
    claims = D.table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("embed_id"), F.col("l_suppkey").alias("device"), F.col("l_linenumber").alias("seq"))
    return memory.claimed(jobs(spark, sf).select("embed_id", "is_golden"), claims)


@query(with_(JOBS, body="SELECT embed_id FROM jobs WHERE is_audit AND status = 'diverged' AND embed_id NOT IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R') ORDER BY created_at, embed_id LIMIT 50"))
def diverged_audits(spark: SparkSession, sf: str) -> DataFrame:
    reaped = D.table(spark, sf, "lineitem").where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("embed_id"))
    return memory.diverged_audits(jobs(spark, sf), reaped, 50).select("embed_id")


@query("SELECT o_custkey % 50 AS workspace_id, o_orderpriority AS permission, arg_max(o_orderstatus = 'O', o_orderkey) AS allowed FROM orders GROUP BY ALL")
def set_role_permission(spark: SparkSession, sf: str) -> DataFrame:
    o = D.table(spark, sf, "orders").select((F.col("o_custkey") % 50).alias("workspace_id"), F.col("o_orderpriority").alias("permission"), (F.col("o_orderstatus") == "O").alias("allowed"), "o_orderkey")
    return ingest.current(o, ["workspace_id", "permission"], [F.col("o_orderkey")]).drop("o_orderkey")


@query("SELECT permission, allowed FROM (SELECT o_custkey % 50 AS w, o_orderpriority AS permission, arg_max(o_orderstatus = 'O', o_orderkey) AS allowed FROM orders GROUP BY ALL) WHERE w = 7")
def role_overrides(spark: SparkSession, sf: str) -> DataFrame:
    return set_role_permission(spark, sf).where("workspace_id = 7").select("permission", "allowed")


@query("SELECT c_custkey, c_mktsegment AS kind, CAST(row_number() OVER (PARTITION BY c_nationkey ORDER BY c_mktsegment, c_custkey) AS INTEGER) AS place FROM customer")
def workspaces_for_user(spark: SparkSession, sf: str) -> DataFrame:
    """The workspaces (customers) of each owner (nation), by kind and id."""
    place = F.row_number().over(W.partitionBy("c_nationkey").orderBy("c_mktsegment", "c_custkey"))
    return D.table(spark, sf, "customer").select("c_custkey", F.col("c_mktsegment").alias("kind"), place.alias("place"))


@query("SELECT given, coalesce(c.c_name, s.c_name) AS canonical FROM (SELECT DISTINCT CASE WHEN o_custkey % 3 = 0 THEN 'Alias#' || o_custkey WHEN o_custkey % 3 = 1 THEN 'Customer#' || lpad(CAST(o_custkey AS VARCHAR), 9, '0') ELSE 'none' || o_custkey END AS given FROM orders) LEFT JOIN customer c ON c.c_name = given LEFT JOIN customer s ON 'Alias#' || s.c_custkey = given")
def alias_resolution(spark: SparkSession, sf: str) -> DataFrame:
    k, c = F.col("o_custkey"), D.table(spark, sf, "customer")
    given = F.when(k % 3 == 0, F.concat(F.lit("Alias#"), k.cast("string"))).when(k % 3 == 1, F.concat(F.lit("Customer#"), F.lpad(k.cast("string"), 9, "0"))).otherwise(F.concat(F.lit("none"), k.cast("string")))
    aliases = c.select(F.concat(F.lit("Alias#"), F.col("c_custkey").cast("string")).alias("alias"), F.col("c_name").alias("workspace_id"))
    return memory.resolved(D.table(spark, sf, "orders").select(given.alias("given")).distinct(), c.select(F.col("c_name").alias("id")), aliases)


# -- context, ranking, aggregates


@query(with_(D.CHUNKS, body="SELECT workspace_id, chunk_id FROM chunks WHERE is_active AND source_type = 'conversation_summary' QUALIFY row_number() OVER (PARTITION BY workspace_id ORDER BY created_at DESC, chunk_id) <= 3"))
def session_lane(spark: SparkSession, sf: str) -> DataFrame:
    c = D.chunks(spark, sf).where("source_type = 'conversation_summary'").withColumn("session_id", F.col("workspace_id"))
    return memory.session_chunks(c, 3).select("workspace_id", "chunk_id")


ENTRIES = "entries AS (SELECT doc_id AS idx, substr(text, 1, 10 + doc_id % 60) AS text FROM documents), logs AS (SELECT substr(text, 1, 200) AS context, n_chars % 3 > 0 AS was_referenced FROM documents), refs AS (SELECT idx, (SELECT count(*) FROM logs WHERE was_referenced AND starts_with(context, substr(e.text, 1, 40)) AND length(context) >= length(substr(e.text, 1, 40))) AS refs FROM entries e WHERE length(text) > 0)"


def entries(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    d = D.table(spark, sf, "documents")
    return d.select(F.col("doc_id").alias("idx"), F.expr("substring(text, 1, cast(10 + doc_id % 60 as int))").alias("text")), d.select(F.substring("text", 1, 200).alias("context"), (F.col("n_chars") % 3 > 0).alias("was_referenced"))


@query(with_(ENTRIES, body="SELECT idx, refs, round(0.2::DOUBLE * least(refs, 3), 4) AS boost FROM refs"))
def agg_snapshot_boost(spark: SparkSession, sf: str) -> DataFrame:
    return memory.snapshot_references(*entries(spark, sf)).withColumn("boost", F.round(0.2 * F.least("refs", F.lit(3)), 4))


@query(with_(ENTRIES, body="SELECT idx, CAST(row_number() OVER (ORDER BY refs DESC, idx) AS INTEGER) AS place FROM refs ORDER BY refs DESC, idx LIMIT 100"))
def snapshot_order(spark: SparkSession, sf: str) -> DataFrame:
    """The hundred entries of most references, in order."""
    top = memory.snapshot_references(*entries(spark, sf)).orderBy(F.desc("refs"), "idx").limit(100)
    return top.withColumn("place", F.row_number().over(W.orderBy(F.desc("refs"), "idx"))).select("idx", "place")


ADVISED = "cand AS (SELECT user_id % 20 AS query_id, event_id AS chunk_id, round(value % 1, 6) AS symbolic, round(value / 100 % 1, 6) AS vector, round(value / 7 % 1, 6) AS advisor FROM events), pre AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY symbolic + vector DESC, chunk_id) AS pre FROM cand), few AS (SELECT query_id, chunk_id, pre, CASE WHEN pre <= 20 THEN advisor END AS advisor FROM pre WHERE pre <= 30)"


@query(with_(ADVISED, body="SELECT query_id, chunk_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY advisor DESC NULLS LAST, pre) AS INTEGER) AS place FROM few QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY advisor DESC NULLS LAST, pre) <= 16"))
def topk_advisor(spark: SparkSession, sf: str) -> DataFrame:
    v = F.col("value")
    c = events(spark, sf).select((F.col("user_id") % 20).alias("query_id"), F.col("event_id").alias("chunk_id"), F.round(v % 1, 6).alias("symbolic"), F.round(v / 100 % 1, 6).alias("vector"), F.round(v / 7 % 1, 6).alias("advisor"))
    return memory.advised(c, 8).select("query_id", "chunk_id", "place")


@query("SELECT item_id, CASE WHEN length(text) % 4 = 0 THEN 'v3' WHEN length(text) % 4 = 1 THEN 'v1' WHEN length(text) % 4 = 2 THEN 'v1' WHEN CAST('0x' || substr(sha1(text), 40, 1) AS BIGINT) % 2 = 0 THEN 'v1' ELSE 'v3' END AS version FROM benchmark")
def version_select(spark: SparkSession, sf: str) -> DataFrame:
    """An override of a usable, a base or an unusable version, or none: then one of the active pair."""
    override = pick(F.length("text"), " V3 ", "v1", "v9", "")
    return D.table(spark, sf, "benchmark").select("item_id", memory.selected_version(F.col("text"), override, ("v1", "v3"), ("v3",)).alias("version"))


@query(with_(D.CHUNKS, body="SELECT chunk_id, list_sort(list(DISTINCT l_partkey || ': ' || l_returnflag) FILTER (l_returnflag IS NOT NULL AND l_linestatus = 'O' AND l_returnflag <> 'N')) AS rationale FROM chunks LEFT JOIN lineitem ON l_orderkey = doc_id GROUP BY chunk_id"))
def rationale_enrich(spark: SparkSession, sf: str) -> DataFrame:
    edges = D.table(spark, sf, "lineitem").select(F.concat(F.lit("doc:"), F.col("l_orderkey").cast("string")).alias("source"), F.when(F.col("l_linestatus") == "O", "rationale").otherwise("call").alias("type"), F.col("l_partkey").cast("string").alias("target"), F.when(F.col("l_returnflag") == "N", "").otherwise(F.col("l_returnflag")).alias("rationale"))
    return memory.rationales(D.chunks(spark, sf).select("chunk_id", "source_id"), edges).select("chunk_id", "rationale")


@query(with_(D.CHUNKS, body="SELECT workspace_id, count(*) FILTER (r IS NULL AND k = 1) AS new, count(*) FILTER (r IS NULL AND k > 1) AS deduped, count(*) FILTER (r IS NOT NULL) AS filtered, CAST(coalesce(sum(len(labels)) FILTER (r IS NULL), 0) AS BIGINT) AS links FROM (SELECT *, row_number() OVER (PARTITION BY workspace_id, text_hash ORDER BY doc_id) AS k, CASE WHEN length(text) < 80 THEN 'too_short' END AS r FROM chunks) GROUP BY workspace_id"))
def agg_ingest_report(spark: SparkSession, sf: str) -> DataFrame:
    """Texts in which no line is code are filtered by their length alone."""
    c = D.chunks(spark, sf)
    rows = ingest.exact_dedup(c.limit(0), c, ["doc_id"]).withColumn("reason", F.when(F.length("text") < 80, "too_short")).withColumn("n_labels", F.size("labels"))
    return memory.ingest_report(rows)


@query(with_(D.VECTORS, D.CATEGORIES, body="SELECT category_id, name, evidence_count FROM categories WHERE status = 'active' ORDER BY evidence_count DESC, category_id LIMIT 30"))
def agg_category_evidence(spark: SparkSession, sf: str) -> DataFrame:
    return D.categories(spark, sf).where("status = 'active'").orderBy(F.desc("evidence_count"), "category_id").limit(30).select("category_id", "name", "evidence_count")


@query("SELECT l_suppkey, count(DISTINCT l_partkey) AS before, CASE WHEN count(DISTINCT l_partkey) > 15 THEN count(DISTINCT l_partkey % 10) ELSE count(DISTINCT l_partkey) END AS after FROM lineitem GROUP BY l_suppkey")
def agg_label_reduce(spark: SparkSession, sf: str) -> DataFrame:
    """Labels (parts) of a workspace (supplier) are mapped to fewer where they are more than 15."""
    g = D.table(spark, sf, "lineitem").groupBy("l_suppkey").agg(F.countDistinct("l_partkey").alias("before"), F.countDistinct(F.col("l_partkey") % 10).alias("mapped"))
    return g.select("l_suppkey", "before", F.when(F.col("before") > 15, F.col("mapped")).otherwise(F.col("before")).alias("after"))


@query(with_(D.VECTORS, f"nn AS (SELECT a.vec_id AS task_id, b.vec_id, b.label, row_number() OVER (PARTITION BY a.vec_id ORDER BY round({cos('a.v', 'b.v')}, 6) DESC, b.vec_id) AS rank FROM vectors a, vectors b WHERE a.vec_id % 100 = 0), f AS (SELECT task_id, label, min(rank) AS rank FROM nn WHERE rank <= 20 GROUP BY ALL)", body="SELECT task_id, list(label ORDER BY rank) AS labels FROM f GROUP BY task_id"))
def task_labels(spark: SparkSession, sf: str) -> DataFrame:
    """Labels of the 20 chunks nearest to a task, in the order in which they are first met."""
    v = D.vectors(spark, sf)
    near = vector.nearest(v.where("vec_id % 100 = 0").select(F.col("vec_id").alias("task_id"), F.col("v").alias("q")), v, 20, "task_id", "vec_id").join(v.select("vec_id", "label"), "vec_id")
    first = near.groupBy("task_id", "label").agg(F.min("rank").alias("rank"))
    return first.groupBy("task_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "label"))), lambda x: x["label"]).alias("labels"))


@query("SELECT doc_id, score FROM (SELECT doc_id, round(n_chars / 7.0::DOUBLE, 4) AS score FROM documents)")
def record_projection(spark: SparkSession, sf: str) -> DataFrame:
    return D.table(spark, sf, "documents").select("doc_id", F.round(F.col("n_chars") / 7, 4).alias("score"))


@query("WITH w AS (SELECT doc_id, unnest(list_distinct(regexp_extract_all(lower(text), '[a-z]{4,}'))) AS keyword FROM documents) SELECT keyword, count(*) AS docs FROM w WHERE doc_id IN (SELECT doc_id FROM labels WHERE quality = 1) GROUP BY keyword HAVING count(*) > 1")
def kv_index_load(spark: SparkSession, sf: str) -> DataFrame:
    """A keyword index made of the texts of good documents, one row for each keyword of several."""
    good = D.table(spark, sf, "documents").join(D.table(spark, sf, "labels").where("quality = 1").select("doc_id").distinct(), "doc_id", "left_semi")
    words = good.select(F.explode(F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]{4,}"), F.lit(0)))).alias("keyword"))
    return words.groupBy("keyword").agg(F.count("*").alias("docs")).where("docs > 1")


@query("SELECT c_custkey, regexp_full_match('repo:' || c_name, '(repo|project|campaign):.+') AS named, c_custkey % 2 = 0 AS plain FROM customer")
def scope_key_valid(spark: SparkSession, sf: str) -> DataFrame:
    named, plain = F.concat(F.lit("repo:"), F.col("c_name")), F.when(F.col("c_custkey") % 2 == 1, F.col("c_name"))
    return D.table(spark, sf, "customer").select("c_custkey", T.valid_scope_key(named).alias("named"), T.valid_scope_key(plain).alias("plain"))
