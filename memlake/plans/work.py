"""Queries on ingestion, sequences, feedback and the work tables, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from memlake.functions import text as T
from memlake.operators import ingest, rank, work
from memlake.plans.retrieval import now, with_
from memlake.sources import datasets as D

QUERIES, ORACLES = {}, {}


def query(sql: str | None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return add


def events(spark: SparkSession, sf: str) -> DataFrame:
    return D.table(spark, sf, "events")


# -- ingestion


@query("SELECT doc_id, 'doc:' || doc_id AS source_id, CASE WHEN doc_id % 10 = 3 THEN 'new' WHEN doc_id % 10 = 4 THEN 'new' WHEN doc_id % 10 = 5 THEN 'changed' ELSE 'unchanged' END AS state FROM documents")
def source_state(spark: SparkSession, sf: str) -> DataFrame:
    d = D.table(spark, sf, "documents").select("doc_id", F.concat(F.lit("doc:"), F.col("doc_id").cast("string")).alias("source_id"), T.text_hash(F.col("text")).alias("h"))
    incoming = d.select("doc_id", "source_id", F.when(F.col("doc_id") % 10 == 4, "").otherwise(F.col("h")).alias("content_hash"))
    stored = d.where("doc_id % 10 <> 3").select("source_id", F.when(F.col("doc_id") % 10 == 5, "old").otherwise(F.col("h")).alias("content_hash"))
    return ingest.source_state(incoming, stored).select("doc_id", "source_id", "state")


DEDUP = "dd AS (SELECT *, doc_id % 5 = 0 AS is_new, first_value(chunk_id) OVER (PARTITION BY workspace_id, text_hash ORDER BY (doc_id % 5 = 0)::INT, created_at, source_id, chunk_id) AS canonical_id FROM chunks)"


def deduped(spark: SparkSession, sf: str) -> DataFrame:
    c = D.chunks(spark, sf).select("doc_id", "chunk_id", "source_id", "workspace_id", "text_hash", "created_at")
    return ingest.exact_dedup(c.where("doc_id % 5 <> 0"), c.where("doc_id % 5 = 0"), ["created_at", "source_id"])


@query(with_(D.CHUNKS, DEDUP, body="SELECT chunk_id, canonical_id, chunk_id = canonical_id AS is_canonical FROM dd"))
def exact_dedup(spark: SparkSession, sf: str) -> DataFrame:
    return deduped(spark, sf).select("chunk_id", "canonical_id", "is_canonical")


@query(with_(D.CHUNKS, DEDUP, body="SELECT DISTINCT workspace_id, canonical_id, source_id FROM dd"))
def source_refs(spark: SparkSession, sf: str) -> DataFrame:
    return ingest.source_refs(deduped(spark, sf))


@query(with_(D.CHUNKS, DEDUP, body="SELECT chunk_id, len(s.sources) - 1 AS n_also, list_filter(s.sources, lambda x: x <> source_id)[1:10] AS also_in FROM dd JOIN (SELECT workspace_id, canonical_id, list_sort(list(DISTINCT source_id)) AS sources FROM dd GROUP BY ALL) s USING (workspace_id, canonical_id)"))
def agg_also_in(spark: SparkSession, sf: str) -> DataFrame:
    return ingest.also_in(deduped(spark, sf)).select("chunk_id", "n_also", "also_in")


@query(with_(D.CHUNKS, body="SELECT workspace_id, text_hash, arg_min(chunk_id, (created_at, chunk_id)) AS chunk_id FROM chunks WHERE is_active GROUP BY ALL"))
def find_by_text_hash(spark: SparkSession, sf: str) -> DataFrame:
    first = ingest.first_written(D.chunks(spark, sf).where("is_active"), ["workspace_id", "text_hash"], [F.col("created_at"), F.col("chunk_id")])
    return first.select("workspace_id", "text_hash", "chunk_id")


@query("SELECT o_custkey AS id, arg_max(o_orderstatus, (o_orderdate, o_orderkey)) AS status, max(o_orderdate) AS updated_at FROM orders GROUP BY o_custkey")
def upsert_view(spark: SparkSession, sf: str) -> DataFrame:
    latest = ingest.current(D.table(spark, sf, "orders"), ["o_custkey"], [F.col("o_orderdate"), F.col("o_orderkey")])
    return latest.select(F.col("o_custkey").alias("id"), F.col("o_orderstatus").alias("status"), F.col("o_orderdate").alias("updated_at"))


@query("SELECT o_custkey, arg_min(o_orderpriority, o_orderkey) AS o_orderpriority, arg_max(o_orderstatus, o_orderkey) AS o_orderstatus, arg_max(o_totalprice, o_orderkey) AS o_totalprice FROM orders GROUP BY o_custkey")
def upsert_chunk(spark: SparkSession, sf: str) -> DataFrame:
    return ingest.merged(D.table(spark, sf, "orders"), ["o_custkey"], "o_orderkey", ["o_orderpriority"], ["o_orderstatus", "o_totalprice"])


@query("SELECT user_id, event_type, min(event_id) AS event_id FROM events GROUP BY ALL")
def add_source_ref(spark: SparkSession, sf: str) -> DataFrame:
    return ingest.first_written(events(spark, sf), ["user_id", "event_type"], [F.col("event_id")]).select("user_id", "event_type", "event_id")


@query("SELECT conv_id, turn, CASE WHEN turn % 2 = 1 THEN NULL WHEN length(text) < 80 THEN 'too_short' WHEN turn % 4 = 2 THEN 'code_density' END AS reason FROM conversations")
def chunk_quality_filter(spark: SparkSession, sf: str) -> DataFrame:
    c = D.table(spark, sf, "conversations")
    text = F.when((F.col("turn") % 4 == 2) & (F.length("text") >= 80), F.concat(F.lit("```py\n"), F.regexp_replace("text", "`", " "), F.lit("\n```"))).otherwise(F.col("text"))
    kind = F.when(F.col("turn") % 2 == 1, "note").otherwise("conversation_summary")
    return c.select("conv_id", "turn", T.skip_reason(text, kind).alias("reason"))


@query("SELECT page_id, regexp_replace(lower(regexp_extract(url, '^[a-zA-Z]+://[^/?#:]*')) || lower(regexp_extract(url, '^[a-zA-Z]+://[^/?#]*([^?#]*)', 1)), '/+$', '') AS url FROM pages WHERE regexp_matches(url, '^[a-zA-Z]+://')")
def canonicalize_url(spark: SparkSession, sf: str) -> DataFrame:
    return D.table(spark, sf, "pages").where(F.col("url").rlike("^[a-zA-Z]+://")).select("page_id", T.canonical_url(F.col("url")).alias("url"))


@query(with_(D.CHUNKS, body="SELECT doc_id, chunk_id, 'sha256:' || text_hash AS text_hash, 'memory:' || workspace_id || ':' || labels[1] || ':' || replace(source_id, ':', '-') || ':' || substr(text_hash, 1, 8) AS memory_key FROM chunks"))
def make_ids(spark: SparkSession, sf: str) -> DataFrame:
    made = D.chunks(spark, sf)
    return made.select("doc_id", T.chunk_id(F.col("source_id"), F.lit("file"), F.lit(0)).alias("chunk_id"), T.text_hash(F.col("text")).alias("text_hash"), T.memory_key(F.col("workspace_id"), F.col("labels")[0], T.fingerprint(F.col("source_id")), F.substring("text_hash", 1, 8)).alias("memory_key"))


@query("SELECT doc_id, i - 1 AS ordinal, 'sha256:' || sha256('# ' || h || chr(10) || h) AS text_hash FROM (SELECT doc_id, unnest(range(1, 4)) AS i, lang || ' ' || source AS h FROM documents)")
def chunk_markdown(spark: SparkSession, sf: str) -> DataFrame:
    d = D.table(spark, sf, "documents")
    head = F.concat(F.col("lang"), F.lit(" "), F.col("source"))
    part = F.concat(F.lit("# "), head, F.lit("\n"), head, F.lit("\n\n"))
    made = ingest.structural_chunks(d.select(F.col("doc_id").cast("string").alias("source_id"), F.lit("a.md").alias("filename"), F.concat(F.lit("before\n"), part, part, part).alias("text")))
    return made.select(F.col("source_id").cast("long").alias("doc_id"), F.col("ordinal").cast("long").alias("ordinal"), "text_hash")


@query(None)
def chunk_code(spark: SparkSession, sf: str) -> DataFrame:
    """Python, JavaScript, JSON and paper chunks of texts built around the documents."""
    d = D.table(spark, sf, "documents").select("doc_id", F.concat(F.lit("name_"), F.col("doc_id").cast("string")).alias("n"))
    kind = F.col("doc_id") % 3
    py = F.concat(F.lit("import x\n\n@x\ndef "), F.col("n"), F.lit("():\n    return 1\n\nclass C:\n    pass\n"))
    js = F.concat(F.lit("function "), F.col("n"), F.lit("() { if (a) { b } }\nconst q = (x) => { y }\nclass D { }\n"))
    blob = F.concat(F.lit('{"'), F.col("n"), F.lit('": 1, "b": [1, 2]}'))
    src = d.select(F.col("n").alias("source_id"), F.when(kind == 0, "a.py").when(kind == 1, "a.js").otherwise("a.json").alias("filename"), F.when(kind == 0, py).when(kind == 1, js).otherwise(blob).alias("text"))
    return ingest.structural_chunks(src)


@query(None)
def ingest_batch(spark: SparkSession, sf: str) -> DataFrame:
    c = D.chunks(spark, sf)
    incoming = c.where("doc_id % 2 = 0").select("source_id", F.lit("a.txt").alias("filename"), "text", F.col("text_hash").alias("content_hash"), "source_type", "workspace_id")
    existing = c.where("doc_id % 2 = 1 AND is_active").select("chunk_id", "source_id", "workspace_id", F.concat(F.lit("sha256:"), F.col("text_hash")).alias("text_hash"), F.lit(0).alias("ordinal"))
    stored = c.where("doc_id % 3 = 0").select("source_id", F.col("text_hash").alias("content_hash"))
    return ingest.ingest(incoming, stored, existing)


@query(None)
def assign_or_create(spark: SparkSession, sf: str) -> DataFrame:
    v = D.vectors(spark, sf)
    project = F.concat(F.lit("p"), (F.col("vec_id") % 3).cast("string"))
    cats = D.categories(spark, sf).withColumn("project_id", F.explode(F.array(*map(F.lit, ("p0", "p1", "p2")))))
    rows = v.select(project.alias("project_id"), F.col("vec_id").alias("row"), F.concat(F.lit("new"), F.col("vec_id").cast("string")).alias("label"), F.col("v").alias("embedding"))
    return ingest.assign_or_create(rows, cats)


@query("SELECT chunk_id, list(name ORDER BY c DESC, name)[1:5] AS labels FROM (SELECT user_id AS chunk_id, event_type AS name, max(value) AS c FROM events GROUP BY ALL) GROUP BY chunk_id")
def agg_labels_view(spark: SparkSession, sf: str) -> DataFrame:
    links = events(spark, sf).groupBy(F.col("user_id").alias("chunk_id"), F.col("event_type").alias("name")).agg(F.max("value").alias("confidence"))
    return ingest.labels_view(links)


@query("SELECT doc_id, CASE WHEN lang = 'de' AND source = 'src1' THEN ['german'] WHEN lang = 'de' THEN ['german', source] ELSE [lang, CASE WHEN source = 'src1' THEN 'german' ELSE source END] END AS labels FROM documents")
def remap_labels(spark: SparkSession, sf: str) -> DataFrame:
    mapping = F.create_map(F.lit("de"), F.lit("german"), F.lit("src1"), F.lit("german"))
    labels = F.array(F.concat(F.lit("[neu]"), F.upper("lang")), F.col("source"))
    return D.table(spark, sf, "documents").select("doc_id", ingest.remapped(labels, mapping).alias("labels"))


# -- feedback, sequences

RATED = "rated AS (SELECT user_id AS chunk_id, CASE WHEN event_id % 7 = 0 THEN 'bad' ELSE CAST(event_id % 6 AS VARCHAR) END AS signal FROM events)"


@query(with_(RATED, body="SELECT chunk_id, round((avg(CAST(signal AS INT)) - 1) / 4, 6) AS feedback FROM rated WHERE signal IN ('1', '2', '3', '4', '5') GROUP BY chunk_id"))
def agg_feedback(spark: SparkSession, sf: str) -> DataFrame:
    rated = events(spark, sf).select(F.col("user_id").alias("chunk_id"), F.when(F.col("event_id") % 7 == 0, "bad").otherwise((F.col("event_id") % 6).cast("string")).alias("signal"))
    return work.feedback(rated).select("chunk_id", F.round("feedback", 6).alias("feedback"))


TRANS = "tr AS (SELECT event_type AS from_topic, lead(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS to_topic FROM events), cnt AS (SELECT from_topic, to_topic, count(*) AS count FROM tr WHERE from_topic <> to_topic GROUP BY ALL)"


def counts(spark: SparkSession, sf: str) -> DataFrame:
    return work.transitions(events(spark, sf), "user_id", ["ts", "event_id"], "event_type")


@query(with_(TRANS, body="SELECT * FROM cnt"))
def agg_transitions(spark: SparkSession, sf: str) -> DataFrame:
    return counts(spark, sf)


@query(with_(TRANS, body="SELECT *, round(count / sum(count) OVER (PARTITION BY from_topic), 6) AS probability FROM cnt"))
def agg_transition_prob(spark: SparkSession, sf: str) -> DataFrame:
    return work.probabilities(counts(spark, sf))


@query(with_(TRANS, body="SELECT from_topic, to_topic, probability, CAST(rank AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY from_topic ORDER BY probability DESC, to_topic) AS rank FROM (SELECT *, round(count / sum(count) OVER (PARTITION BY from_topic), 6) AS probability FROM cnt)) WHERE rank <= 3"))
def topk_next_topic(spark: SparkSession, sf: str) -> DataFrame:
    return work.next_topics(counts(spark, sf)).drop("count")


@query("SELECT trigger_id, max(f) AS fires, CAST(max(r) AS BIGINT) AS refs, bool_and(NOT (f >= 50 AND r / f < 0.10)) AS active FROM (SELECT user_id % 50 AS trigger_id, count(*) OVER w AS f, sum((value < 12)::INT) OVER w AS r FROM events WINDOW w AS (PARTITION BY user_id % 50 ORDER BY event_id)) GROUP BY trigger_id")
def agg_trigger_stats(spark: SparkSession, sf: str) -> DataFrame:
    return work.trigger_stats(events(spark, sf).select((F.col("user_id") % 50).alias("trigger_id"), F.col("event_id").alias("seq"), (F.col("value") < 12).alias("was_referenced")))


@query("SELECT user_id AS device_id, sum(CASE WHEN value >= 20 THEN 1.0::DOUBLE ELSE -2.0::DOUBLE END) AS trust_score, count(*) FILTER (WHERE value >= 20) AS verified, count(*) FILTER (WHERE NOT value >= 20) AS divergences FROM events GROUP BY user_id")
def agg_device_trust(spark: SparkSession, sf: str) -> DataFrame:
    return work.trust(events(spark, sf).select(F.col("user_id").alias("device_id"), F.when(F.col("value") >= 20, "verified").otherwise("diverged").alias("verdict")))


@query("SELECT task, chunk, least(5.0, sum(score)) AS relevance FROM (SELECT user_id % 10 AS task, user_id AS chunk, (event_id % 6 - 3) * 0.5::DOUBLE AS score FROM events WHERE event_id % 6 >= 4) GROUP BY ALL")
def rq_link(spark: SparkSession, sf: str) -> DataFrame:
    rows = events(spark, sf).where("event_id % 6 >= 4").select((F.col("user_id") % 10).alias("task"), F.col("user_id").alias("chunk"), ((F.col("event_id") % 6 - 3) * 0.5).alias("score"))
    return rows.groupBy("task", "chunk").agg(F.least(F.lit(5.0), F.sum("score")).alias("relevance"))


@query(with_(D.CHUNKS, "l AS (SELECT workspace_id, unnest(list_transform(labels, lambda x: lower(x))) AS label FROM chunks WHERE is_active)", "n AS (SELECT workspace_id, label, count(*) AS n FROM l WHERE label <> 'en' AND regexp_full_match(label, '[a-z0-9_-]{2,30}') GROUP BY ALL)", body="SELECT workspace_id, label, n FROM n QUALIFY row_number() OVER (PARTITION BY workspace_id ORDER BY n DESC, label) <= 6"))
def agg_label_freq(spark: SparkSession, sf: str) -> DataFrame:
    labels = D.chunks(spark, sf).where("is_active").select("workspace_id", F.explode(F.transform("labels", lambda x: F.lower(x))).alias("label"))
    return work.label_frequency(labels, T.plausible_label(F.col("label")), ["en"], 6)


@query(with_(D.CHUNKS, body="SELECT count(*) AS chunks, count(DISTINCT source_id) AS sources FROM chunks WHERE is_active"))
def agg_counts(spark: SparkSession, sf: str) -> DataFrame:
    return D.chunks(spark, sf).where("is_active").agg(F.count("*").alias("chunks"), F.countDistinct("source_id").alias("sources"))


# -- work tables


@query("SELECT event_id, user_id, ts FROM events WHERE user_id % 4 = 1 AND ts > TIMESTAMP '2024-01-02' ORDER BY ts DESC, event_id DESC LIMIT 200")
def list_hook_events(spark: SparkSession, sf: str) -> DataFrame:
    return events(spark, sf).where((F.col("user_id") % 4 == 1) & (F.col("ts") > F.lit("2024-01-02").cast("timestamp"))).orderBy(F.desc("ts"), F.desc("event_id")).limit(200).select("event_id", "user_id", "ts")


NOTED = "noted AS (SELECT event_id, CASE event_id % 5 WHEN 0 THEN 'repo_security' WHEN 1 THEN 'REPO_CI' WHEN 2 THEN 'repo_issue' WHEN 3 THEN 'repo_pull' ELSE 'other' END AS kind, CASE event_id % 4 WHEN 0 THEN 'success' WHEN 1 THEN 'failure' WHEN 2 THEN 'skipped' END AS conclusion, CASE event_id % 3 WHEN 0 THEN 'low' WHEN 1 THEN 'high' END AS severity FROM events)"


@query(with_(NOTED, body="SELECT event_id, CASE WHEN kind = 'repo_security' THEN CASE WHEN severity = 'low' THEN 'yellow' ELSE 'red' END WHEN kind = 'REPO_CI' THEN CASE WHEN conclusion = 'failure' THEN 'red' WHEN conclusion = 'success' THEN 'green' WHEN conclusion = 'skipped' THEN 'grey' ELSE 'yellow' END WHEN kind = 'repo_issue' THEN 'yellow' ELSE 'grey' END AS urgency FROM noted"))
def notifications(spark: SparkSession, sf: str) -> DataFrame:
    i = F.col("event_id")
    kind = F.when(i % 5 == 0, "repo_security").when(i % 5 == 1, "REPO_CI").when(i % 5 == 2, "repo_issue").when(i % 5 == 3, "repo_pull").otherwise("other")
    end = F.when(i % 4 == 0, "success").when(i % 4 == 1, "failure").when(i % 4 == 2, "skipped")
    return events(spark, sf).select("event_id", T.urgency(kind, end, F.when(i % 3 == 0, "low").when(i % 3 == 1, "high")).alias("urgency"))


@query("SELECT o_orderkey, CASE o_orderstatus WHEN 'O' THEN 0 WHEN 'P' THEN 1 ELSE 2 END AS s, o_orderdate FROM orders WHERE o_orderpriority IN ('1-URGENT', '2-HIGH') ORDER BY s, o_orderpriority, o_orderdate DESC, o_orderkey LIMIT 50")
def task_order(spark: SparkSession, sf: str) -> DataFrame:
    s = F.when(F.col("o_orderstatus") == "O", 0).when(F.col("o_orderstatus") == "P", 1).otherwise(2).alias("s")
    rows = D.table(spark, sf, "orders").where(F.col("o_orderpriority").isin("1-URGENT", "2-HIGH"))
    return rows.orderBy(s, "o_orderpriority", F.desc("o_orderdate"), "o_orderkey").limit(50).select("o_orderkey", s, "o_orderdate")


DEVICES = f"devices AS (SELECT user_id, max(ts) AS last_seen, CASE WHEN user_id % 3 = 0 THEN ['read'] ELSE ['embed', 'write'] END AS capabilities, CASE WHEN user_id % 5 = 0 THEN TIMESTAMP '2099-01-01' WHEN user_id % 5 = 1 THEN TIMESTAMP '2000-01-01' END AS quarantined_until, count(*) AS verified FROM events GROUP BY user_id), latest AS (SELECT max(ts) AS t FROM events)"


def devices(spark: SparkSession, sf: str) -> DataFrame:
    i = F.col("user_id")
    caps = F.when(i % 3 == 0, F.array(F.lit("read"))).otherwise(F.array(F.lit("embed"), F.lit("write")))
    until = F.when(i % 5 == 0, F.lit("2099-01-01")).when(i % 5 == 1, F.lit("2000-01-01")).cast("timestamp")
    return events(spark, sf).groupBy("user_id").agg(F.max("ts").alias("last_seen"), F.count("*").alias("verified")).withColumns({"capabilities": caps, "quarantined_until": until})


@query(with_(DEVICES, body="SELECT user_id, last_seen FROM devices, latest WHERE list_contains(capabilities, 'embed') AND (quarantined_until IS NULL OR quarantined_until <= t) AND epoch(t) - epoch(last_seen) <= 86400"))
def eligible_devices(spark: SparkSession, sf: str) -> DataFrame:
    at = events(spark, sf).agg(F.max("ts").alias("t"))
    return work.eligible(devices(spark, sf).crossJoin(F.broadcast(at)), F.col("t"), 86400).select("user_id", "last_seen")


@query(with_(DEVICES, body="SELECT user_id, CASE WHEN user_id % 5 = 0 OR verified < 5 THEN true ELSE verified % 4 = 0 END AS audit FROM devices"))
def should_audit(spark: SparkSession, sf: str) -> DataFrame:
    return devices(spark, sf).select("user_id", work.should_audit(F.col("verified"), F.col("user_id") % 5 == 0, 5, 4).alias("audit"))


@query(with_(DEVICES, body="SELECT user_id, CASE WHEN user_id % 2 = 0 THEN capabilities ELSE list_filter(capabilities, lambda x: x <> 'write') END AS capabilities FROM devices"))
def effective_caps(spark: SparkSession, sf: str) -> DataFrame:
    registered = F.when(F.col("user_id") % 2 == 0, F.col("capabilities"))
    return devices(spark, sf).select("user_id", work.effective_capabilities(registered, F.col("capabilities")).alias("capabilities"))


CAN = """roles AS (SELECT c_custkey, ['owner', 'viewer', 'editor', 'admin', 'user', 'x'][c_custkey % 6 + 1] AS role, ['search', 'write', 'share_org', 'share_public', 'manage_members', 'manage_foreign'][c_custkey // 6 % 6 + 1] AS permission,
  c_custkey % 13 = 0 AS super, c_custkey % 7 = 0 AS public, CASE c_custkey % 11 WHEN 0 THEN true WHEN 1 THEN false END AS override FROM customer),
n AS (SELECT *, CASE role WHEN 'owner' THEN 'admin' WHEN 'editor' THEN 'editor' WHEN 'admin' THEN 'admin' ELSE 'user' END AS r FROM roles)"""


@query(with_(CAN, body="SELECT c_custkey, r AS role, CASE WHEN public AND permission = 'manage_members' THEN super WHEN super OR (r = 'admin' AND permission = 'manage_members') THEN true WHEN override IS NOT NULL THEN override WHEN r = 'admin' THEN true WHEN r = 'editor' THEN permission NOT LIKE 'manage%' ELSE permission IN ('search', 'write') END AS allowed FROM n"))
def can(spark: SparkSession, sf: str) -> DataFrame:
    i = F.col("c_custkey")
    pick = lambda n, *xs: F.element_at(F.array(*map(F.lit, xs)), (n % len(xs) + 1).cast("int"))
    role, permission = pick(i, "owner", "viewer", "editor", "admin", "user", "x"), pick(F.floor(i / 6), "search", "write", "share_org", "share_public", "manage_members", "manage_foreign")
    override = F.when(i % 11 == 0, True).when(i % 11 == 1, False)
    return D.table(spark, sf, "customer").select("c_custkey", work.normal_role(role).alias("role"), work.can(role, permission, i % 13 == 0, i % 7 == 0, override).alias("allowed"))


@query("WITH f AS (SELECT user_id % 100 AS job, user_id AS device, min(event_id) AS seq FROM events GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY job ORDER BY seq, device) AS slot FROM f) SELECT job, max(device) FILTER (WHERE slot = 1) AS device_a, max(device) FILTER (WHERE slot = 2) AS device_b, CASE WHEN max(slot) > 1 THEN 'claimed_two' ELSE 'claimed_one' END AS status FROM r GROUP BY job")
def job_claim(spark: SparkSession, sf: str) -> DataFrame:
    return work.job_states(events(spark, sf).select((F.col("user_id") % 100).alias("job"), F.col("user_id").alias("device"), F.col("event_id").alias("seq")))


@query(with_(D.CHUNKS, f"r AS (SELECT doc_id, text, doc_id % 5 AS refs, greatest(0, (epoch_us(TIMESTAMP '{D.NOW}') - epoch_us(created_at)) / 86400000000.0::DOUBLE) AS age FROM chunks)", body="SELECT doc_id, round((CASE WHEN doc_id % 4 = 0 THEN greatest(0.9, (0.9 + CASE WHEN age < 1 THEN 0.3 ELSE 0.0 END) * exp(-age / 14)) ELSE (0.5 + CASE WHEN age < 1 THEN 0.3 ELSE 0.0 END) * exp(-age / 14) END) + 0.2 * least(refs, 3), 4) AS score FROM r"))
def snapshot_score(spark: SparkSession, sf: str) -> DataFrame:
    text = F.when(F.col("doc_id") % 4 == 0, F.lit("[Sticky] x")).otherwise("x")
    return D.chunks(spark, sf).select("doc_id", rank.snapshot_score(text, F.col("created_at"), now(), F.col("doc_id") % 5).alias("score"))


@query(with_(D.CHUNKS, body="SELECT repo, chunk_id, created_at FROM chunks WHERE is_active QUALIFY row_number() OVER (PARTITION BY repo ORDER BY created_at DESC, chunk_id) <= 5"))
def recent_n(spark: SparkSession, sf: str) -> DataFrame:
    rows = D.chunks(spark, sf).where("is_active")
    newest = F.row_number().over(W.partitionBy("repo").orderBy(F.desc("created_at"), "chunk_id"))
    return rows.withColumn("n", newest).where("n <= 5").select("repo", "chunk_id", "created_at")


HITS = """w AS (SELECT DISTINCT message_id, trim(x, '.,!?;:()[]{}"''') AS keyword FROM (SELECT doc_id AS message_id, unnest(string_split_regex(lower(text), '\\s+')) AS x FROM documents) WHERE length(x) > 2),
k AS (SELECT * FROM (VALUES ('the', 'A'), ('and', 'B'), ('die', 'C'), ('les', 'D'), ('der', 'A'), ('los', 'E'), ('für', 'F')) AS t(keyword, cluster)),
hits AS (SELECT message_id, cluster, min(keyword) AS keyword FROM w JOIN k USING (keyword) WHERE keyword <> 'los' GROUP BY ALL)"""


def scanned(spark: SparkSession, sf: str) -> DataFrame:
    index = spark.createDataFrame([("the", "A"), ("and", "B"), ("die", "C"), ("les", "D"), ("der", "A"), ("los", "E"), ("für", "F")], "keyword string, cluster string")
    off = spark.createDataFrame([("keyword:los",)], "trigger_id string")
    return work.trigger_scan(D.table(spark, sf, "documents").select(F.col("doc_id").alias("message_id"), "text"), index, off)


@query(with_(HITS, body="SELECT message_id, keyword, cluster FROM hits QUALIFY row_number() OVER (PARTITION BY message_id ORDER BY keyword, cluster) <= 3"))
def trigger_scan(spark: SparkSession, sf: str) -> DataFrame:
    return scanned(spark, sf)


@query(with_(HITS, D.VECTORS, D.CATEGORIES, "s AS (SELECT vec_id AS message_id, category_id AS cluster, round(coalesce(list_cosine_similarity(v, centre), 0), 6) AS similarity FROM vectors, categories WHERE vec_id NOT IN (SELECT message_id FROM hits WHERE cluster = 'C'))", body="SELECT * FROM (SELECT * FROM s WHERE similarity >= 0.5 QUALIFY row_number() OVER (PARTITION BY message_id ORDER BY similarity DESC, cluster) <= 3) WHERE cluster <> 4"))
def trigger_similar(spark: SparkSession, sf: str) -> DataFrame:
    """Messages are the documents with an embedding; those with a keyword's hit aren't compared."""
    messages = D.vectors(spark, sf).select(F.col("vec_id").alias("message_id"), F.col("v").alias("q"))
    clusters = D.categories(spark, sf).select(F.col("category_id").alias("cluster"), F.col("centre").alias("v"))
    off = spark.createDataFrame([("cluster:4",)], "trigger_id string")
    return work.trigger_similar(messages, scanned(spark, sf).where("cluster = 'C'").select("message_id").distinct(), clusters, off, least=0.5)


@query("SELECT c_custkey, (length(c_name) BETWEEN 2 AND 30) AND regexp_full_match(lower(replace(c_name, '#', '_')), '[a-zäöüß0-9_-]+') AND (length(c_name) < 5 OR (SELECT max(n) FROM (SELECT count(*) AS n FROM (SELECT unnest(string_split(lower(replace(c_name, '#', '_')), '')) AS ch) GROUP BY ch)) <= length(c_name) * 0.6) AS plausible FROM customer")
def label_plausible(spark: SparkSession, sf: str) -> DataFrame:
    return D.table(spark, sf, "customer").select("c_custkey", T.plausible_label(F.replace("c_name", F.lit("#"), F.lit("_"))).alias("plausible"))


PATHS = "paths AS (SELECT p_partkey, ['/src/tests/a.py', '/api/x.py', '/models/m.py', '/auth/a.php', '/service/s.py', '/middleware/m', 'config.yaml', '/utils/u.py', '/cache/c', '/log/l', 'readme'][p_partkey % 11 + 1] AS path FROM part)"


@query(with_(PATHS, body="SELECT p_partkey, path, ['tests', 'api', 'data_access', 'auth', 'domain', 'middleware', 'config', 'utils', 'caching', 'logging', NULL][p_partkey % 11 + 1] AS category, p_partkey % 11 = 0 AS is_test FROM paths"))
def path_category(spark: SparkSession, sf: str) -> DataFrame:
    names = ("/src/tests/a.py", "/api/x.py", "/models/m.py", "/auth/a.php", "/service/s.py", "/middleware/m", "config.yaml", "/utils/u.py", "/cache/c", "/log/l", "readme")
    p = D.table(spark, sf, "part").select("p_partkey", F.element_at(F.array(*map(F.lit, names)), (F.col("p_partkey") % 11 + 1).cast("int")).alias("path"))
    return p.select("p_partkey", "path", T.path_category(F.col("path")).alias("category"), T.test_path(F.col("path")).alias("is_test"))
