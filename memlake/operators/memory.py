"""Reads and writes of the memory tables beyond ingestion: records, goals, tasks, jobs, workspaces, logs, context."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from memlake.operators.vector import nearest

# -- records


def by_source(chunks: DataFrame, source_ids: DataFrame, active_only: bool = True) -> DataFrame:
    """Chunks of some sources, each source's in order of `ordinal` (column `place`, from 1)."""
    rows = chunks.join(source_ids, "source_id", "left_semi")
    rows = rows.where("is_active") if active_only else rows
    return rows.withColumn("place", F.row_number().over(W.partitionBy("source_id").orderBy("ordinal", "chunk_id")))


def deactivated(chunks: DataFrame, source_ids: DataFrame) -> DataFrame:
    """Tombstones (chunk_id, source_id) of the active chunks of some sources."""
    return chunks.where("is_active").join(source_ids, "source_id", "left_semi").select("chunk_id", "source_id")


def superseded(chunks: DataFrame, pointers: DataFrame) -> DataFrame:
    """Chunks after soft deletes: `pointers` (chunk_id, superseded_by) make a chunk inactive and name its successor."""
    return chunks.join(pointers, "chunk_id", "left").withColumn("is_active", F.col("is_active") & F.col("superseded_by").isNull())


LIMITS = {"prompt": 500, "response": 800, "context": 2000, "query": 1000, "document": 500}


def truncated(df: DataFrame, **columns: str) -> DataFrame:
    """Log rows with columns cut to the limit of what they hold; null is empty."""
    return df.withColumns({c: F.substring(F.coalesce(F.col(c), F.lit("")), 1, LIMITS[kind]) for c, kind in columns.items()})


def feedback_links(ratings: DataFrame) -> DataFrame:
    """(task_id, chunk_id, relevance) that ratings of 4 and 5 with a task add: (rating - 3) / 2 each, 5 at most."""
    rating = F.expr("try_cast(signal AS INT)")
    good = ratings.where(F.col("signal").isin("4", "5") & F.col("task_id").isNotNull())
    return good.groupBy("task_id", "chunk_id").agg(F.least(F.lit(5.0), F.sum((rating - 3) * 0.5)).alias("relevance"))


def valid_rating(signal: Column) -> Column:
    return F.coalesce(signal.isin("1", "2", "3", "4", "5"), F.lit(False))


def issue_sources(issues: DataFrame) -> DataFrame:
    """(source_id, path, content, content_hash) of (repo, number, title, body)."""
    content = F.concat(F.lit("# "), F.col("title"), F.lit("\n\n"), F.coalesce("body", F.lit("")))
    return issues.select(F.concat(F.col("repo"), F.lit(":issue:"), F.col("number").cast("string")).alias("source_id"), F.concat(F.lit("issues/"), F.col("number").cast("string")).alias("path"), content.alias("content"), F.sha2(content.cast("binary"), 256).alias("content_hash"))


def connections(text: Column, n: int) -> Column:
    """The first n lines of a page that begin with "- →"."""
    return F.slice(F.filter(F.split(text, "\n", -1), lambda x: F.startswith(x, F.lit("- →"))), 1, n)


IMAGES = "png jpg jpeg gif webp bmp svg".split()


def is_image(path: Column) -> Column:
    return F.coalesce(F.lower(F.regexp_extract(path, r"\.([^./]+)$", 1)).isin(*IMAGES), F.lit(False))


CODEBOOKS = {k: "code" for k in ("repo_file", "note", "github_issue")} | {k: "social" for k in ("conversation", "conversation_summary", "session_knowledge", "session_note", "paper", "agent_result")}


def codebook(source_type: Column) -> Column:
    """The codebook of a source type; an unknown type's name says that it failed."""
    known = F.create_map(*(F.lit(x) for kv in CODEBOOKS.items() for x in kv))
    return F.coalesce(F.element_at(known, source_type), F.concat(F.lit("FAIL_"), F.coalesce(source_type, F.lit("none"))))


def embedded(text: Column) -> Column:
    """A deterministic embedding of a text's first 500 characters: counts of its words by the first hex digit of their
    MD5, as a unit vector of 16 components (null without words)."""
    words = F.regexp_extract_all(F.lower(F.substring(F.coalesce(text, F.lit("")), 1, LIMITS["document"])), F.lit("[a-z0-9]+"), F.lit(0))
    digits = F.array_join(F.transform(words, lambda w: F.substring(F.md5(w), 1, 1)), "")
    counts = [(F.length(digits) - F.length(F.replace(digits, F.lit(d), F.lit("")))).cast("double") for d in "0123456789abcdef"]
    norm = F.sqrt(sum((c * c for c in counts[1:]), counts[0] * counts[0]))
    return F.when(norm > 0, F.array(*(c / norm for c in counts)))


# -- goals, todos, tasks


def canonical_goals(new: DataFrame, known: DataFrame, least: float = 0.85) -> DataFrame:
    """(goal_id, canonical_id, how): a known goal of the same text, else the nearest known one in the workspace at
    `least` or more, else the first new one of the same text.  Blank texts are no goals.

    `new` and `known` have (goal_id, workspace_id, text, v); texts count trimmed and in lower case.
    """
    name = F.lower(F.trim("text"))
    rows, have = new.where(name != "").withColumn("name", name), known.where(name != "").withColumn("name", name)
    exact = have.groupBy("workspace_id", "name").agg(F.min("goal_id").alias("exact"))
    rows = rows.join(exact, ["workspace_id", "name"], "left")
    left = rows.where("exact IS NULL").select(F.col("goal_id"), "workspace_id", F.col("v").alias("q"))
    near = nearest_within(left, have.select("workspace_id", F.col("goal_id").alias("near"), "v"), "workspace_id", "goal_id", "near", least)
    first = rows.groupBy("workspace_id", "name").agg(F.min("goal_id").alias("first"))
    out = rows.join(near.select("goal_id", "near"), "goal_id", "left").join(first, ["workspace_id", "name"])
    how = F.when(F.col("exact").isNotNull(), "exact").when(F.col("near").isNotNull(), "near").otherwise("new")
    return out.select("goal_id", F.coalesce("exact", "near", "first").alias("canonical_id"), how.alias("how"))


def nearest_within(queries: DataFrame, items: DataFrame, by: str, query_key: str, item_key: str, least: float) -> DataFrame:
    """(query_key, item_key, similarity): each query's nearest item of the same `by`, at `least` or more."""
    from memlake.operators.vector import cosine

    both = queries.join(items, by).withColumn("similarity", F.round(cosine(F.col("q"), F.col("v")), 6)).where(F.col("similarity") >= least)
    best = both.groupBy(query_key).agg(F.max(F.struct("similarity", (-F.col(item_key)).alias("k"))).alias("m"))
    return best.select(query_key, (-F.col("m.k")).alias(item_key), F.col("m.similarity").alias("similarity"))


def fresh_todos(derived: DataFrame, open_todos: DataFrame, least: float = 0.85) -> DataFrame:
    """Derived todos (id, q) that no open one (todo_id, v) resembles."""
    seen = nearest(derived, open_todos, 1, "id", "todo_id", least=least)
    return derived.join(seen.select("id"), "id", "left_anti")


def task_states(changes: DataFrame) -> DataFrame:
    """Latest state of each task from its changes (task_id, seq, ts, status): completed_at is the last change's time if
    it says done, else cleared; created_at the first one's."""
    last = F.max(F.struct("seq", "status", "ts"))
    out = changes.groupBy("task_id").agg(last.alias("m"), F.min("ts").alias("created_at"))
    return out.select("task_id", F.col("m.status").alias("status"), "created_at", F.when(F.col("m.status") == "done", F.col("m.ts")).alias("completed_at"))


def listed_tasks(tasks: DataFrame, workspace_id: str, status: str | None = None, priority: str | None = None, tag: str | None = None) -> DataFrame:
    """Tasks of a workspace; a tag is one of the comma-separated `tags`, whole."""
    keep = F.col("workspace_id") == workspace_id
    for name, value in (("status", status), ("priority", priority)):
        if value is not None:
            keep &= F.col(name) == value
    if tag is not None:
        keep &= F.array_contains(F.transform(F.split("tags", ","), lambda x: F.trim(x)), tag)
    return tasks.where(keep)


# -- jobs, devices, roles, workspaces


def open_jobs(jobs: DataFrame, limit: int = 20) -> DataFrame:
    """The oldest open jobs that are not golden."""
    return jobs.where(F.col("status").isin("queued", "claimed_one") & ~F.col("is_golden")).orderBy("created_at", "embed_id").limit(limit)


def claimed(jobs: DataFrame, claims: DataFrame) -> DataFrame:
    """(embed_id, device_a, device_b, status) after claims (embed_id, device, seq): two different devices, first come
    first served; golden jobs take their own claim only."""
    first = claims.groupBy("embed_id", "device").agg(F.min("seq").alias("seq"))
    slots = first.groupBy("embed_id").agg(F.slice(F.array_sort(F.collect_list(F.struct("seq", "device"))), 1, 2).alias("s"))
    out = jobs.join(slots, "embed_id", "left")
    a, b = F.get("s", 0)["device"], F.when(~F.col("is_golden"), F.get("s", 1)["device"])
    return out.select("embed_id", a.alias("device_a"), b.alias("device_b"), F.when(a.isNull(), "queued").when(b.isNull(), "claimed_one").otherwise("claimed_two").alias("status"))


def diverged_audits(jobs: DataFrame, reaped: DataFrame, limit: int) -> DataFrame:
    """The oldest audits that diverged and weren't reaped."""
    return jobs.where(F.col("is_audit") & (F.col("status") == "diverged")).join(reaped, "embed_id", "left_anti").orderBy("created_at", "embed_id").limit(limit)


def quarantines(events: DataFrame) -> DataFrame:
    """(device_id, quarantined_until) by the last set or clear (an empty or null time clears)."""
    last = events.groupBy("device_id").agg(F.max_by("until", "seq").alias("until"))
    return last.select("device_id", F.expr("try_cast(nullif(trim(until), '') AS timestamp)").alias("quarantined_until"))


def resolved(ids: DataFrame, workspaces: DataFrame, aliases: DataFrame) -> DataFrame:
    """`canonical` of each id: the workspace itself, else the alias's workspace, else null."""
    own = workspaces.select(F.col("id").alias("given"), F.col("id").alias("own"))
    other = aliases.select(F.col("alias").alias("given"), F.col("workspace_id").alias("other"))
    return ids.join(own, "given", "left").join(other, "given", "left").select("given", F.coalesce("own", "other").alias("canonical"))


# -- context, ranking


def session_chunks(chunks: DataFrame, n: int) -> DataFrame:
    """The latest n active summaries of each session."""
    newest = F.row_number().over(W.partitionBy("session_id").orderBy(F.desc("created_at"), "chunk_id"))
    return chunks.where("is_active").withColumn("memlake_n", newest).where(F.col("memlake_n") <= n).drop("memlake_n")


def snapshot_references(entries: DataFrame, log: DataFrame) -> DataFrame:
    """(idx, refs): log rows (context) that were referenced and begin as an entry does, in 40 characters or its whole text.

    Both sides meet by equality: on 40 characters, or for shorter entries on each shorter length that occurs.
    """
    head = F.substring("text", 1, 40)
    entries = entries.select("idx", head.alias("head"), F.length(head).alias("width")).where("width > 0")
    widths = entries.select("width").distinct()  # at most 40
    heads = log.where("was_referenced").join(F.broadcast(widths), F.length("context") >= F.col("width")).groupBy("width", F.expr("substring(context, 1, width)").alias("head")).agg(F.count("*").alias("refs"))
    return entries.join(heads, ["width", "head"], "left").select("idx", F.coalesce("refs", F.lit(0)).alias("refs"))


def advised(rows: DataFrame, k: int, pool: int = 30, scored: int = 20) -> DataFrame:
    """Candidates that an advisor keeps: of each query the `pool` best by symbolic + vector, of which the first `scored`
    have its score, and of these the max(2k, 6) best; rows without a score stay behind scored ones."""
    pre = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc(F.col("symbolic") + F.col("vector")), "chunk_id"))
    few = rows.withColumn("pre", pre).where(F.col("pre") <= pool).withColumn("advisor", F.when(F.col("pre") <= scored, F.col("advisor")))
    place = F.row_number().over(W.partitionBy("query_id").orderBy(F.col("advisor").desc_nulls_last(), "pre"))
    return few.withColumn("place", place).where(F.col("place") <= max(2 * k, 6))


def selected_version(query: Column, override: Column, active: tuple[str, ...], usable: tuple[str, ...]) -> Column:
    """The override if it names a version, else the only active one, else one of two by the query's hash; v1 if that
    one's model isn't usable."""
    from memlake.operators.rank import picked_of_pair, picked_version

    pin = F.lower(F.trim(override))
    pinned = F.when((pin == "v1") | pin.rlike(r"^v[0-9]+$"), pin).otherwise(picked_version(query))
    free = F.lit(active[0]) if len(active) == 1 else picked_of_pair(query, *active[:2])
    raw = F.when(F.coalesce(pin, F.lit("")) != "", pinned).otherwise(free)
    return F.when(raw.isin("v1", *usable), raw).otherwise("v1")


def rationales(hits: DataFrame, edges: DataFrame) -> DataFrame:
    """Hits (…, source_id) with `rationale`: the sorted targets and texts of their source's rationale edges."""
    own = edges.where((F.col("type") == "rationale") & (F.coalesce("rationale", F.lit("")) != "")).groupBy(F.col("source").alias("source_id")).agg(F.sort_array(F.collect_set(F.concat(F.col("target"), F.lit(": "), F.col("rationale")))).alias("rationale"))
    return hits.join(own, "source_id", "left")


def ingest_report(rows: DataFrame) -> DataFrame:
    """Counts of an ingestion by workspace from rows (workspace_id, reason, is_canonical, n_labels)."""
    kept = F.col("reason").isNull()
    return rows.groupBy("workspace_id").agg(F.count_if(kept & F.col("is_canonical")).alias("new"), F.count_if(kept & ~F.col("is_canonical")).alias("deduped"), F.count_if(~kept).alias("filtered"), F.coalesce(F.sum(F.when(kept, F.col("n_labels"))), F.lit(0)).alias("links"))
