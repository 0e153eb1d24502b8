"""Ranking: the weighted and the learnt score, boosts, admission of session chunks, and reasons."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

WEIGHTS = {"vector": 0.30, "symbolic": 0.20, "recency": 0.10, "affinity": 0.10, "feedback": 0.15, "advisor": 0.15, "predicted": 0.05, "hint": 0.08, "category": 0.08, "project": 0.08}


def recency(created: Column, now: Column) -> Column:
    """1 now, 0 at 30 days; more than 1 in the future, 0 if unknown."""
    days = (F.unix_micros(now) - F.unix_micros(created)) / 86_400_000_000
    return F.coalesce(F.greatest(F.lit(0.0), 1 - days / 30), F.lit(0.0))


def convergence() -> Column:
    """0.12 for three strong signals, 0.06 for two."""
    strong = (F.col("vector") > 0.5, F.col("symbolic") > 0.3, F.col("recency") > 0.8, F.col("affinity") > 0, F.col("advisor") > 0.7)
    n = sum((F.coalesce(x, F.lit(False)).cast("int") for x in strong[1:]), F.coalesce(strong[0], F.lit(False)).cast("int"))
    return F.when(n >= 3, 0.12).when(n == 2, 0.06).otherwise(0.0)


def score_v1(compacted: Column | None = None) -> Column:
    """The weighted sum of the stage columns; absent feedback and advisor count 0.5, other absent stages 0."""
    part = {k: F.coalesce(F.col(k), F.lit(0.5 if k in ("feedback", "advisor") else 0.0)) for k in WEIGHTS}
    part["feedback"] = 2 * part["feedback"] - 1
    total = convergence()
    for k, w in WEIGHTS.items():
        total = total + w * part[k]
    total = total - F.when(F.coalesce(F.col("feedback"), F.lit(0.5)) < 0.3, 0.10).otherwise(0.0)
    return total if compacted is None else F.when(compacted, F.least(F.lit(1.0), total + 0.10)).otherwise(total)


def sigmoid(z: Column) -> Column:
    return F.when(z > 30, 1.0).when(z < -30, 0.0).otherwise(1 / (1 + F.exp(-z)))


def score_v2(intercept: float, weights: dict[str, float]) -> Column:
    """A logistic model over stage columns, then the category and project boosts, each up to 1."""
    z = F.lit(float(intercept))
    for k, w in sorted(weights.items()):
        z = z + float(w) * F.coalesce(F.col(k), F.lit(0.0))
    out = sigmoid(z)
    for k in ("category", "project"):
        out = F.least(F.lit(1.0), out + 0.08 * F.coalesce(F.col(k), F.lit(0.0)))
    return out


def with_task_boost(score: Column, relevance: Column) -> Column:
    return F.when(relevance.isNotNull(), F.least(F.lit(1.0), score + 0.04 * F.least(relevance, F.lit(5.0)))).otherwise(score)


def reasons(is_session: Column | None = None) -> Column:
    """Why a row ranks where it does, in a fixed order; rows of the session's thread say so last."""
    named = (("embedding_similarity", F.col("vector") > 0.5), ("token_overlap", F.col("symbolic") > 0.3), ("recent_chunk", F.col("recency") > 0.8), ("source_affinity_match", F.col("affinity") > 0), ("llm_advisor_high", F.col("advisor") > 0.7), ("session-recency", F.lit(False) if is_session is None else is_session))
    return F.array_compact(F.array(*(F.when(c, n) for n, c in named)))


def picked_version(query: Column) -> Column:
    """v2 for queries whose SHA-256 begins with an even number of 32 bits, else v1."""
    return F.when(F.conv(F.substring(F.sha2(query.cast("binary"), 256), 1, 8), 16, 10).cast("long") % 2 == 0, "v2").otherwise("v1")


def picked_of_pair(query: Column, first: str, second: str) -> Column:
    return F.when(F.conv(F.substring(F.sha1(query.cast("binary")), -1, 1), 16, 10).cast("int") % 2 == 0, first).otherwise(second)


def admitted(ranked: DataFrame, k: int, partition: str = "query_id", key: str = "chunk_id") -> DataFrame:
    """The k best of each query, session rows (raised to 0.5) before others if room is short; `place` is by score."""
    lifted = ranked.withColumn("score", F.when(F.col("is_session"), F.greatest("score", F.lit(0.5))).otherwise(F.col("score")))
    first = F.row_number().over(W.partitionBy(partition).orderBy(F.desc("is_session"), F.desc("score"), key))
    place = F.row_number().over(W.partitionBy(partition).orderBy(F.desc("score"), key))
    return lifted.withColumn("memlake_first", first).where(F.col("memlake_first") <= k).drop("memlake_first").withColumn("place", place)


def snapshot_score(text: Column, captured: Column, now: Column, references: Column) -> Column:
    """0.5 (0.9 if sticky), +0.3 in the first day, halved in feeling every fortnight, +0.2 for up to three references."""
    sticky = F.lower(text).contains("[sticky]")
    days = F.coalesce(F.greatest(F.lit(0.0), (F.unix_micros(now) - F.unix_micros(captured)) / 86_400_000_000), F.lit(365.0))
    faded = (F.when(sticky, 0.9).otherwise(0.5) + F.when(days < 1, 0.3).otherwise(0.0)) * F.exp(-days / 14)
    return F.round(F.when(sticky, F.greatest(faded, F.lit(0.9))).otherwise(faded) + 0.2 * F.least(F.coalesce(references, F.lit(0)), F.lit(3)), 4)


def compressed(entries: Column, budget: int) -> Column:
    """A prompt from array<struct<source_id, text, summary, labels>> in order of rank, one entry for each source.

    Each entry may take its share of what is left, 100 characters at least; the first that doesn't fit ends the prompt.
    """
    first = F.filter(entries, lambda e, i: F.array_position(entries["source_id"], e["source_id"]) == i + 1)
    begin = F.struct(F.lit("## Memory Context\n").alias("body"), F.lit(19).alias("used"), F.lit(False).alias("full"), F.lit(0).alias("n"))

    def step(state: Column, e: Column) -> Column:
        share = F.greatest(F.lit(100), F.floor((F.lit(budget) - state["used"]) / F.greatest(F.lit(1), F.size(first) - state["n"])).cast("int"))
        whole = F.when((F.length(e["text"]) > 500) & (F.length(F.coalesce(e["summary"], F.lit(""))) > 0), e["summary"]).otherwise(e["text"])
        body = F.when(F.length(whole) > share, F.concat(whole.substr(F.lit(1), share - 3), F.lit("..."))).otherwise(whole)
        labels = F.when(F.size(e["labels"]) > 0, F.array_join(e["labels"], ", ")).otherwise("?")
        entry = F.concat(F.lit("\n- ["), labels, F.lit("] "), e["source_id"], F.lit("\n  "), body)
        fits = ~state["full"] & (state["used"] + F.length(entry) <= budget)
        return F.struct(F.when(fits, F.concat(state["body"], entry)).otherwise(state["body"]).alias("body"), F.when(fits, state["used"] + F.length(entry)).otherwise(state["used"]).alias("used"), (~fits).alias("full"), (state["n"] + 1).alias("n"))

    done = F.aggregate(first, begin, step)
    return F.when(done["used"] > 19, done["body"]).otherwise("")
