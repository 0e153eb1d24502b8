"""Sequences, feedback and the work tables: topics, triggers, ratings, tasks, devices, jobs, roles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from memlake.operators.vector import clamp, nearest


def topics(text: Column, index: Column) -> Column:
    """Distinct topics of a text's words in order; `index` maps words to arrays of topics."""
    words = F.regexp_extract_all(F.lower(text), F.lit(r"\b[a-z][a-z0-9_-]{2,}\b"), F.lit(0))
    return F.array_distinct(F.flatten(F.transform(words, lambda w: F.coalesce(F.element_at(index, w), F.array().cast("array<string>")))))


def transitions(sequences: DataFrame, by: str, order: list[str], topic: str) -> DataFrame:
    """(from_topic, to_topic, count) of neighbouring, different topics."""
    following = F.lead(topic).over(W.partitionBy(by).orderBy(*order))
    pairs = sequences.select(F.col(topic).alias("from_topic"), following.alias("to_topic")).where("from_topic <> to_topic")
    return pairs.groupBy("from_topic", "to_topic").agg(F.count("*").alias("count"))


def probabilities(counts: DataFrame) -> DataFrame:
    return counts.withColumn("probability", F.round(F.col("count") / F.sum("count").over(W.partitionBy("from_topic")), 6))


def next_topics(counts: DataFrame, k: int = 3) -> DataFrame:
    rank = F.row_number().over(W.partitionBy("from_topic").orderBy(F.desc("probability"), "to_topic"))
    return probabilities(counts).withColumn("rank", rank).where(F.col("rank") <= k)


def feedback(ratings: DataFrame) -> DataFrame:
    """(chunk_id, feedback): the mean of ratings 1 to 5 on a scale of 0 to 1; others are ignored."""
    rating = F.expr("try_cast(signal AS INT)")
    return ratings.where(rating.between(1, 5)).groupBy("chunk_id").agg(clamp((F.avg(rating) - 1) / 4).alias("feedback"))


def trigger_stats(events: DataFrame, least_ratio: float = 0.10, least_fires: int = 50) -> DataFrame:
    """(trigger_id, fires, refs, active): a trigger that was ever too seldom of use stays off."""
    upto = W.partitionBy("trigger_id").orderBy("seq").rowsBetween(W.unboundedPreceding, 0)
    running = events.withColumns({"f": F.count("*").over(upto), "r": F.sum(F.col("was_referenced").cast("int")).over(upto)})
    bad = (F.col("f") >= least_fires) & (F.col("r") / F.col("f") < least_ratio)
    return running.groupBy("trigger_id").agg(F.max("f").alias("fires"), F.max("r").alias("refs"), F.bool_and(~bad).alias("active"))


def trust(verdicts: DataFrame) -> DataFrame:
    good = F.col("verdict") == "verified"
    return verdicts.groupBy("device_id").agg(F.sum(F.when(good, 1.0).otherwise(-2.0)).alias("trust_score"), F.count_if(good).alias("verified"), F.count_if(~good).alias("divergences"))


def eligible(devices: DataFrame, now: Column, fresh_seconds: int) -> DataFrame:
    """Devices that can embed, aren't quarantined and were heard of lately."""
    age = F.unix_timestamp(now) - F.unix_timestamp("last_seen")
    calm = F.col("quarantined_until").isNull() | (F.col("quarantined_until") <= now)
    return devices.where(F.array_contains("capabilities", "embed") & calm & (age <= fresh_seconds))


def should_audit(verified: Column, quarantined: Column, warmup: int, rate: int) -> Column:
    return F.when(verified.isNull() | quarantined | (verified < warmup), True).otherwise((F.lit(rate) <= 1) | (verified % max(rate, 1) == 0))


def effective_capabilities(registered: Column, reported: Column) -> Column:
    return F.coalesce(registered, F.array_remove(reported, "write"))


#: Permissions of each role unless a workspace overrides them.
DEFAULTS = {"user": ("search", "write"), "editor": ("search", "write", "share_org", "share_public"), "admin": ("search", "write", "share_org", "share_public", "manage_members", "manage_foreign")}


def normal_role(role: Column) -> Column:
    return F.when(role == "owner", "admin").when(role.isin(*DEFAULTS), role).otherwise("user")


def can(role: Column, permission: Column, super_admin: Column, public_workspace: Column, override: Column) -> Column:
    """Public workspaces' members are the super-admin's; then super-admin, the admin lock, override, default."""
    r, members = normal_role(role), permission == "manage_members"
    default = F.lit(False)
    for name, allowed in DEFAULTS.items():
        default = default | ((r == name) & permission.isin(*allowed))
    return F.when(public_workspace & members, super_admin).when(super_admin | ((r == "admin") & members), True).otherwise(F.coalesce(override, default))


def job_states(events: DataFrame) -> DataFrame:
    """Two different devices' first claims of each job in order: (job, device_a, device_b, status)."""
    first = events.groupBy("job", "device").agg(F.min("seq").alias("seq"))
    rank = F.row_number().over(W.partitionBy("job").orderBy("seq", "device"))
    slots = first.withColumn("slot", rank).where("slot <= 2").groupBy("job").agg(F.max(F.when(F.col("slot") == 1, F.col("device"))).alias("device_a"), F.max(F.when(F.col("slot") == 2, F.col("device"))).alias("device_b"))
    return slots.withColumn("status", F.when(F.col("device_b").isNull(), "claimed_one").otherwise("claimed_two"))


def label_frequency(labels: DataFrame, plausible: Column, exclude: list[str], limit: int = 40) -> DataFrame:
    """(workspace_id, label, n): the most used plausible labels of each workspace."""
    counted = labels.where(plausible & ~F.col("label").isin(*exclude)).groupBy("workspace_id", "label").agg(F.count("*").alias("n"))
    rank = F.row_number().over(W.partitionBy("workspace_id").orderBy(F.desc("n"), "label"))
    return counted.withColumn("rank", rank).where(F.col("rank") <= limit).drop("rank")


#: What is stripped from both ends of a message's words.
MARKS = ".,!?;:()[]{}\"'"


def trigger_scan(messages: DataFrame, index: DataFrame, inactive: DataFrame, k: int = 3) -> DataFrame:
    """(message_id, keyword, cluster): up to k clusters whose active keyword a message has, in order of keyword.

    Words of three characters or more count, marks at their ends stripped afterwards.
    """
    long = F.filter(F.split(F.lower("text"), r"\s+"), lambda w: F.length(w) > 2)
    words = messages.select("message_id", F.explode(F.array_distinct(F.transform(long, lambda w: F.btrim(w, F.lit(MARKS))))).alias("keyword"))
    found = words.join(index, "keyword").join(inactive, F.concat(F.lit("keyword:"), F.col("keyword")) == F.col("trigger_id"), "left_anti")
    firsts = found.groupBy("message_id", "cluster").agg(F.min("keyword").alias("keyword"))
    rank = F.row_number().over(W.partitionBy("message_id").orderBy("keyword", "cluster"))
    return firsts.withColumn("rank", rank).where(F.col("rank") <= k).select("message_id", "keyword", "cluster")


def trigger_similar(messages: DataFrame, hit: DataFrame, clusters: DataFrame, inactive: DataFrame, k: int = 3, least: float = 0.75) -> DataFrame:
    """(message_id, cluster, similarity) for messages (message_id, q) without a keyword's `hit`: of the k nearest
    clusters (cluster, v) those at `least` or more that are active."""
    found = nearest(messages.join(hit, "message_id", "left_anti"), clusters, k, "message_id", "cluster", least=least)
    return found.join(inactive, F.concat(F.lit("cluster:"), F.col("cluster").cast("string")) == F.col("trigger_id"), "left_anti").drop("rank")
