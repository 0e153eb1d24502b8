"""The engine's tables derived from the driver's Parquet files, in Spark and (for the oracles) in SQL."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

NOW = "2024-03-01 00:00:00"
EPOCH = "2024-01-01 00:00:00"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One file-level chunk for each document, with its source's attributes."""
    d, i = table(spark, sf_dir, "documents"), F.col("doc_id")
    return d.select(
        F.concat(F.lit("chk_"), F.substring(F.sha2(F.concat(F.lit("doc:"), i.cast("string"), F.lit(":file:0")).cast("binary"), 256), 1, 16)).alias("chunk_id"),
        F.concat(F.lit("doc:"), i.cast("string")).alias("source_id"),
        i.alias("doc_id"),
        "text",
        F.substring("text", 1, 80).alias("summary"),
        F.concat(F.lit("ws"), (i % 4).cast("string")).alias("workspace_id"),
        F.when(i % 3 == 0, "public").when(i % 3 == 1, "org").otherwise("private").alias("visibility"),
        F.concat(F.lit("org"), (i % 5).cast("string")).alias("org_id"),
        F.concat(F.lit("u"), (i % 7).cast("string")).alias("user_id"),
        F.col("source").alias("repo"),
        F.when(i % 2 == 0, "conversation_summary").otherwise("github_issue").alias("source_type"),
        F.when(i % 6 == 0, F.lit(None)).otherwise(F.concat(F.lit("repo:"), F.col("source"))).alias("scope_key"),
        F.when(F.col("source").isin("src0", "src3"), "reference").otherwise("code").alias("source_class"),
        F.array(F.col("lang"), F.upper("source")).alias("labels"),
        (i % 10 != 0).alias("is_active"),
        F.timestamp_add("MINUTE", (i * 37 % 86400).cast("int"), F.lit(EPOCH).cast("timestamp")).alias("created_at"),
        F.sha2(F.col("text").cast("binary"), 256).alias("text_hash"),
    )


CHUNKS = f"""chunks AS (
  SELECT 'chk_' || substr(sha256('doc:' || doc_id || ':file:0'), 1, 16) AS chunk_id, 'doc:' || doc_id AS source_id, doc_id, text,
    substr(text, 1, 80) AS summary, 'ws' || (doc_id % 4) AS workspace_id,
    CASE doc_id % 3 WHEN 0 THEN 'public' WHEN 1 THEN 'org' ELSE 'private' END AS visibility,
    'org' || (doc_id % 5) AS org_id, 'u' || (doc_id % 7) AS user_id, source AS repo,
    CASE WHEN doc_id % 2 = 0 THEN 'conversation_summary' ELSE 'github_issue' END AS source_type,
    CASE WHEN doc_id % 6 = 0 THEN NULL ELSE 'repo:' || source END AS scope_key,
    CASE WHEN source IN ('src0', 'src3') THEN 'reference' ELSE 'code' END AS source_class,
    [lang, upper(source)] AS labels, doc_id % 10 <> 0 AS is_active,
    TIMESTAMP '{EPOCH}' + to_minutes(doc_id * 37 % 86400) AS created_at, sha256(text) AS text_hash
  FROM documents)"""


_STORED: dict[tuple[str, str], object] = {}


def stored_index(spark: SparkSession, sf_dir: str):
    """The postings of the chunks, built once for a session in the folder of `spark.checkpoint.dir` and then read."""
    from memlake.operators.lexical import Index

    at = (spark.sparkContext.applicationId, sf_dir)
    if at not in _STORED:
        base = spark.conf.get("spark.checkpoint.dir", None)
        if not base and not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        if not base:
            base = tempfile.mkdtemp(prefix="memlake-")
            atexit.register(shutil.rmtree, base, ignore_errors=True)
        _STORED[at] = Index.of(chunks(spark, sf_dir).select("chunk_id", "text", "summary"), path=f"{base.rstrip('/')}/postings-{uuid.uuid4().hex}")
    return _STORED[at]


def project_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunks(spark, sf_dir).where("doc_id % 11 = 0").select("chunk_id", F.lit("p1").alias("project_id"), "workspace_id")


LINKS = "links AS (SELECT chunk_id, 'p1' AS project_id, workspace_id FROM chunks WHERE doc_id % 11 = 0)"


def search_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(query_id, query): the first words of every benchmark item."""
    words = F.slice(F.split("text", r"\s+"), 1, 6)
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.array_join(words, " ").alias("query"))


QUERIES = "queries AS (SELECT item_id AS query_id, array_to_string(string_split_regex(text, '\\s+')[1:6], ' ') AS query FROM benchmark)"


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("v"), "label")


VECTORS = "vectors AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v, label FROM embeddings)"


def categories(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A category for each label: its first vector; even ones are active, the rest proposed; the last belong to p1."""
    v = vectors(spark, sf_dir).groupBy("label").agg(F.min_by("v", "vec_id").alias("centre"), F.count("*").alias("evidence_count"))
    return v.select(F.col("label").cast("long").alias("category_id"), F.concat(F.lit("cat"), F.col("label").cast("string")).alias("name"), F.when(F.col("label") % 2 == 0, "active").otherwise("proposed").alias("status"), F.when(F.col("label") >= 8, "p1").alias("project_id"), "centre", "evidence_count")


CATEGORIES = """categories AS (SELECT CAST(label AS BIGINT) AS category_id, 'cat' || label AS name, CASE WHEN label % 2 = 0 THEN 'active' ELSE 'proposed' END AS status,
    CASE WHEN label >= 8 THEN 'p1' END AS project_id, arg_min(v, vec_id) AS centre, count(*) AS evidence_count FROM vectors GROUP BY label)"""
