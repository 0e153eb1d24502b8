"""The keyword lane: stored postings, BM25 for many queries at once, and the symbolic overlap score."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from memlake.functions.text import all_tokens, tokens

K1, B = 1.2, 0.75
BUCKETS = 32
DOCS = 4096  # documents whose postings one task makes
#: Parts of the documents by a hash of their key: all that a query's scores need of a document lies in one of them.
PARTS = 1024
#: Least inverse document frequency: that of terms in over half of the documents.
COMMON = 1e-6


def _exploded(docs: DataFrame, key: str, texts: tuple[str, ...]) -> DataFrame:
    """(key, length, term); lengths are taken before the explosion, else they'd be computed for every term."""
    words = docs.select(key, F.concat(*(all_tokens(F.col(t)) for t in texts)).alias("words"))
    return words.select(key, F.size("words").alias("length"), "words").select(key, "length", F.explode("words").alias("term"))


def postings(docs: DataFrame, key: str, *texts: str) -> DataFrame:
    """(key, term, tf, length): counts are combined before the one shuffle, by document and term."""
    return _exploded(docs, key, texts).groupBy(key, "length", "term").agg(F.count("*").alias("tf"))


@dataclass(frozen=True)
class Index:
    """Postings (term, key, tf, length) of a collection and its totals."""

    postings: DataFrame
    n_docs: int
    all_words: int

    @staticmethod
    def of(docs: DataFrame, key: str = "chunk_id", texts: tuple[str, ...] = ("text", "summary"), path: str | None = None) -> Index:
        """With a path the postings are stored there, by buckets of terms and sorted, so that a query reads its own terms'."""
        n_docs = docs.count()
        if path is not None:  # texts move, once; their postings, which are larger, are combined where they are made
            docs = docs.select(key, *texts).repartition(max(BUCKETS, n_docs // DOCS), key)
        made = postings(docs, key, *texts).withColumn("bucket", F.pmod(F.xxhash64("term"), F.lit(BUCKETS)).cast("int"))
        if path is not None:
            salts = max(1, n_docs // (DOCS * 4))  # files of a bucket, so that no task sorts more as documents grow
            salt = F.pmod(F.xxhash64(key), F.lit(salts))
            made.repartition(BUCKETS * salts, "bucket", salt).sortWithinPartitions("bucket", "term").write.partitionBy("bucket").mode("overwrite").parquet(path)
            made = docs.sparkSession.read.parquet(path)
        return Index(made, n_docs, made.agg(F.sum("tf")).first()[0] or 0)


def _asked(queries: DataFrame) -> DataFrame:
    """(query_id, term, bucket) of a stated set of queries, small enough to broadcast."""
    asked = queries.select("query_id", F.explode(tokens(F.col("query"))).alias("term"))
    return F.broadcast(asked.withColumn("bucket", F.pmod(F.xxhash64("term"), F.lit(BUCKETS)).cast("int")))


def part_of(key: str) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(PARTS)).cast("int")


def _terms(asked: DataFrame) -> DataFrame:
    return F.broadcast(asked.select("bucket", "term").distinct())


def matches(index: Index, queries: DataFrame, key: str = "chunk_id") -> DataFrame:
    """(query_id, key, bm25, shared, part): the score of every document that has a query's term, and how many it has.

    Only postings of asked terms are shuffled, by `part`, the document's; they meet the queries and are added up there.
    """
    asked = _asked(queries)
    found = index.postings.join(_terms(asked), ["bucket", "term"]).select(part_of(key).alias("part"), key, "term", "tf", "length").repartition("part")
    often = found.select("part", "term", key).distinct().groupBy("term").agg(F.count("*").alias("df"))
    idf = F.log((index.n_docs - F.col("df") + 0.5) / (F.col("df") + 0.5))
    idf = F.when(idf <= 0, F.lit(COMMON)).otherwise(idf)
    mean = index.all_words / max(1, index.n_docs)
    weight = idf * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("length") / mean))
    each = found.join(F.broadcast(often), "term").join(F.broadcast(asked.select("query_id", "term")), "term")
    return each.groupBy("part", "query_id", key).agg(F.round(F.sum(weight), 6).alias("bm25"), F.count("*").alias("shared"))


def best(scored: DataFrame, score: str, limit: int, key: str = "chunk_id") -> DataFrame:
    """The `limit` best rows of each query with their `rank`, ties to the smaller key: first of each query's parts by a
    hash of the key, then of these, so that no task sorts all hits of one query."""
    scored = scored if "part" in scored.columns else scored.withColumn("part", part_of(key))
    part = W.partitionBy("part", "query_id").orderBy(F.desc(score), key)
    few = scored.withColumn("memlake_n", F.row_number().over(part)).where(F.col("memlake_n") <= limit).drop("memlake_n", "part")
    return few.withColumn("rank", F.row_number().over(W.partitionBy("query_id").orderBy(F.desc(score), key))).where(F.col("rank") <= limit)


def bm25(index: Index, queries: DataFrame, key: str = "chunk_id", limit: int = 200) -> DataFrame:
    """(query_id, key, bm25, rank): the `limit` best of all documents for each query."""
    return best(matches(index, queries, key).drop("shared"), "bm25", limit, key)


def symbolic(shared: Column, n_terms: Column, named: Column, labelled: Column) -> Column:
    """Share of query terms in the chunk, +0.2 if the source's name holds one, +0.1 if a label does; 1 at most."""
    total = shared / n_terms + F.when(named, 0.2).otherwise(0.0) + F.when(labelled, 0.1).otherwise(0.0)
    return F.when(n_terms == 0, 0.0).otherwise(F.least(F.lit(1.0), total))


def named_by(query_tokens: Column, source_id: Column) -> Column:
    return F.exists(query_tokens, lambda t: F.contains(F.lower(source_id), t))


def labelled_by(query_tokens: Column, labels: Column) -> Column:
    return F.arrays_overlap(query_tokens, tokens(F.array_join(labels, ",")))


def symbolic_scores(index: Index, chunks: DataFrame, queries: DataFrame, key: str = "chunk_id") -> DataFrame:
    """(query_id, key, symbolic, part) of every chunk that shares a term with a query by text, source name or label.

    Texts meet the queries in the postings; only names and labels are compared with each of the queries' terms.
    """
    asked = _asked(queries)
    terms = _terms(asked)
    text = index.postings.join(terms, ["bucket", "term"]).select(key, "term").join(chunks.select(key), key, "left_semi").withColumn("kind", F.lit("s"))
    names = chunks.select(key, F.lower("source_id").alias("name"))
    name = names.join(terms, F.contains(F.col("name"), F.col("term"))).select(key, "term", F.lit("n").alias("kind"))
    labels = chunks.select(key, F.explode(tokens(F.array_join("labels", ","))).alias("term"))
    label = labels.join(terms.select("term"), "term", "left_semi").select(key, "term", F.lit("l").alias("kind"))
    # What documents share with any query is shuffled; with which queries they share it is found where they are.
    rows = text.unionByName(name).unionByName(label).select(part_of(key).alias("part"), key, "term", "kind").repartition("part")
    each = rows.join(F.broadcast(asked.select("query_id", "term")), "term")
    met = each.groupBy("part", "query_id", key).agg(F.count_if(F.col("kind") == "s").alias("s"), F.count_if(F.col("kind") == "n").alias("n"), F.count_if(F.col("kind") == "l").alias("l"))
    sizes = F.broadcast(queries.select("query_id", F.size(tokens(F.col("query"))).alias("terms")))
    return met.join(sizes, "query_id").select("part", "query_id", key, F.round(symbolic(F.col("s"), F.col("terms"), F.col("n") > 0, F.col("l") > 0), 6).alias("symbolic"))
