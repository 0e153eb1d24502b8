"""Vector similarity: exact neighbours, category assignment and the checks built on cosine."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from memlake.operators import dense

#: Items that are broadcast to all queries; more of them go through blocks.
FEW = 64


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """0 for zero vectors, vectors of different lengths, and nulls."""
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.coalesce(F.when((F.size(a) == F.size(b)) & (norm > 0), dot(a, b) / norm), F.lit(0.0))


def clamp(x: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), x))


def nearest(queries: DataFrame, items: DataFrame, k: int, query_key: str, item_key: str, query_vector: str = "q", item_vector: str = "v", least: float | None = None, before: bool = False) -> DataFrame:
    """(query_key, item_key, similarity, rank): the k most similar items of each query, ties to the smaller key; with
    `before` of the items with a smaller key than the query's.

    A few items meet all queries by a broadcast; more of them in blocks (`dense`).
    """
    if items.limit(FEW + 1).count() <= FEW:
        both = queries.select(query_key, F.col(query_vector).alias("memlake_q")).crossJoin(F.broadcast(items.select(item_key, F.col(item_vector).alias("memlake_v"))))
        both = both.where(F.col(item_key) < F.col(query_key)) if before else both
        scored = both.select(query_key, item_key, F.round(cosine(F.col("memlake_q"), F.col("memlake_v")), 6).alias("similarity"))
    else:
        scored = dense.neighbours(queries, items, k, query_key, item_key, query_vector, item_vector, before)
    if least is not None:
        scored = scored.where(F.col("similarity") >= least)
    rank = F.row_number().over(W.partitionBy(query_key).orderBy(F.desc("similarity"), item_key))
    return scored.withColumn("rank", rank).where(F.col("rank") <= k)


def stretched(score: str, partition: str) -> Column:
    """A score over its partition's maximum, where that is positive."""
    top = F.max(score).over(W.partitionBy(partition))
    return F.when(top > 0, F.col(score) / top).otherwise(F.col(score))
