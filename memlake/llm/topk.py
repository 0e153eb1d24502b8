"""Exact top-k search by the threshold algorithm of Fagin, Lotem and Naor.

Every block of candidates keeps one list per dimension, sorted by component.  A query reads all lists in step, each
from the end that its own component's sign makes best; rows met for the first time are scored in full.  What no list
has shown yet can score at most the sum of the components at the reading depth times the query's.  Reading stops once
that bound is below the k-th score (below, not at: an unseen equal score could have a smaller id), or once every row
has been met, which in many dimensions can come first.  Each step reads half as much again as all before it, so a query
is a few vectorised steps a block; lists that its component is 0 in are not read.

A block is sorted once; the queries, copied to every block, stream past it in bounded batches, and a last aggregation
merges each query's bests by block.  So a task holds one block and one batch, whatever the number of queries.

Scores are exact: in floats while no sum can leave 2**53, else in 64-bit integers, else in Python's; scores beyond 64
bits are reported as the nearest 64-bit value and rank as what they are, up to 38 digits, beyond which they tie.  Vectors that are null or hold a null, NaN or
infinite component take no part; missing components of shorter vectors count 0, so an empty vector scores 0.  Candidates
with the query's own id are its own row, repeats included; repeated candidates count each time, ties go to the smaller
id, repeated query rows are queries of their own.  Null ids take no part.  Empty tables give an empty result; extra
columns are ignored.
"""

from __future__ import annotations

import math
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from memlake.llm.common import table, written

BLOCK = 1 << 15  # candidates in a block
DEPTH = 8  # entries of each list in a query's first step
SCALE = 256


def quantised(vector: list[float]) -> list[int]:
    return [math.floor(SCALE * x) if abs(x) < 1e300 else math.floor(Fraction(x) * SCALE) for x in vector]


def packed(vector: list[int]) -> bytes:
    """32-bit components, or beyond those decimal ones after a mark."""
    if all(-(1 << 31) <= x < 1 << 31 for x in vector):
        return b"i" + np.array(vector, "<i4").tobytes()
    return b"d" + " ".join(map(str, vector)).encode()


def unpacked(raw: bytes) -> np.ndarray:
    return np.frombuffer(raw, "<i4", offset=1).astype(np.int64) if raw[:1] == b"i" else np.array([int(x) for x in raw[1:].split()], object)


def matrix(vectors: list[np.ndarray], width: int) -> np.ndarray:
    """The vectors as rows, with zeros to the right."""
    wide = any(v.dtype == object for v in vectors)
    out = np.zeros((len(vectors), width), object if wide else np.int64)
    for i, v in enumerate(vectors):
        out[i, : len(v)] = v
    return out


def largest(m: np.ndarray) -> int:
    return max(abs(int(m.min())), abs(int(m.max()))) if m.size else 0


class Lists:
    """A block of candidates and its sorted lists."""

    def __init__(self, ids: np.ndarray, vectors: list[np.ndarray]):
        by_id = np.argsort(ids, kind="stable")
        self.ids = ids[by_id]
        self.whole = matrix([vectors[i] for i in by_id], max(map(len, vectors), default=0))
        self.most = largest(self.whole)
        self.order = np.argsort(self.whole, axis=0, kind="stable").T.astype(np.int32).copy()
        self._kinds: dict[type, np.ndarray] = {}

    def _as(self, kind: type) -> np.ndarray:
        if kind not in self._kinds:
            self._kinds[kind] = self.whole.astype(kind)
        return self._kinds[kind]

    def top(self, own: int, query: np.ndarray, k: int) -> tuple[list[int], list[int], int, bool]:
        """Ids and scores of the k best, best first, the depth that was read, and whether the bound ended it."""
        n, width = len(self.ids), min(len(query), self.whole.shape[1])
        query = query[:width]
        reach = self.most * largest(query) * max(1, width)
        kind = float if reach < 1 << 53 else np.int64 if reach < 1 << 63 else object
        rows, query = self._as(kind)[:, :width], query.astype(kind)
        own_at = slice(*np.searchsorted(self.ids, [own, own + 1]))
        used = np.flatnonzero(query != 0)
        up, down = used[query[used] > 0], used[query[used] < 0]
        seen = np.zeros(n, bool)
        best, scores = np.zeros(0, np.int64), np.zeros(0, kind)
        read, depth = 0, min(DEPTH, n)
        while True:
            new = np.zeros(n, bool)
            new[self.order[up, n - depth : n - read]] = True
            new[self.order[down, read:depth]] = True
            fresh = np.flatnonzero(new & ~seen)
            if depth == n and not len(used):
                fresh = np.arange(n)
            seen |= new
            fresh = fresh[(fresh < own_at.start) | (fresh >= own_at.stop)]
            best, scores = np.concatenate([best, fresh]), np.concatenate([scores, rows[fresh] @ query if len(fresh) else np.zeros(0, kind)])
            if len(best) > k:
                if kind is not object:  # those that can't be among the k best go before the sort
                    keep = scores >= np.partition(scores, -k)[-k]
                    best, scores = best[keep], scores[keep]
                order = np.lexsort((best, -scores)) if kind is not object else sorted(range(len(best)), key=lambda i: (-scores[i], best[i]))
                best, scores = best[order[:k]], scores[order[:k]]  # rows are in the order of their ids
            done = depth == n or bool(seen.all())
            if not done and len(best) == k:
                edge_up, edge_down = rows[self.order[up, n - depth], up], rows[self.order[down, depth - 1], down]
                done = bool(scores.min() > (edge_up * query[up]).sum() + (edge_down * query[down]).sum())
            if done:
                order = sorted(range(len(best)), key=lambda i: (-scores[i], best[i]))
                return self.ids[best[order]].tolist(), [int(scores[i]) for i in order], depth, depth < n and not bool(seen.all())
            read, depth = depth, min(n, depth + max(DEPTH, depth // 2))


def _search(k: int):
    def run(batches):
        """Rows (block, is_query, n, id, v), sorted by block with candidates first, to the bests of each block's queries."""
        lists, block, ids, vectors = None, None, [], []
        for b in batches:
            out: list[tuple] = []
            for at, asks, n, own, raw in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if at != block:
                    lists, block, ids, vectors = None, at, [], []
                if not asks:
                    ids.append(own)
                    vectors.append(unpacked(raw))
                    continue
                if lists is None:
                    lists = Lists(np.array(ids, np.int64), vectors)
                    ids, vectors = [], []
                found, scores, _, _ = lists.top(own, unpacked(raw), k)
                out += [(n, own, x, max(-(1 << 63), min((1 << 63) - 1, s)), None if abs(s) < 1 << 62 else str(s)) for x, s in zip(found, scores, strict=True)]
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True) if out else ((),) * 5, kinds, strict=True)], names=["n", "query_id", "vec_id", "score", "beyond"])

    return run


def _packed(batches):
    for b in batches:
        made = [packed(quantised(x.as_py())) for x in b.column(2)]
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(made, pa.binary())], names=["n", "id", "v"])


def top_k(vectors: DataFrame, is_query: Column, k: int, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score) for the rows of `vectors` where `is_query`, a predicate of the id, against all rows."""
    bad = F.exists(F.col(vector_col), lambda x: x.isNull() | F.isnan(x) | (F.abs(x.cast("double")) == float("inf")))
    sane = vectors.where(F.col(id_col).isNotNull() & F.col(vector_col).isNotNull() & ~bad)
    rows = sane.select(F.monotonically_increasing_id().alias("n"), F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("v"))
    made = written(rows.mapInArrow(_packed, "n long, id long, v binary"))
    blocks = max(1, -(-made.count() // BLOCK))
    # Rows are dealt to blocks by a hash of their position: no id and no repeated row can overfill one.
    block = F.pmod(F.xxhash64("n"), F.lit(blocks)).cast("int")
    candidates = made.select(block.alias("block"), F.lit(False).alias("is_query"), "n", "id", "v")
    asked = made.withColumnRenamed("id", id_col).where(is_query).withColumnRenamed(id_col, "id")
    queries = asked.select(F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"), F.lit(True).alias("is_query"), "n", "id", "v")
    met = candidates.unionByName(queries).repartition(blocks, "block").sortWithinPartitions("block", "is_query")
    best = met.mapInArrow(_search(k), "n long, query_id long, vec_id long, score long, beyond string")
    exact = F.coalesce(F.expr("try_cast(beyond AS decimal(38, 0))"), F.col("score").cast("decimal(38, 0)"))
    rank = F.row_number().over(W.partitionBy("n").orderBy(exact.desc(), "vec_id"))
    return best.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op10_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"), F.col("vec_id") % 50 == 0, 5)


ORACLE = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(CAST(x AS DOUBLE) * 256) AS BIGINT)) AS q FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT a.vec_id AS query_id, b.vec_id, CAST(coalesce(list_sum(list_transform(list_zip(a.q, b.q), lambda p: p[1] * p[2])), 0) AS BIGINT) AS score
  FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE a.vec_id % 50 = 0
), r AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s
)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM r WHERE rank <= 5
"""
