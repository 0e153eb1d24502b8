"""Exact neighbours of many queries: queries and items meet in a grid of cells, each a block of items past which a stripe
of queries streams.

In a cell one matrix product of unit vectors finds, for each query, the items that may be among its k best; only these
are scored by the definition of `vector.cosine`, in its order of additions, and rounded as Spark rounds.  So a cell holds
one block and one batch of queries, whatever the number of either, and returns k rows for each of its queries.
"""

from __future__ import annotations

import os
from decimal import ROUND_HALF_UP, Decimal

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

ITEMS, QUERIES = 1 << 14, 1 << 14  # rows of a block, and of a stripe
BATCH = 256  # queries in one product
PAIRS = 1 << 16  # pairs scored at once
MARGIN = 2e-6  # two roundings to six places, and the product's error
#: Norms whose squares or products may leave the range of doubles; their rows are always scored.
TINY, HUGE = 1e-140, 1e140
NAN, INF = 1 << 62, (1 << 62) - 1

ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def use_package(spark: SparkSession) -> None:
    """Python workers find this package where the driver found it (same path on every node)."""
    env = spark.sparkContext.environment
    have = env.get("PYTHONPATH", "").split(os.pathsep)
    if ROOT not in have:
        env["PYTHONPATH"] = os.pathsep.join([ROOT, *filter(None, have)])


def matrices(column: pa.Array) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """Rows and their vectors by length; null vectors and those with a null component count as of no length."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    sizes = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    values = column.flatten()  # without what null rows hold
    begins = np.cumsum(sizes) - sizes
    holes = np.flatnonzero(values.is_null().to_numpy(zero_copy_only=False)) if values.null_count else ()
    flat = np.asarray(values.to_numpy(zero_copy_only=False), np.float64)
    lengths = sizes.copy()
    if len(holes):
        lengths[np.searchsorted(begins + sizes, holes, "right")] = 0
    out = {}
    for w in np.unique(lengths):
        at = np.flatnonzero(lengths == w)
        out[int(w)] = at, flat[begins[at][:, None] + np.arange(w)] if w else np.zeros((len(at), 0))
    return out


def summed(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Products of rows, added from the first component to the last."""
    total = np.zeros(len(a))
    with np.errstate(all="ignore"):
        for d in range(a.shape[1]):
            total += a[:, d] * b[:, d]
    return total


def millionths(x: np.ndarray) -> np.ndarray:
    """Doubles in whole millionths, halves of their shortest decimal form away from zero; NaN above all."""
    finite = np.isfinite(x)
    y = np.abs(np.where(finite, x, 0.0)) * 1e6
    out = np.floor(y + 0.5).astype(np.int64)
    for i in np.flatnonzero(np.abs(y - np.floor(y) - 0.5) < 1e-6):
        out[i] = int((Decimal(repr(abs(float(x[i])))) * 1_000_000).quantize(Decimal(1), ROUND_HALF_UP))
    out = np.where(x < 0, -out, out)
    return np.where(finite, out, np.where(np.isnan(x), NAN, np.where(x > 0, INF, -INF)))


def unit(m: np.ndarray, norm: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Unit vectors, zero for zero vectors, and which rows the product can't judge."""
    odd = ~((norm == 0) | ((norm > TINY) & (norm < HUGE)))
    scale = np.where(odd | (norm == 0), 1.0, norm)
    return np.where((odd | (norm == 0))[:, None], 0.0, m) / scale[:, None], odd


class Block:
    """Items of a cell in the order of their keys."""

    def __init__(self, keys: pa.Array, vectors: pa.Array):
        order = pc.sort_indices(keys, null_placement="at_start")
        self.keys, self.by_width, self.width = keys.take(order), matrices(vectors.take(order)), None

    def of_width(self, w: int) -> None:
        """The block as a matrix of vectors of one length; all others are zero vectors in it."""
        if self.width == w:
            return
        self.width, self.whole, self.fits = w, np.zeros((len(self.keys), w)), np.zeros(len(self.keys), bool)
        if w in self.by_width:
            at, m = self.by_width[w]
            self.whole[at], self.fits[at] = m, True
        self.norm = np.sqrt(summed(self.whole, self.whole))
        self.unit, self.odd = unit(self.whole, self.norm)

    def best(self, queries: np.ndarray, upto: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Query, item and millionths of the k best of each query among its first `upto` items, ties to the first."""
        n = len(self.keys)
        norm = np.sqrt(summed(queries, queries))
        units, odd = unit(queries, norm)
        near = units @ self.unit.T
        near[:, self.odd] = -np.inf
        near[np.arange(n) >= upto[:, None]] = -np.inf
        least = np.partition(near, n - k, axis=1)[:, n - k] - MARGIN if n > k else np.full(len(queries), -np.inf)
        least[odd] = -np.inf
        q, i = np.nonzero((near >= least[:, None]) | self.odd)
        keep = i < upto[q]
        q, i = q[keep], i[keep]
        found = np.zeros(len(q), np.int64)
        for first in range(0, len(q), PAIRS):
            a, b = q[first : first + PAIRS], i[first : first + PAIRS]
            both = norm[a] * self.norm[b]
            some = self.fits[b] & ((both > 0) | np.isnan(both))
            found[first : first + PAIRS] = millionths(np.where(some, summed(queries[a], self.whole[b]) / np.where(some, both, 1.0), 0.0))
        order = np.lexsort((i, -found, q))
        q, i, found = q[order], i[order], found[order]
        begins = np.searchsorted(q, q)
        few = np.arange(len(q)) - begins < k
        return q[few], i[few], found[few]


def similarities(m: np.ndarray) -> np.ndarray:
    return np.where(np.abs(m) < INF, m / 1e6, np.where(m == NAN, np.nan, np.where(m > 0, np.inf, -np.inf)))


def _search(k: int, before: bool, names: list[str]):
    def answers(block: Block, asked: pa.RecordBatch):
        keys = asked.column(2)
        for w, (rows, m) in matrices(asked.column(4)).items():
            block.of_width(w)
            upto = np.full(len(rows), len(block.keys))
            if before:
                upto = np.searchsorted(block.keys.to_numpy(zero_copy_only=False), keys.take(pa.array(rows)).to_numpy(zero_copy_only=False), "left")
            for first in range(0, len(rows), BATCH):
                with np.errstate(all="ignore"):
                    q, i, found = block.best(m[first : first + BATCH], upto[first : first + BATCH], k)
                yield pa.RecordBatch.from_arrays([keys.take(pa.array(rows[first + q])), block.keys.take(pa.array(i)), pa.array(similarities(found))], names=names)

    def run(batches):
        """Rows (cell, is_query, query's key, item's key, vector), sorted by cell with items first."""
        cell, block, held = None, None, []
        for b in batches:
            cells, asks = b.column(0).to_numpy(), b.column(1).to_numpy(zero_copy_only=False)
            cuts = np.flatnonzero((np.diff(cells) != 0) | (asks[1:] != asks[:-1])) + 1
            for low, high in zip([0, *cuts], [*cuts, len(cells)], strict=True):
                if low == high:
                    continue
                if cells[low] != cell:
                    cell, block, held = cells[low], None, []
                part = b.slice(low, high - low)
                if not asks[low]:
                    held.append(part)
                elif block is None and not held:
                    continue  # a cell without items
                else:
                    if block is None:
                        block = Block(pa.concat_arrays([x.column(3) for x in held]), pa.concat_arrays([x.column(4) for x in held]))
                        held = []
                    yield from answers(block, part)

    return run


def neighbours(queries: DataFrame, items: DataFrame, k: int, query_key: str, item_key: str, query_vector: str, item_vector: str, before: bool = False) -> DataFrame:
    """(query_key, item_key, similarity): at least the k most similar items of each query, k from each block; with
    `before` among the items of smaller key only."""
    spark = queries.sparkSession
    use_package(spark)
    blocks, stripes = (max(1, -(-df.count() // most)) for df, most in ((items, ITEMS), (queries, QUERIES)))

    def dealt(key: str, vector: str, n: int):
        return F.pmod(F.xxhash64(key, vector), F.lit(n)).cast("int")

    def every(n: int):
        return F.explode(F.sequence(F.lit(0), F.lit(n - 1)))

    kinds = queries.schema[query_key].dataType, items.schema[item_key].dataType
    asked = queries.select(query_key, F.col(query_vector).cast("array<double>").alias("v")).withColumn("at", dealt(query_key, "v", stripes)).withColumn("block", every(blocks))
    have = items.select(item_key, F.col(item_vector).cast("array<double>").alias("v")).withColumn("block", dealt(item_key, "v", blocks)).withColumn("at", every(stripes))
    cell = (F.col("block") * stripes + F.col("at")).alias("cell")
    rows = have.select(cell, F.lit(False).alias("asks"), F.lit(None).cast(kinds[0]).alias("q"), F.col(item_key).alias("i"), "v").unionByName(asked.select(cell, F.lit(True).alias("asks"), F.col(query_key).alias("q"), F.lit(None).cast(kinds[1]).alias("i"), "v"))
    met = rows.repartitionById(blocks * stripes, "cell").sortWithinPartitions("cell", "asks")
    schema = T.StructType([T.StructField(query_key, kinds[0]), T.StructField(item_key, kinds[1]), T.StructField("similarity", T.DoubleType())])
    return met.mapInArrow(_search(k, before, [query_key, item_key, "similarity"]), schema)
