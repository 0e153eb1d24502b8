"""Sharding by best-fit-decreasing bin packing.

Indivisible groups, largest first, each enter the bin with the least remaining capacity that still holds them; the
bins hang in a balanced tree by remaining capacity.  `shards` packs documents into a fixed number of shards of nearly
equal size with it:

* a group is all documents of one text.  Only a group larger than a whole shard is divided, by a hash of doc_id, and a
  single document larger than a share gets a bin of its own;
* what the driver packs is bounded whatever the input: groups above 1/RESOLUTION of a shard (there are at most
  bins * RESOLUTION of them) and as many tiles, a tile being the small groups of one hash bucket;
* the capacity starts at an equal share and rises by small steps until everything fits.

Slots are gapless within a shard: by block (a hash of the row), then doc_id, counted from the blocks' totals, so no task
sees a whole shard.  Null text: no bytes and the CRC of nothing, grouped with empty texts.  Null doc_ids sort first.  Repeated rows
stay together and get a slot each.  An empty table gives an empty result.
"""

from __future__ import annotations

from bisect import bisect_left, insort

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from memlake.llm.common import table, written

RESOLUTION = 2048
#: Pieces into which a group that exceeds a shard is hashed, for each shard that it would fill.
PIECES = 64


class Tree:
    """A height-balanced (AVL) search tree of (remaining, bin) pairs."""

    __slots__ = ("root",)

    def __init__(self):
        self.root = None

    @staticmethod
    def _node(key, left, right):
        return (key, left, right, 1 + max(left[3] if left else 0, right[3] if right else 0))

    @classmethod
    def _balanced(cls, key, left, right):
        hl, hr = left[3] if left else 0, right[3] if right else 0
        if hl > hr + 1:
            k, a, b, _ = left
            if (a[3] if a else 0) >= (b[3] if b else 0):
                return cls._node(k, a, cls._node(key, b, right))
            return cls._node(b[0], cls._node(k, a, b[1]), cls._node(key, b[2], right))
        if hr > hl + 1:
            k, a, b, _ = right
            if (b[3] if b else 0) >= (a[3] if a else 0):
                return cls._node(k, cls._node(key, left, a), b)
            return cls._node(a[0], cls._node(key, left, a[1]), cls._node(k, a[2], b))
        return cls._node(key, left, right)

    def add(self, key) -> None:
        def put(n):
            if n is None:
                return self._node(key, None, None)
            k, a, b, _ = n
            return self._balanced(k, put(a), b) if key < k else self._balanced(k, a, put(b))

        self.root = put(self.root)

    def pop_at_least(self, size):
        """Removes and returns the least pair whose remaining capacity is `size` or more, or None."""
        n, best = self.root, None
        while n:
            if n[0][0] >= size:
                best, n = n[0], n[1]
            else:
                n = n[2]
        if best is not None:
            self._remove(best)
        return best

    def _remove(self, key) -> None:
        def least(n):
            while n[1]:
                n = n[1]
            return n[0]

        def cut(n, key):
            k, a, b, _ = n
            if key < k:
                return self._balanced(k, cut(a, key), b)
            if key > k:
                return self._balanced(k, a, cut(b, key))
            if a is None or b is None:
                return a or b
            k = least(b)
            return self._balanced(k, a, cut(b, k))

        self.root = cut(self.root, key)


def pack(sizes: list[int], capacity: int) -> list[int]:
    """Best-fit decreasing: the bin of each item, opening a bin when none has room.

    An item above the capacity has a bin to itself.  Ties: earlier items first, lower bins first.
    """
    tree, bins, out = Tree(), 0, [0] * len(sizes)
    for i in sorted(range(len(sizes)), key=lambda i: (-sizes[i], i)):
        found = tree.pop_at_least(sizes[i])
        room, at = found if found else (capacity, bins)
        bins += found is None
        out[i] = at
        if room > sizes[i]:
            tree.add((room - sizes[i], at))
    return out


def pack_into(sizes: list[int], bins: int) -> list[int]:
    """`pack` with the least capacity found, from an equal share upwards, that needs no more than `bins`."""
    order = sorted(range(len(sizes)), key=lambda i: (-sizes[i], i))
    out, alone, left = [0] * len(sizes), 0, sum(sizes)
    while alone < min(len(order), bins - 1) and sizes[order[alone]] * (bins - alone) > left:
        out[order[alone]] = alone
        left -= sizes[order[alone]]
        alone += 1
    rest, free = order[alone:], bins - alone
    if not rest:
        return out
    slack = 1 / 4096
    while True:
        capacity = max(sizes[rest[0]], -(-left // free) + int(left / free * slack))
        found = pack([sizes[i] for i in rest], capacity)
        if max(found) < free:
            for i, at in zip(rest, found, strict=True):
                out[i] = alone + at
            return _levelled(sizes, out, bins)
        slack *= 2


def _levelled(sizes: list[int], at: list[int], bins: int) -> list[int]:
    """Moves items from the fullest bin to the emptiest while that brings the two nearer; at most a few moves a bin."""
    load, held = [0] * bins, [[] for _ in range(bins)]
    for i, b in enumerate(at):
        load[b] += sizes[i]
        insort(held[b], (sizes[i], i))
    for _ in range(16 * bins):
        hi, lo = max(range(bins), key=lambda b: load[b]), min(range(bins), key=lambda b: load[b])
        gap = load[hi] - load[lo]
        k = min(bisect_left(held[hi], ((gap + 1) // 2 + 1, -1)), len(held[hi])) - 1
        if k < 0 or held[hi][k][0] >= gap or held[hi][k][0] == 0:
            break
        size, i = held[hi].pop(k)
        insort(held[lo], (size, i))
        load[hi] -= size
        load[lo] += size
        at[i] = lo
    return at


def shards(docs: DataFrame, bins: int, resolution: int = RESOLUTION) -> DataFrame:
    """(doc_id, size, text_crc32, shard, slot): every row of `docs` (doc_id, text) in a shard from 0 to `bins` - 1."""
    spark = docs.sparkSession
    text = F.coalesce(F.col("text"), F.lit(""))
    slim = written(docs.select("doc_id", (F.octet_length(text) + 8).cast("long").alias("size"), F.crc32(text).alias("text_crc32"), F.xxhash64(text).alias("g")))
    groups = slim.groupBy("g").agg(F.sum("size").alias("bytes"), F.max("size").alias("one"))
    groups = written(groups)
    total = groups.agg(F.sum("bytes")).first()[0] or 0
    share = max(1, total // bins)
    tiles, step = bins * resolution, max(1, share // resolution)
    # A group of more than a share is hashed into pieces; fewer than `bins` groups can be.
    split = groups.where(F.col("bytes") > share).select("g", F.least(F.ceil(F.col("bytes") * PIECES / share), F.ceil(F.col("bytes") / F.col("one"))).cast("long").alias("pieces"))
    hot = {r["g"]: r["pieces"] for r in split.collect()}
    pieces = F.lit(None).cast("long")
    for g, n in hot.items():
        pieces = F.when(F.col("g") == F.lit(g), F.lit(n)).otherwise(pieces)
    # Items: (kind, key) is a large group or a piece of one (0, hash) or a tile of small groups (1, bucket).
    small = (F.col("bytes") <= step) & pieces.isNull()
    bucket = F.pmod(F.xxhash64("g"), F.lit(tiles))
    plain = groups.where(pieces.isNull()).select(small.cast("int").alias("kind"), F.when(small, bucket).otherwise(F.col("g")).alias("key"), F.lit(0).cast("long").alias("piece"), "bytes")
    by_piece = F.pmod(F.xxhash64(F.coalesce(F.col("doc_id"), F.lit(0))), pieces)
    items = plain.groupBy("kind", "key", "piece").agg(F.sum("bytes").alias("bytes"))
    if hot:
        cut = slim.where(pieces.isNotNull()).groupBy(F.lit(0).alias("kind"), F.col("g").alias("key"), by_piece.alias("piece")).agg(F.sum("size").alias("bytes"))
        items = items.unionByName(cut)
    got = sorted(map(tuple, items.collect()))
    at = pack_into([b for *_, b in got], bins)
    placed = spark.createDataFrame([(k, key, p, s) for (k, key, p, _), s in zip(got, at, strict=True)], "kind int, key long, piece long, shard int")
    small_groups = groups.where(pieces.isNull()).select("g", small.cast("int").alias("kind"), F.when(small, bucket).otherwise(F.col("g")).alias("key"))
    where = small_groups.join(F.broadcast(placed), ["kind", "key"]).select("g", F.lit(0).cast("long").alias("piece"), "shard")  # at most 2 * tiles rows
    if hot:
        where = where.unionByName(placed.where((F.col("kind") == 0) & F.col("key").isin(list(hot))).select(F.col("key").alias("g"), "piece", "shard"))
    piece = F.coalesce(by_piece, F.lit(0).cast("long")) if hot else F.lit(0).cast("long")
    return _slots(slim.withColumn("piece", piece).join(where, ["g", "piece"]).drop("piece"), max(64, int(spark.conf.get("spark.sql.shuffle.partitions"))))


def _slots(df: DataFrame, blocks: int) -> DataFrame:
    """Adds `slot`: first by block (a hash of the row), then by doc_id, counted within the shard."""
    df = written(df.withColumn("block", F.pmod(F.xxhash64("doc_id", "g", F.lit(1)), F.lit(blocks)).cast("int")))
    totals = df.groupBy("shard", "block").count()
    before = F.sum("count").over(W.partitionBy("shard").orderBy("block").rowsBetween(W.unboundedPreceding, -1))
    offsets = totals.select("shard", "block", F.coalesce(before, F.lit(0)).alias("offset"))
    rank = F.row_number().over(W.partitionBy("shard", "block").orderBy("doc_id", "g"))
    ranked = df.withColumn("rank", rank).join(F.broadcast(offsets), ["shard", "block"])  # shards * blocks rows
    return ranked.select("doc_id", "size", "text_crc32", "shard", (F.col("rank") - 1 + F.col("offset")).cast("long").alias("slot"))


def op9_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = shards(table(spark, sf_dir, "documents").select("doc_id", "text"), 24)
    return out.withColumns({"law": F.lit("bytes"), "grown_shard": F.lit(None).cast("int")})
