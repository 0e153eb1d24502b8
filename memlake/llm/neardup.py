"""Near-duplicates by bottom-k sketches of one hash function.

A document is the set of its word shingles' 64-bit hashes, its sketch the K least of them (MinHash with one function).
1. Documents of one set are one class; the classes' sketches make inverted lists of retained values.  Two sets as
   similar as asked share NEED or more of them (but for a chance below 1e-7; certain for sets within K), so a
   class enters only the lists of its size - NEED + 1 rarest values: similar classes still meet, widespread passages
   fill no lists.
2. In each list the least class is paired with the others, never all with all.  A pair's union sketch of the L least
   values estimates its similarity (exactly for sets within L); pairs far below go.
3. The pairs left are verified on full sets, each class's best pair first; links make components, and pairs within
   one component need no verifying.
4. Lists that still hold several components are searched for pairs across these.  Short lists compare all their
   sketches.  The classes of long ones are met again by full sets: a class enters the lists of those of its values, the
   rarest first, that can be the first one shared with a similar set, and there only meets sizes near its own.  Each such
   list pairs the class of fewest rarer values with the others; lists that then still hold several components pair these.
   Step 3 takes all of them.  So no link between components is missed, and widespread texts that differ too much from
   each other fill no long lists.

Words are runs of other than ASCII white space, lower-cased in A-Z.  Fewer words than a shingle make one shingle; no
words (or a null text) none, and such documents are linked with nothing.  Copies of one text, repeated rows included,
are one class.  A null doc_id is less than none: a component is named by its least non-null doc_id, if it has one.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from memlake.llm.common import drop_written, only_keys, raw_texts, table, use_package, written
from memlake.llm.graphs import components

K, NEED = 48, 22
#: Retained values that estimate a pair, and how many a similar pair shares but for a chance below 1e-7.
L, NEED_L = 128, 76
#: Lists of more classes are searched by full sets.
BLOCK = 64
#: Sizes within this factor share a cell; a cell's pairs are met in parts of so many classes.
STEP, PART = 1.05, 4096
_ODD = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5, 0x85EBCA77C2B2AE63, 0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53, 0x94D049BB133111EB], np.uint64)


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser of 64-bit values."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def word_hashes(text: bytes) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh64_intdigest, text.lower().split()), np.uint64)


def grams(words: np.ndarray, width: int) -> np.ndarray:
    """Hashes of all runs of `width` words, in 63 bits (so that signed order is theirs)."""
    if len(words) < width:
        return mixed((words * _ODD[: len(words)]).sum(keepdims=True) + np.uint64(len(words))) >> np.uint64(1) if len(words) else words
    n = len(words) - width + 1
    out = np.zeros(n, np.uint64)
    for i in range(width):
        out += words[i : i + n] * _ODD[i]
    return mixed(out) >> np.uint64(1)


def shingles(text: bytes, width: int) -> np.ndarray:
    return np.unique(grams(word_hashes(text), width))


def needed(n: int, percent: int, kept: int = K, need: int = NEED) -> int:
    """Of `kept` retained values, those that a set of n surely (n <= kept) or almost surely shares with any similar one."""
    if n > kept:
        return need
    if n == 0:
        return 1
    top = n * 100 // percent
    return max(1, min(-(-percent * max(n, m) // 100) - max(0, m - kept) for m in range(max(1, -(-n * percent // 100)), top + 1)))


def _sketch(width: int, percent: int):
    def run(batches):
        for b in batches:
            rows = []
            for text in raw_texts(b.column(2)):
                s = shingles(text, width)
                key = mixed(mixed(s * _ODD[0]).sum(keepdims=True) + np.uint64(len(s)))[0].astype(np.int64) if len(s) else None
                rows.append((len(s), key, needed(len(s), percent), s[:L].astype(np.int64)))
            n, key, need, sketch = zip(*rows, strict=True) if rows else ((), (), (), ())
            columns = [b.column(0), b.column(1), pa.array(n, pa.int64()), pa.array(key, pa.int64()), pa.array(need, pa.int32()), pa.array(sketch, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "th", "n", "node", "need", "sketch"])

    return run


def _verify(width: int, percent: int):
    def run(batches):
        for b in batches:
            held, ok = {}, []
            for u, x, y in zip(b.column(0).to_pylist(), raw_texts(b.column(2)), raw_texts(b.column(3)), strict=True):
                if u not in held:
                    held = {u: shingles(x, width)}  # rows come sorted by u
                s, t = held[u], shingles(y, width)
                both = len(np.intersect1d(s, t, assume_unique=True))
                ok.append(100 * both >= percent * (len(s) + len(t) - both))
            keep = pa.array(ok, pa.bool_())
            yield pa.RecordBatch.from_arrays([b.column(0).filter(keep), b.column(1).filter(keep)], names=["a", "b"])

    return run


def _estimate(percent: int):
    """(a, b, na, nb, sa, sb) to the pairs that may be similar; certain where both sketches are whole sets."""

    def run(batches):
        for b in batches:
            rows = []
            a, c, na, nb = (b.column(i).to_pylist() for i in range(4))
            for u, v, m, n, x, y in zip(a, c, na, nb, b.column(4).to_numpy(zero_copy_only=False), b.column(5).to_numpy(zero_copy_only=False), strict=True):
                both = np.intersect1d(x, y, assume_unique=True)
                if m <= L and n <= L:
                    shared, of = len(both), m + n - len(both)
                    ok = 100 * shared >= percent * of
                else:
                    union = np.union1d(x, y)[:L]
                    shared, of = int((both <= union[-1]).sum()), len(union)
                    ok = shared >= NEED_L
                if ok:
                    rows.append((u, v, shared / of))
            columns = zip(*rows, strict=True) if rows else ((),) * 3
            yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(columns, (pa.int64(), pa.int64(), pa.float64()), strict=True)], names=["a", "b", "similar"])

    return run


def _across(percent: int):
    """Pairs of different components in the lists of a group that may be similar, by one product for each cell."""

    def run(group: pd.DataFrame) -> pd.DataFrame:
        out = []
        for _, cell in group.groupby(["value", "cell"], sort=False):
            cell = cell.drop_duplicates("node")
            node, root, n, side = (cell[x].to_numpy() for x in ("node", "root", "n", "side"))
            if (root == root[0]).all():
                continue
            sizes = cell["sketch"].map(len).to_numpy()
            _, at, times = np.unique(np.concatenate(cell["sketch"].to_list()), return_inverse=True, return_counts=True)
            column = np.cumsum(times > 1) - 1  # values of one row alone are shared with none
            keep = times[at] > 1
            has = np.zeros((len(cell), int((times > 1).sum())), np.float32)
            has[np.repeat(np.arange(len(cell)), sizes)[keep], column[at[keep]]] = 1
            shared = has @ has.T
            whole = (n[:, None] <= L) & (n[None, :] <= L)
            need = np.array([needed(int(x), percent, L, NEED_L) for x in n])
            exact = 100 * shared >= percent * (n[:, None] + n[None, :] - shared)
            sized = (100 * n[:, None] >= percent * n[None, :]) & (100 * n[None, :] >= percent * n[:, None])
            likely = np.where(whole, exact, shared >= np.minimum(need[:, None], need[None, :]))
            i, j = np.nonzero(likely & sized & (root[:, None] != root[None, :]) & (node[:, None] < node[None, :]) & ((side[:, None] != side[None, :]) | (side[:, None] == 2)))
            out.append(pd.DataFrame({"a": node[i], "b": node[j], "similar": (shared[i, j] / np.minimum(sizes[i], sizes[j])).astype(float)}))
        return pd.concat(out).drop_duplicates(["a", "b"]) if out else pd.DataFrame({"a": np.zeros(0, "int64"), "b": np.zeros(0, "int64"), "similar": np.zeros(0)})

    return run


def _tokens(width: int):
    """(node, text) to (node, n, value): the full set, a row for each value."""

    def run(batches):
        for b in batches:
            for node, text in zip(b.column(0).to_pylist(), raw_texts(b.column(1)), strict=True):
                s = shingles(text, width)
                for i in range(0, len(s), 1 << 16):
                    part = s[i : i + (1 << 16)].astype(np.int64)
                    yield pa.RecordBatch.from_arrays([pa.array(x) for x in (np.full(len(part), node), np.full(len(part), len(s)), part)], names=["node", "n", "value"])

    return run


def _prefixes(tokens: DataFrame, percent: int) -> DataFrame:
    """(node, n, value, pos): of full sets in the order of rarity the values that can be a similar pair's first shared one.

    A set of n shares percent * n / 100 values or more with any similar one, so the first shared one has as many from it on.
    """
    often = tokens.groupBy("value").agg(F.count("*").alias("df")).where("df > 1")
    met = tokens.join(often, "value").groupBy("node", "n").agg(F.array_sort(F.collect_list(F.struct("df", "value"))).alias("met"))
    alone = (F.col("n") - F.size("met")).alias("alone")  # values of one set come first
    room = F.greatest(F.lit(0), F.floor(F.col("n") * (100 - percent) / 100) + 1 - F.col("alone")).cast("int")
    found = met.select("node", "n", alone, "met").select("node", "n", "alone", F.posexplode(F.slice("met", F.lit(1), room)).alias("at", "m"))
    return found.select("node", "n", F.col("m.value").alias("value"), (F.col("alone") + F.col("at")).alias("pos"))


def _cells(found: DataFrame, percent: int) -> DataFrame:
    """(value, low, high, node, n, pos, side): a row for each class of sizes that may hold a similar set's size.

    Classes of sizes are steps of a factor; low and high are a pair's two.  Two sets of n and m that are similar share
    percent * (n + m) / (100 + percent) or more, and their first shared value has as many from it on in either.
    """
    step = F.floor(F.log("n") / F.lit(float(np.log(STEP)))).cast("int")
    reach = int(np.log(100 / percent) / np.log(STEP)) + 1
    out = found.withColumn("own", step).withColumn("other", F.explode(F.sequence(F.col("own") - reach, F.col("own") + reach)))
    least = F.pow(F.lit(STEP), F.col("other")) * (1 - 1e-9)
    out = out.where(F.col("n") - F.col("pos") >= F.lit(percent / (100 + percent)) * (F.col("n") + least) - 1e-6)
    side = F.when(F.col("own") == F.col("other"), 2).when(F.col("own") < F.col("other"), 0).otherwise(1)
    return out.select("value", F.least("own", "other").alias("low"), F.greatest("own", "other").alias("high"), "node", "n", "pos", side.alias("side"))


def _cross_pairs(cells: DataFrame, percent: int) -> DataFrame:
    """(a, b): pairs of a cell, of different roots, that may be similar by where their shared value lies."""
    key = ["value", "low", "high"]
    mixed_cells = cells.groupBy(*key).agg(F.min("root").alias("x"), F.max("root").alias("y"), F.count("*").alias("size")).where("x < y").select(*key, F.ceil(F.col("size") / PART).cast("int").alias("parts"))
    own = cells.join(mixed_cells, key)
    part = F.pmod(F.xxhash64("node"), F.col("parts")).cast("int")
    left, right = (own.select(*key, "parts", *(F.col(c).alias(f"{c}{x}") for c in ("node", "n", "pos", "side", "root")), part.alias(f"part{x}")) for x in "ab")
    left = left.withColumnRenamed("parta", "part")
    right = right.drop("partb").withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).drop("parts")
    # In a cell of two classes of sizes side 0 is the left one; in one of one class both are, and the least is left.
    sided = ((F.col("sidea") == 0) & (F.col("sideb") == 1)) | ((F.col("sidea") == 2) & (F.col("nodea") < F.col("nodeb")))
    shared = F.least(F.col("na") - F.col("posa"), F.col("nb") - F.col("posb")) * (100 + percent) >= (F.col("na") + F.col("nb")) * percent
    met = left.join(right, [*key, "part"]).where(sided & shared & (F.col("roota") != F.col("rootb")))
    return met.select(F.least("nodea", "nodeb").alias("a"), F.greatest("nodea", "nodeb").alias("b")).distinct()


def classes(docs: DataFrame, width: int, percent: int) -> tuple[DataFrame, DataFrame]:
    """(doc_id, th, n, node) per document of (doc_id, text); (node, root) of the classes that are linked."""
    spark = docs.sparkSession
    docs = docs.select("doc_id", F.xxhash64(F.coalesce("text", F.lit(""))).alias("th"), "text")
    made = written(docs.mapInArrow(_sketch(width, percent), "doc_id long, th long, n long, node long, need int, sketch array<long>"))
    # A class has one row for its text: that of its least text hash (all its documents' texts have the same set).
    first = made.where(F.col("n") > 0).groupBy("node").agg(F.min("th").alias("th"))
    nodes = written(made.join(first, ["node", "th"]).select("node", "th", "n", "need", "sketch").dropDuplicates(["node"]))
    values = nodes.select("node", "need", F.least(F.size("sketch"), F.lit(K)).alias("size"), F.slice("sketch", 1, K).alias("sketch")).select("node", "need", "size", F.explode("sketch").alias("value"))
    often = values.groupBy("value").agg(F.count("*").alias("df")).where("df > 1")
    met = values.join(often, "value").groupBy("node", "size", "need").agg(F.array_sort(F.collect_list(F.struct("df", "value"))).alias("met"))
    # Values met nowhere else are the rarest: they fill the first places of the size - need + 1.
    room = F.greatest(F.lit(0), F.col("size") - F.col("need") + 1 - (F.col("size") - F.size("met")))
    lists = written(met.select("node", F.explode(F.slice("met", F.lit(1), room)).alias("m")).select("node", F.col("m.value").alias("value")))
    least = lists.groupBy("value").agg(F.min("node").alias("a"), F.max("node").alias("z")).where("a < z").select("value", "a")
    pairs = lists.withColumnRenamed("node", "b").join(least, "value").where("a < b").select("a", "b").distinct()
    sketches = nodes.select("node", "n", "sketch")

    def estimated(pairs: DataFrame) -> DataFrame:
        left, right = (sketches.select(F.col("node").alias(x), F.col("n").alias(f"n{x}"), F.col("sketch").alias(f"s{x}")) for x in "ab")
        sized = F.col("na") * 100 >= F.col("nb") * percent, F.col("nb") * 100 >= F.col("na") * percent
        both = pairs.join(left, "a").join(right, "b").where(sized[0] & sized[1])
        return both.select("a", "b", "na", "nb", "sa", "sb").mapInArrow(_estimate(percent), "a long, b long, similar double")

    roots: DataFrame | None = None
    spent = [nodes, lists]

    def rooted(df: DataFrame, column: str, out: str) -> DataFrame:
        if roots is None:
            return df.withColumn(out, F.col(column))
        return df.join(roots.select(F.col("node").alias(column), F.col("root").alias(out)), column, "left").withColumn(out, F.coalesce(out, column))

    def join_up(pairs: DataFrame) -> None:
        """Verifies each b's best pair, then all pairs that still lie across components."""
        nonlocal roots
        wanted = nodes.join(pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct(), "node", "left_semi").select("node", "th")
        texts = written(only_keys(docs, wanted, "th").join(wanted, "th").select("node", "text").dropDuplicates(["node"]))
        spent.append(texts)
        ranked = written(pairs.withColumn("turn", F.row_number().over(W.partitionBy("b").orderBy(F.desc("similar"), "a"))))
        for turn in (F.col("turn") == 1, F.col("turn") > 1):
            now = rooted(rooted(ranked.where(turn), "a", "ra"), "b", "rb").where("ra <> rb").select("a", "b")
            sided = now.join(texts.select(F.col("node").alias("a"), F.col("text").alias("ta")), "a").join(texts.select(F.col("node").alias("b"), F.col("text").alias("tb")), "b")
            found = written(sided.select("a", "b", "ta", "tb").sortWithinPartitions("a").mapInArrow(_verify(width, percent), "a long, b long"))
            spent.append(found)
            if not found.isEmpty():
                before = found if roots is None else found.unionByName(roots.select(F.col("node").alias("a"), F.col("root").alias("b")))
                roots = written(components(before))
        spent.append(ranked)

    some = written(estimated(pairs))
    if not some.isEmpty():
        join_up(some)
    # The one pair of a list of two has been estimated.
    mixed_lists = rooted(lists, "node", "root").groupBy("value").agg(F.min("root").alias("x"), F.max("root").alias("y"), F.count("*").alias("size")).where("x < y AND size > 2")
    rest = written(rooted(lists.join(mixed_lists.select("value", "size"), "value"), "node", "root"))
    short = rest.where(F.col("size") <= BLOCK).select("value", "node", "root", F.lit(0).alias("cell"), F.lit(2).alias("side"))
    short = written(short.join(sketches, "node"))
    groups = max(1, short.count() // 4_000)
    by = F.pmod(F.xxhash64("value", "cell"), F.lit(groups))
    across = short.groupBy(by.alias("g")).applyInPandas(_across(percent), "a long, b long, similar double")
    more = across.groupBy("a", "b").agg(F.max("similar").alias("similar")).join(some.select("a", "b"), ["a", "b"], "left_anti")
    crowd = written(nodes.join(rest.where(F.col("size") > BLOCK).select("node").distinct(), "node", "left_semi").select("node", "th"))
    spent += [rest, short, crowd]
    cells = None
    if not crowd.isEmpty():
        whole = only_keys(docs, crowd, "th").join(crowd, "th").select("node", "text").dropDuplicates(["node"])
        tokens = written(whole.mapInArrow(_tokens(width), "node long, n long, value long"))
        cells = written(_cells(_prefixes(tokens, percent), percent))
        drop_written(tokens)
        spent.append(cells)
        hub = cells.groupBy("value", "low", "high").agg(F.min(F.struct("pos", "node")).alias("hub")).select("value", "low", "high", F.col("hub.node").alias("hub"))
        stars = cells.join(hub, ["value", "low", "high"]).where("node <> hub").select(F.least("node", "hub").alias("a"), F.greatest("node", "hub").alias("b")).distinct()
        stars = rooted(rooted(stars, "a", "ra"), "b", "rb").where("ra <> rb").select("a", "b")
        more = more.unionByName(estimated(stars)).groupBy("a", "b").agg(F.max("similar").alias("similar"))
    more = written(more)
    if not more.isEmpty():
        join_up(more)
    if cells is not None:
        last = written(estimated(_cross_pairs(rooted(cells, "node", "root"), percent)).join(more.select("a", "b"), ["a", "b"], "left_anti"))
        spent.append(last)
        if not last.isEmpty():
            join_up(last)
    if roots is None:
        roots = spark.createDataFrame([], "node long, root long")
    drop_written(*spent, some, more)
    return made.select("doc_id", "th", "n", "node"), roots


def near_duplicates(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """(doc_id, th, n_shingles, component_id, kept) for each row of `docs`; th is its text's hash."""
    made, roots = classes(docs, width, percent)
    rooted = made.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    named = rooted.where("n > 0").groupBy("root").agg(F.min("doc_id").alias("component_id"))
    out = rooted.join(named, "root", "left").withColumn("component_id", F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id")))
    return out.select("doc_id", "th", F.col("n").alias("n_shingles"), "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))


def op3_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"), width=4).drop("th")


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pipeline's near-dedup: of each component the document of the least doc_id stays, and every empty one.

    Rows that repeat both doc_id and text stay once; a null doc_id among others is never the least.
    """
    use_package(spark)
    found = written(near_duplicates(docs.select("doc_id", "text")))
    th = F.xxhash64(F.coalesce("text", F.lit(""))).alias("memlake_th")
    keyed = docs.select("*", th)
    gone = found.where(~F.col("kept")).select(F.col("doc_id").alias("memlake_id"), F.col("th").alias("memlake_th")).distinct()
    same = (keyed["memlake_th"] == gone["memlake_th"]) & keyed["doc_id"].eqNullSafe(gone["memlake_id"])
    left = keyed.join(gone, same, "left_anti")
    again = found.where(F.col("kept") & (F.col("n_shingles") > 0)).groupBy("doc_id", "component_id").agg(F.count("*").alias("rows")).where("rows > 1")
    if not again.isEmpty():
        ids = again.select(F.col("doc_id").alias("memlake_id")).distinct()
        repeated = left.join(ids, left["doc_id"].eqNullSafe(ids["memlake_id"]), "left_semi")
        left = left.join(ids, left["doc_id"].eqNullSafe(ids["memlake_id"]), "left_anti").unionByName(repeated.dropDuplicates(["doc_id", "memlake_th"]))
    return left.drop("memlake_th")
