"""Suffix-array dedup: removes every byte covered by a string of LENGTH bytes that also starts earlier.

1. Documents are laid end to end into shards of SHARD bytes.  Each has a suffix array by Larsson-Sadakane refinement (7
   bytes or more first, then doubling, sorting only groups not yet told apart) and Kasai's common prefixes along the text, over
   many stretches side by side.  Windows of LENGTH bytes after the first of a group with a common prefix of LENGTH are
   repeats within the shard.
2. Across shards only first windows can meet.  Each has an anchor: the least hash among its GRAM-byte grams (winnowing),
   which equal windows share.  A unit is a run of first windows of one anchor.  Units whose anchor is in one shard only
   end here; of units of equal bytes (a variant) the first stays, all windows of the others are repeats.
3. First units of anchors with several variants are merged: groups of bounded size by anchor, whose windows one array
   puts in order; an anchor of more bytes than a shard is cut into blocks with an array each, and each pair of blocks is
   merged by binary search of one's windows in the other's.

"Earlier" is a smaller doc_id (null before all), or in one document an earlier start; different texts of one doc_id
are ordered by a hash, rows equal in both are one document and treated alike.  Strings are judged on the input, so
overlaps count; matches never cross documents.  Null text is empty; texts under LENGTH bytes keep everything.  Texts
longer than a shard are cut into pieces that overlap by LENGTH - 1 bytes, so no window is lost and none is twice in one.
Equal bytes are told by the arrays, or for whole units of one anchor by 64 bits of another hash.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from memlake.llm.common import drop_written, only_keys, raw_texts, row_key, table, unique_rows, written
from memlake.llm.neardup import mixed

LENGTH, GRAM = 100, 24  # GRAM: a multiple of 8
SHARD = 1 << 19  # bytes
_A = np.uint64(0x9E3779B97F4A7C15)


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    m, w = x, 1
    while w * 2 <= width:
        m, w = np.minimum(m[: len(m) - w], m[w:]), w * 2
    return np.minimum(m[: len(m) - (width - w)], m[width - w :]) if w < width else m


def anchors(raw: np.ndarray) -> np.ndarray:
    """The anchor of each window of LENGTH bytes."""
    words = np.ndarray((len(raw) - 7,), "<u8", np.ascontiguousarray(raw), strides=(1,))
    n, grams = len(raw) - GRAM + 1, np.uint64(GRAM)
    for k in range(0, GRAM, 8):
        grams = (grams ^ words[k : k + n]) * _A
        grams ^= grams >> np.uint64(29)
    return sliding_min(mixed(grams), LENGTH - GRAM + 1)


def suffix_array(text: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """Suffixes of bytes in order; the places in it that share h bytes with a neighbour, whether with the one before, and
    h, the depth of the last round within LENGTH.  The first sort takes as many bytes as their codes fit 63 bits."""
    n = len(text)
    code = np.cumsum(np.bincount(text, minlength=256) > 0).astype(np.uint64)
    bits = int(code[-1]).bit_length()
    h, key = 63 // bits, np.zeros(n, np.uint64)
    padded = np.zeros(n + h, np.uint64)
    padded[:n] = code[text]
    for k in range(h):
        key <<= np.uint64(bits)
        key |= padded[k : k + n]
    sa = np.argsort(key)
    key = key[sa]
    new = np.ones(n, bool)
    np.not_equal(key[1:], key[:-1], out=new[1:])
    rank = np.empty(n, np.int64)
    first = np.maximum.accumulate(np.where(new, np.arange(n), 0))
    rank[sa] = first
    at = np.arange(n)
    while True:
        tied = ~(new & np.append(new[1:], True))  # places in groups of more than one
        at, first, new = at[tied], first[tied], new[tied]
        if h <= LENGTH:
            half, again, known = at, ~new, h
        if not len(at):
            return sa, half, again, known
        who = sa[at]
        then = np.where(who + h < n, rank[np.minimum(who + h, n - 1)] + 1, 0)
        key = (first.astype(np.uint64) << np.uint64(32)) | then.astype(np.uint64)
        order = np.argsort(key)
        key, who = key[order], who[order]
        sa[at] = who
        new = np.ones(len(who), bool)
        np.not_equal(key[1:], key[:-1], out=new[1:])
        first = np.maximum.accumulate(np.where(new, at, 0))
        rank[who] = first
        h *= 2


def common_prefixes(text: np.ndarray, sa: np.ndarray, places: np.ndarray, known: int = 0, most: int = LENGTH) -> np.ndarray:
    """Kasai: the common prefix, up to `most`, of suffixes sa[i - 1] and sa[i] for each of the places, `known` or more.

    Stretches of neighbouring text positions go side by side; within one each position starts from the last one's
    prefix less one.
    """
    if not len(places):
        return np.zeros(0, np.int64)
    step, order = 64, np.argsort(sa[places])
    p, q = sa[places][order], sa[places - 1][order]
    runs = np.flatnonzero(np.concatenate([[True], np.diff(p) != 1]))
    sizes = np.diff(np.append(runs, len(p)))
    parts = -(-sizes // step)
    nth = np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts)
    lanes, left = np.repeat(runs, parts) + nth * step, np.minimum(np.repeat(sizes, parts) - nth * step, step)
    by_size = np.argsort(-left, kind="stable")
    lanes, left = lanes[by_size], left[by_size]
    # Of two positions the later one meets the end first, where no byte equals the symbol.
    padded = np.concatenate([text.astype(np.int16), np.full(most + 1, -1, np.int16)])
    lcp = np.empty(len(p), np.int64)
    h = np.zeros(len(lanes), np.int64)
    for j in range(int(left[0])):
        live = int(np.searchsorted(-left, -j, "left"))  # lanes of more than j positions
        at = lanes[:live] + j
        x, y, h = p[at], q[at], np.maximum(h[:live] - 1, known)
        go = np.arange(live)
        while len(go):
            u = h[go]
            go = go[(u < most) & (padded[x[go] + u] == padded[y[go] + u])]
            h[go] += 1
        lcp[at] = h
    out = np.empty(len(p), np.int64)
    out[order] = lcp
    return out


class Shard:
    """Pieces of texts end to end in their order: row i begins at begins[i] and has windows at its first count[i] bytes."""

    def __init__(self, raw: list[bytes], order: np.ndarray, rid: np.ndarray, start: np.ndarray, count: np.ndarray):
        sizes = np.array([len(x) for x in raw], np.int64)
        self.begins = np.cumsum(sizes) - sizes
        self.ord, self.rid, self.start, self.count = order, rid, start, count
        self.text = np.frombuffer(b"".join(raw), np.uint8)
        self.row = np.repeat(np.arange(len(raw)), sizes)
        self.window = np.arange(len(self.text)) - self.begins[self.row] < count[self.row]

    def groups(self) -> tuple[np.ndarray, np.ndarray]:
        """Windows in the order of the suffix array, and which of them begin a group of equal ones."""
        if not len(self.text):
            return np.zeros(0, np.int64), np.zeros(0, bool)
        sa, half, again, known = suffix_array(self.text)
        head = np.ones(len(sa), bool)
        head[half[again]] = common_prefixes(self.text, sa, half[again], known) < LENGTH
        keep = self.window[sa]
        group = np.cumsum(head)[keep]
        return sa[keep], np.concatenate([[True], group[1:] != group[:-1]]) if len(group) else np.zeros(0, bool)

    def repeats(self) -> np.ndarray:
        """For each byte whether it begins a window that also begins earlier."""
        out = np.zeros(len(self.text), bool)
        if len(self.text):
            sa, half, again, known = suffix_array(self.text)
            head = ~again
            head[again] = common_prefixes(self.text, sa, half[again], known) < LENGTH
            at, group = sa[half], np.cumsum(head)
            keep = self.window[at]
            at, group = at[keep], group[keep]
            if len(at):
                out[at] = True
                out[np.minimum.reduceat(at, np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]])))] = False
        return out

    def places(self, at: np.ndarray) -> tuple[np.ndarray, ...]:
        """Runs of windows (positions in `text`, in order) as ord, rid, start and count."""
        row = self.row[at]
        new = np.concatenate([[True], (np.diff(at) != 1) | (np.diff(row) != 0)]) if len(at) else np.zeros(0, bool)
        first, row = at[new], row[new]
        return self.ord[row], self.rid[row], (self.start[row] + first - self.begins[row]).astype(np.int32), np.diff(np.append(np.flatnonzero(new), len(at))).astype(np.int32)

    def order_of(self, at: np.ndarray) -> list[tuple]:
        row = self.row[at]
        return list(zip(self.ord[row].tolist(), self.rid[row].tolist(), (self.start[row] + at - self.begins[row]).tolist(), strict=True))


# -- 1, 2: shards of documents

RUN = "ord long, rid long, start int, count int"
UNIT = f"anchor long, variant long, shard long, {RUN}"


def _laid(batches, shard: int):
    """(ord, rid, text) to lists of pieces (ord, rid, start, bytes) of together about `shard` bytes."""
    held, size = [], 0
    for b in batches:
        for order, rid, raw in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), raw_texts(b.column(2)), strict=True):
            for start in range(0, len(raw) - LENGTH + 1, shard):
                part = raw[start : start + shard + LENGTH - 1]
                if size and size + len(part) > shard:
                    yield held
                    held, size = [], 0
                held.append((order, rid, start, part))
                size += len(part)
    if held:
        yield held


def _arrays(shard: int):
    """Rows of UNIT: units of first windows, and, without an anchor, the repeats within a shard."""

    def run(batches):
        partition = TaskContext.get().partitionId() if TaskContext.get() else 0
        for k, held in enumerate(_laid(batches, shard)):
            held.sort(key=lambda x: x[:3])
            order, rid, start, raw = zip(*held, strict=True)
            s = Shard(list(raw), np.array(order, np.int64), np.array(rid, np.int64), np.array(start, np.int64), np.array([len(x) - LENGTH + 1 for x in raw]))
            again = s.repeats()
            found = s.places(np.flatnonzero(again))
            anchor = np.zeros(len(s.text), np.uint64)
            for begin, x in zip(s.begins.tolist(), raw, strict=True):
                anchor[begin : begin + len(x) - LENGTH + 1] = anchors(np.frombuffer(x, np.uint8))
            first = np.flatnonzero(s.window & ~again)
            new = np.concatenate([[True], (np.diff(first) != 1) | (np.diff(s.row[first]) != 0) | (anchor[first][1:] != anchor[first][:-1])]) if len(first) else np.zeros(0, bool)
            begins, counts = first[new], np.diff(np.append(np.flatnonzero(new), len(first)))
            row, view = s.row[begins], memoryview(s.text)
            same = np.array([xxhash.xxh3_64_intdigest(view[a : a + c + LENGTH - 1]) for a, c in zip(begins.tolist(), counts.tolist(), strict=True)], np.uint64)
            n, m = len(begins), len(found[0])
            nulls = lambda x: pa.concat_arrays([pa.array(x), pa.nulls(m, pa.int64())])
            own = (s.ord[row], s.rid[row], (s.start[row] + begins - s.begins[row]).astype(np.int32), counts.astype(np.int32))
            columns = [nulls(anchor[begins].view(np.int64)), nulls(same.view(np.int64)), pa.array(np.full(n + m, (partition << 32) + k))]
            columns += [pa.array(np.concatenate([a, b])) for a, b in zip(own, found, strict=True)]
            yield pa.RecordBatch.from_arrays(columns, names=["anchor", "variant", "shard", "ord", "rid", "start", "count"])

    return run


# -- 3: merging


def _shard_of(rows: pd.DataFrame) -> Shard:
    rows = rows.drop_duplicates(["ord", "rid", "start"]).sort_values(["ord", "rid", "start"], kind="stable")
    return Shard(rows["bytes"].to_list(), *(rows[x].to_numpy(np.int64) for x in ("ord", "rid", "start", "count")))


def between(left: Shard, right: Shard) -> list[tuple]:
    """Windows of the one that equal an earlier one of the other: groups of `right`, by binary search among `left`'s.

    Later windows on the side of the first one are repeats within that side, which its own array finds.
    """
    sides = []
    for s in (left, right):
        sa, head = s.groups()
        heads = np.flatnonzero(head)
        texts = np.ascontiguousarray(s.text[sa[heads][:, None] + np.arange(LENGTH)]).view(f"S{LENGTH}").ravel()
        sides.append((s, sa, heads, np.diff(np.append(heads, len(sa))), texts, np.minimum.reduceat(sa, heads) if len(sa) else sa))
    (a, sa, ha, ca, ta, la), (b, sb, hb, cb, tb, lb) = sides
    at = np.minimum(np.searchsorted(ta, tb), max(len(ta) - 1, 0))
    out = []
    for j in np.flatnonzero(ta[at] == tb) if len(ta) else []:
        i = at[j]
        (x,), (y,) = a.order_of(la[[i]]), b.order_of(lb[[j]])
        late, sx, lo, n, first = (b, sb, hb[j], cb[j], x) if x < y else (a, sa, ha[i], ca[i], y)
        members = np.sort(sx[lo : lo + n])
        out.append(late.places(members[[o > first for o in late.order_of(members)]]))
    return out


def _merge(rows: pd.DataFrame) -> pd.DataFrame:
    low, high = int(rows["low"].iloc[0]), int(rows["high"].iloc[0])
    if low == high:
        s = _shard_of(rows)
        found = [s.places(np.flatnonzero(s.repeats()))]
    else:
        found = between(_shard_of(rows[rows["block"] == low]), _shard_of(rows[rows["block"] == high]))
    columns = zip(*found, strict=True) if found else ([np.zeros(0, np.int64)],) * 4
    made = pd.DataFrame(dict(zip(("ord", "rid", "start", "count"), map(np.concatenate, columns), strict=True)))
    return made.astype({"ord": "int64", "rid": "int64", "start": "int32", "count": "int32"})


def _cut(batches):
    """(ord, rid, text, wanted units) to a row for each unit with its bytes."""
    for b in batches:
        for order, rid, raw, wanted in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), raw_texts(b.column(2)), b.column(3).to_pylist(), strict=True):
            rows = [(u["anchor"], order, rid, u["start"], u["count"], raw[u["start"] : u["start"] + u["count"] + LENGTH - 1]) for u in wanted]
            columns = [pa.array(c, k) for c, k in zip(zip(*rows, strict=True), (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary()), strict=True)]
            yield pa.RecordBatch.from_arrays(columns, names=["anchor", "ord", "rid", "start", "count", "bytes"])


def repeats(docs: DataFrame, shard: int = SHARD) -> DataFrame:
    """(ord, rid, start, count) of runs of windows that start earlier too; `docs` has (ord, rid, text), rows all different."""
    made = written(docs.select("ord", "rid", "text").mapInArrow(_arrays(shard), UNIT))
    inside = written(made.where("anchor IS NULL").select("ord", "rid", "start", "count"))
    again = made.where("anchor IS NOT NULL").groupBy("anchor").agg(F.min("shard").alias("x"), F.max("shard").alias("y")).where("x < y").select("anchor")
    met = written(made.join(again, "anchor", "left_semi").drop("shard"))
    drop_written(made)
    variants = written(met.groupBy("anchor", "variant").agg(F.min(F.struct("ord", "rid", "start")).alias("first"), F.max("count").alias("count"), F.count("*").alias("n")))
    first = variants.where("n > 1").select("anchor", "variant", "first")
    later = met.join(first, ["anchor", "variant"]).where(F.struct("ord", "rid", "start") != F.col("first")).select("ord", "rid", "start", "count")
    contested = variants.groupBy("anchor").agg(F.count("*").alias("variants")).where("variants > 1").select("anchor")
    hard = written(variants.join(contested, "anchor", "left_semi").select("anchor", "first.ord", "first.rid", "first.start", "count"))
    by_doc = hard.groupBy("ord", "rid").agg(F.collect_list(F.struct("anchor", "start", "count")).alias("wanted"))
    cut = written(only_keys(docs.select("ord", "rid", "text"), hard, "rid").join(by_doc, ["ord", "rid"]).select("ord", "rid", "text", "wanted").mapInArrow(_cut, f"anchor long, {RUN}, bytes binary"))
    sizes = cut.groupBy("anchor").agg(F.sum(F.octet_length("bytes")).alias("size"))
    total = sizes.agg(F.sum("size")).first()[0] or 0
    shards = max(1, 2 * total // shard)
    sized = cut.join(sizes, "anchor")
    blocks = F.ceil(F.col("size") / shard).cast("int")
    small = sized.where(F.col("size") <= shard).select("ord", "rid", "start", "count", "bytes", F.pmod(F.xxhash64("anchor"), F.lit(shards)).alias("key"), *(F.lit(0).alias(x) for x in ("block", "low", "high")))
    big = sized.where(F.col("size") > shard).withColumn("block", F.pmod(F.xxhash64("ord", "rid", "start"), blocks).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), blocks - 1)))
    big = big.select("ord", "rid", "start", "count", "bytes", F.col("anchor").alias("key"), "block", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"))
    kinds = [df.withColumn("kind", F.lit(i)) for i, df in enumerate((small, big))]
    merged = kinds[0].unionByName(kinds[1]).groupBy("kind", "key", "low", "high").applyInPandas(_merge, RUN)
    found = written(inside.unionByName(later).unionByName(merged))
    drop_written(inside, met, variants, hard, cut)
    return found


def kept_spans(n: int, runs: list, length: int = LENGTH) -> tuple[list[tuple[int, int]], int]:
    """Spans of n bytes that stay, and the number of maximal removed ones, from runs of windows (start, count)."""
    kept, at, removed, end = [], 0, 0, -1
    for start, count in sorted(runs):
        if start > end:
            removed += 1
            if start > at:
                kept.append((at, start))
        end = max(end, start + count + length - 1)
        at = end
    if at < n:
        kept.append((at, n))
    return kept, removed


def _digest(batches):
    for b in batches:
        ids, runs = b.column(0), b.column(2)
        rows = []
        for raw, found in zip(raw_texts(b.column(1)), runs.to_pylist(), strict=True):
            kept, removed = kept_spans(len(raw), [(r["start"], r["count"]) for r in found or []])
            left = b"".join(raw[s:e] for s, e in kept)
            rows.append((len(raw), len(raw) - len(left), removed, hashlib.sha256(left).hexdigest()))
        n, gone, spans, sha = zip(*rows, strict=True) if rows else ((), (), (), ())
        yield pa.RecordBatch.from_arrays([ids, pa.array(n, pa.int64()), pa.array(gone, pa.int64()), pa.array(spans, pa.int64()), pa.array(sha, pa.string())], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])


def keyed(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", "text", F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63))).alias("ord"), row_key().alias("rid"))


def deduplicated(docs: DataFrame, shard: int = SHARD) -> DataFrame:
    """(doc_id, text, runs): each document with the runs of windows to remove, for `kept_spans`."""
    docs = keyed(docs.select("doc_id", "text"))
    runs = repeats(unique_rows(docs.select("ord", "rid", "text"), "ord", "rid"), shard).groupBy("ord", "rid").agg(F.collect_list(F.struct("start", "count")).alias("runs"))
    return docs.join(runs, ["ord", "rid"], "left").select("doc_id", "text", "runs")


def op7_suffix_array(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return deduplicated(docs).mapInArrow(_digest, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


ORACLE = f"""
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
w AS (SELECT doc_id, i, md5(substr(h, 2 * i + 1, {2 * LENGTH})) AS x FROM (SELECT doc_id, h, unnest(range(0, length(h) // 2 - {LENGTH - 1})) AS i FROM d)),
f AS (SELECT x, min((doc_id, i)) AS first FROM w GROUP BY x HAVING count(*) > 1),
g AS (SELECT doc_id, i FROM w JOIN f USING (x) WHERE (doc_id, i) <> first),
n AS (SELECT doc_id, i, CASE WHEN i > lag(i) OVER (PARTITION BY doc_id ORDER BY i) + {LENGTH} THEN 1 ELSE 0 END AS fresh FROM g),
s AS (SELECT doc_id, min(i) AS a, max(i) + {LENGTH} AS b FROM (SELECT doc_id, i, sum(fresh) OVER (PARTITION BY doc_id ORDER BY i) AS k FROM n) GROUP BY doc_id, k),
e AS (SELECT doc_id, list(a ORDER BY a) AS a, list(b ORDER BY a) AS b, sum(b - a) AS gone FROM s GROUP BY doc_id)
SELECT doc_id, length(h) // 2 AS n_bytes, CAST(coalesce(gone, 0) AS BIGINT) AS n_removed, coalesce(len(a), 0) AS n_spans,
  sha256(unhex(CASE WHEN a IS NULL THEN h ELSE array_to_string(list_transform(range(0, len(a) + 1), lambda k:
    substr(h, 2 * (CASE WHEN k = 0 THEN 0 ELSE b[k] END) + 1, 2 * ((CASE WHEN k = len(a) THEN length(h) // 2 ELSE a[k + 1] END) - (CASE WHEN k = 0 THEN 0 ELSE b[k] END)))), '') END)) AS kept_sha256
FROM d LEFT JOIN e USING (doc_id)
"""
