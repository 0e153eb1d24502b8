"""Toxicity by subword bags: n-gram embeddings averaged into a linear softmax, both trained jointly in numpy.

A word is the mean of the vectors of its character n-grams (hashed, with marks for its ends) and of itself, a window of
WINDOW words is the mean of its words, and a softmax over two classes scores it; a spelling never seen still shares most
n-grams with one that was.  A document scores as its most toxic window, so a few words count alike in short and long
texts.  Training first gives windows their documents' labels, then (multiple-instance learning) looks at the window of
each document that the model itself finds most toxic.

Labels are learnt from a bounded sample: at most TOXIC toxic and CLEAN clean labelled ids of those allowed, chosen by a
hash of doc_id.  Of a text over LONGEST characters training sees PARTS stretches of together as many, spread evenly.
Scoring needs no shuffle and reads whole texts, long ones piece by piece; the model sent to the workers is one float per
n-gram bucket.  Null or empty texts, and those without words, get the bias alone.  Without labels of both classes every
score is 0.  Null labels are ignored; a doc_id with both labels counts once with each, its rows count as the one of the
least text.  Row count, repeated rows and null ids are kept; bytes that aren't UTF-8 count as U+FFFD.
"""

from __future__ import annotations

import functools
import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from memlake.llm.common import table, texts, use_package

BUCKETS, WIDTH, WINDOW = 1 << 17, 8, 5
SHORTEST_GRAM, LONGEST_GRAM, RARE = 3, 6, 5
TOXIC, CLEAN, LONGEST, PARTS = 1000, 2000, 8_000, 8
#: Longer texts are scored in pieces of about this many characters, cut at white space.
PIECE = 1 << 18
THRESHOLD = 0.7


@functools.cache
def _word() -> np.ndarray:
    """Whether a code point is a word's."""
    return np.fromiter((c.isalnum() or c in "@$*'_" for c in map(chr, range(0x110000))), bool)


_POWERS = np.array([pow(0x9E3779B1, k, 1 << 32) for k in range(1, 65)], np.uint32)


class Words:
    """The words of a text and, hashed, their n-grams; every step is one over arrays of all characters.

    Words are runs of letters, digits and @$*'_ in lower case; "<" and ">" mark their ends.
    """

    def __init__(self, text: str | None):
        codes = np.frombuffer((text or "").lower().encode("utf-32-le", "replace"), np.uint32)
        word = _word()[codes]
        starts = np.flatnonzero(word & ~np.concatenate([[False], word[:-1]])) if len(word) else np.zeros(0, np.int64)
        ends = np.flatnonzero(word & ~np.concatenate([word[1:], [False]])) + 1 if len(word) else starts
        self.n, self.widths = len(starts), ends - starts + 2
        self.ends = np.cumsum(self.widths)
        self.starts = self.ends - self.widths
        self.of = np.repeat(np.arange(self.n), self.widths)
        self.marked = np.full(len(self.of), ord("<"), np.uint32)
        self.marked[self.ends - 1] = ord(">")
        inner = np.ones(len(self.of), bool)
        inner[self.starts] = inner[self.ends - 1] = False
        self.marked[inner] = codes[word]

    def whole(self) -> np.ndarray:
        place = np.minimum(np.arange(len(self.of)) - self.starts[self.of], 63)
        return _bucket(np.add.reduceat(self.marked * _POWERS[place], self.starts) ^ np.uint32(0x5BD1E995))

    def grams(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Where in `marked` n-grams begin, and their buckets."""
        at = np.flatnonzero(np.arange(len(self.of)) + n <= self.ends[self.of])
        h = np.full(len(at), n, np.uint32)
        for k in range(n):
            h += self.marked[at + k] * _POWERS[k]
        return at, _bucket(h)

    def mean(self, weights: np.ndarray) -> np.ndarray:
        """The mean weight of each word's n-grams and of itself."""
        if not self.n:
            return np.zeros(0)
        total, count = weights[self.whole()].astype(np.float64), np.ones(self.n)
        for n in range(SHORTEST_GRAM, LONGEST_GRAM + 1):
            at, buckets = self.grams(n)
            of = self.of[at]
            total += np.bincount(of, weights[buckets], self.n)
            count += np.maximum(self.widths - n + 1, 0)
        return total / count

    def lists(self) -> tuple[np.ndarray, np.ndarray]:
        """All buckets, word by word, and how many each word has."""
        made = [(self.of[at], buckets) for at, buckets in map(self.grams, range(SHORTEST_GRAM, LONGEST_GRAM + 1))]
        of = np.concatenate([np.arange(self.n), *(o for o, _ in made)])
        buckets = np.concatenate([self.whole(), *(x for _, x in made)])
        return buckets[np.argsort(of, kind="stable")].astype(np.int32), np.bincount(of, minlength=self.n)

    def keys(self) -> np.ndarray:
        """64 bits for each word's spelling."""
        if not self.n:
            return np.zeros(0, np.uint64)
        place = np.arange(len(self.of)) - self.starts[self.of]
        mixed = (self.marked.astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15)) * (place.astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F) + np.uint64(0x165667B19E3779F9))
        return np.add.reduceat(mixed ^ (mixed >> np.uint64(29)), self.starts)


def _bucket(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint32(15))) * np.uint32(0x85EBCA6B)
    return (h ^ (h >> np.uint32(13))) & np.uint32(BUCKETS - 1)


@dataclass
class Model:
    """The logit of a word is the mean of `weights` over its n-grams; that of a window the mean of its words and `bias`."""

    weights: np.ndarray
    bias: float

    def score(self, text: str | None) -> float:
        """The chance that a text is toxic: that of its most toxic window."""
        if self.weights.size == 0:
            return 0.0
        logits = np.concatenate([Words(x).mean(self.weights) for x in pieces(text or "")])
        best = _windows(logits).max() if len(logits) else 0.0
        return float(1 / (1 + np.exp(-np.clip(best + self.bias, -500, 500))))


def pieces(text: str) -> list[str]:
    """A text cut at white space, so that no word is."""
    out, begin = [], 0
    while m := re.compile(r"\s").search(text, begin + PIECE):
        out.append(text[begin : m.start()])
        begin = m.start()
    return [*out, text[begin:]]


def _windows(x: np.ndarray) -> np.ndarray:
    """Means of all runs of WINDOW values (of all values, if fewer)."""
    n = min(len(x), WINDOW)
    sums = np.concatenate([[0.0], np.cumsum(x, dtype=np.float64)])
    return (sums[n:] - sums[:-n]) / n


def train(texts: list[str], toxic: list[int], warm: int = 20, steps: int = 110, rate: float = 0.03, decay: float = 2e-5, seed: int = 0) -> Model:
    """Adam on the embeddings, the softmax and its bias, with L2 decay; n-grams of fewer than RARE texts stay at 0."""
    if len(set(toxic)) < 2:
        return Model(np.zeros(0, np.float32), 0.0)
    # Words of one text at a time are held, in two passes: keys of all words, then n-grams of each word's first occurrence.
    keys = [Words(t).keys() for t in texts]
    used = [i for i, k in enumerate(keys) if len(k)]
    y = np.array([int(toxic[i]) for i in used])
    if len(set(y.tolist())) < 2:
        return Model(np.zeros(0, np.float32), 0.0)
    sizes = np.array([len(keys[i]) for i in used])
    bounds = np.cumsum(sizes)[:-1]
    _, where, ids = np.unique(np.concatenate(keys), return_index=True, return_inverse=True)
    del keys
    is_first = np.zeros(len(ids), bool)
    is_first[where] = True
    parts, sizes_of = [], []
    for i, new in zip(used, np.split(is_first, bounds), strict=True):
        flat, count = Words(texts[i]).lists()
        parts.append(flat[np.repeat(new, count)])
        sizes_of.append(count[new])
    # The lists stand in the order of first occurrence; `rank` takes a word's id there.
    rank = np.empty(len(where), np.int32)
    rank[np.argsort(where)] = np.arange(len(where), dtype=np.int32)
    docs = np.split(rank[ids], bounds)
    flat, counts = np.concatenate(parts), np.concatenate(sizes_of)
    del parts, sizes_of, ids, where, is_first
    ends = np.cumsum(counts)
    starts = ends - counts
    texts_of = np.zeros(BUCKETS, np.int64)
    for d in docs:
        texts_of[np.unique(np.concatenate([flat[starts[w] : ends[w]] for w in np.unique(d)]))] += 1
    known = texts_of >= RARE
    rng = np.random.default_rng(seed)
    e, u, b = (rng.normal(0, 0.05, (BUCKETS, WIDTH)) * known[:, None]).astype(np.float32), rng.normal(0, 0.5, (WIDTH, 2)).astype(np.float32), np.zeros(2, np.float32)
    state = [[np.zeros_like(p), np.zeros_like(p)] for p in (e, u, b)]
    per_class = len(y) / (2 * np.bincount(y, minlength=2))

    def at_random(n: int):
        for i in range(len(docs)):
            for at in rng.integers(0, max(1, sizes[i] - WINDOW + 1), n):
                yield docs[i][at : at + WINDOW], i, 1 / n

    def most_toxic():
        logit = np.add.reduceat((e @ (u[:, 1] - u[:, 0]))[flat], starts) / counts
        for i, d in enumerate(docs):
            means = _windows(logit[d])
            at = int(np.argmax(means))
            yield d[at : at + WINDOW], i, 1.0

    for step in range(warm + steps):
        chosen = list(at_random(4)) if step < warm else [*most_toxic(), *((w, i, 0.2) for w, i, _ in at_random(1) if y[i] == 0)]
        lengths = np.array([len(w) for w, _, _ in chosen])
        ids, which = np.unique(np.concatenate([w for w, _, _ in chosen]), return_inverse=True)
        own = counts[ids]
        cells = np.repeat(starts[ids] - np.concatenate([[0], np.cumsum(own)[:-1]]), own) + np.arange(own.sum())
        buckets, word_starts = flat[cells], np.concatenate([[0], np.cumsum(own)[:-1]])
        vectors = np.add.reduceat(e[buckets], word_starts, axis=0) / own[:, None]
        first = np.concatenate([[0], np.cumsum(lengths)[:-1]])
        label = y[[i for _, i, _ in chosen]]
        weight = np.array([x for _, _, x in chosen]) * per_class[label]
        weight /= weight.sum()
        mean = np.add.reduceat(vectors[which], first, axis=0) / lengths[:, None]
        z = mean @ u + b
        p = np.exp(z - z.max(1, keepdims=True))
        p /= p.sum(1, keepdims=True)
        dz = (p - np.eye(2, dtype=np.float32)[label]) * weight[:, None]
        dword = np.repeat((dz @ u.T) / lengths[:, None], lengths, axis=0)
        dvector = np.stack([np.bincount(which, dword[:, k], len(ids)) for k in range(WIDTH)], 1) / own[:, None]
        de = np.stack([np.bincount(buckets, np.repeat(dvector[:, k], own), BUCKETS) for k in range(WIDTH)], 1) * known[:, None] + decay * e
        for value, grad, (m, v) in zip((e, u, b), (de, mean.T @ dz + decay * u, dz.sum(0)), state, strict=True):
            m += 0.1 * (grad - m)
            v += 0.01 * (grad**2 - v)
            value -= rate * (m / (1 - 0.9 ** (step + 1))) / (np.sqrt(v / (1 - 0.99 ** (step + 1))) + 1e-8)
    return Model((e @ (u[:, 1] - u[:, 0])).astype(np.float32), float(b[1] - b[0]))


def held_out(doc_id: str = "doc_id") -> Column:
    """Rows that no model learns from; a null id is held out."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 3 == 1, F.lit(True))


def _seen() -> Column:
    """What training sees of a text."""
    step, n = LONGEST // PARTS, F.length("text")
    parts = [F.substring(F.col("text"), F.floor((n - step) * i / (PARTS - 1)).cast("int") + 1, F.lit(step)) for i in range(PARTS)]
    return F.when(n <= LONGEST, F.col("text")).otherwise(F.concat_ws(" ", *parts))


def fit(docs: DataFrame, labels: DataFrame) -> Model:
    marked = labels.where(F.col("toxic").isin(0, 1)).select("doc_id", F.col("toxic").cast("int").alias("toxic"))
    usable = docs.select("doc_id").join(marked, "doc_id").where(~held_out())
    chosen = [tuple(r) for y, n in ((1, TOXIC), (0, CLEAN)) for r in usable.where(F.col("toxic") == y).distinct().orderBy(F.xxhash64("doc_id"), "doc_id").take(n)]
    if not chosen:
        return train([], [])
    few = docs.sparkSession.createDataFrame(chosen, "doc_id long, toxic int")  # at most TOXIC + CLEAN rows
    seen = docs.select("doc_id", _seen().alias("text")).join(F.broadcast(few), "doc_id").groupBy("doc_id", "toxic").agg(F.min("text").alias("text"))
    rows = sorted(seen.collect(), key=lambda r: (r["doc_id"], r["toxic"]))  # one row of at most LONGEST characters for each label chosen
    return train([r["text"] for r in rows], [r["toxic"] for r in rows])


def score(docs: DataFrame, model: Model, text: str = "text", out: str = "score") -> DataFrame:
    """`docs` with the column `out`, replaced if there is one."""
    kept = [f for f in docs.schema.fields if f.name != out]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept) + f", `{out}` double"

    def run(batches):
        for b in batches:
            scores = pa.array([model.score(t) for t in texts(b.column(b.schema.get_field_index(text)))], pa.float64())
            names = [f.name for f in kept]
            yield pa.RecordBatch.from_arrays([b.column(b.schema.get_field_index(n)) for n in names] + [scores], names=[*names, out])

    return docs.mapInArrow(run, schema)


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = score(docs, fit(docs, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pipeline's filter: documents predicted toxic go."""
    use_package(spark)
    name = "memlake_score"
    return score(docs, fit(docs, table(spark, sf_dir, "labels")), out=name).where(F.col(name) < THRESHOLD).drop(name)
