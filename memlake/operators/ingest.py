"""Ingestion: change detection, chunking, exact dedup, versioned tables and the order-dependent category fold."""

from __future__ import annotations

import ast
import json
import re

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from memlake.functions.text import chunk_id, skip_reason, text_hash
from memlake.operators.dense import use_package


def current(df: DataFrame, keys: list[str], version: list[Column]) -> DataFrame:
    """The latest version of each key of an append-only table."""
    rank = F.row_number().over(W.partitionBy(*keys).orderBy(*[c.desc() for c in version]))
    return df.withColumn("memlake_rank", rank).where("memlake_rank = 1").drop("memlake_rank")


def first_written(df: DataFrame, keys: list[str], version: list[Column]) -> DataFrame:
    """Insert-or-ignore: the first version of each key."""
    rank = F.row_number().over(W.partitionBy(*keys).orderBy(*version))
    return df.withColumn("memlake_rank", rank).where("memlake_rank = 1").drop("memlake_rank")


def merged(df: DataFrame, keys: list[str], version: str, keep_first: list[str], keep_last: list[str]) -> DataFrame:
    """An upsert that overwrites some columns only."""
    return df.groupBy(*keys).agg(*(F.min_by(c, version).alias(c) for c in keep_first), *(F.max_by(c, version).alias(c) for c in keep_last))


def source_state(incoming: DataFrame, stored: DataFrame) -> DataFrame:
    """new, changed or unchanged by content hash; without one a source is always new."""
    old = stored.select("source_id", F.col("content_hash").alias("memlake_old"))
    state = F.when(F.coalesce(F.col("content_hash"), F.lit("")) == "", "new").when(F.col("memlake_old").isNull(), "new").when(F.col("memlake_old") == F.col("content_hash"), "unchanged").otherwise("changed")
    return incoming.join(old, "source_id", "left").withColumn("state", state).drop("memlake_old")


def exact_dedup(existing: DataFrame, incoming: DataFrame, order: list[str]) -> DataFrame:
    """All rows with `canonical_id`, the first chunk of one text in one workspace, and whether they are it.

    The first is found by an aggregate, so a text in a third of all rows is combined before the shuffle.
    """
    rows = existing.withColumn("is_new", F.lit(0)).unionByName(incoming.withColumn("is_new", F.lit(1)))
    first = rows.groupBy("workspace_id", "text_hash").agg(F.min(F.struct("is_new", *order, "chunk_id")).alias("memlake_first"))
    out = rows.join(first, ["workspace_id", "text_hash"])
    return out.withColumn("canonical_id", F.col("memlake_first.chunk_id")).withColumn("is_canonical", F.col("chunk_id") == F.col("memlake_first.chunk_id")).drop("memlake_first")


def source_refs(deduped: DataFrame) -> DataFrame:
    """(workspace_id, canonical_id, source_id): every source that holds a canonical chunk's text, a row each."""
    return deduped.select("workspace_id", "canonical_id", "source_id").distinct()


def also_in(deduped: DataFrame, most: int = 10) -> DataFrame:
    """`deduped` with n_also and also_in: how many other sources hold a row's text, and the first `most` of them.

    A text in very many sources is cut to its first ones in parts by a hash, then together; lists stay bounded.
    """
    keys, refs = ["workspace_id", "canonical_id"], source_refs(deduped)
    part = W.partitionBy(*keys, F.pmod(F.xxhash64("source_id"), F.lit(64))).orderBy("source_id")
    few = refs.withColumn("memlake_n", F.row_number().over(part)).where(F.col("memlake_n") <= most + 1)
    few = few.withColumn("memlake_n", F.row_number().over(W.partitionBy(*keys).orderBy("source_id"))).where(F.col("memlake_n") <= most + 1)
    held = few.groupBy(*keys).agg(F.sort_array(F.collect_list("source_id")).alias("memlake_held"))
    counts = refs.groupBy(*keys).agg((F.count("*") - 1).alias("n_also"))
    out = deduped.join(held.join(counts, keys), keys)
    return out.withColumn("also_in", F.slice(F.array_remove("memlake_held", F.col("source_id")), 1, most)).drop("memlake_held")


# -- chunkers: what needs a parser runs in Python over Arrow batches, the rest in the JVM

MARKDOWN = r"(?m)^#{1,3}[ \t]+[^\n]+"
SECTIONS = "abstract introduction background methodology method methods experiment experiments result results discussion conclusion reference references appendix".split()
PAPER = r"(?im)^(?:[0-9]+\.?\s+)?(?:related work|" + "|".join(sorted(SECTIONS, key=lambda x: (-len(x), x))) + r")\b"


def _split_at(df: DataFrame, pattern: str) -> DataFrame:
    """(source_id, ordinal, head, text): parts of a text from each match to the next; what precedes the first is dropped."""
    marked = F.regexp_replace("text", f"({pattern})", "\x01$1")
    parts = F.slice(F.split(marked, "\x01", -1), F.lit(2), F.size(F.split(marked, "\x01", -1)))
    return df.select("source_id", F.posexplode(parts).alias("ordinal", "part")).select("source_id", "ordinal", F.lower(F.trim(F.regexp_extract("part", f"^(?:{pattern})", 0))).alias("head"), F.regexp_replace("part", r"^\s+|\s+$", "").alias("text"))


def _finished(df: DataFrame) -> DataFrame:
    return df.select(chunk_id(F.col("source_id"), F.col("chunk_level"), F.col("ordinal")).alias("chunk_id"), "source_id", "chunk_level", F.col("ordinal").cast("int").alias("ordinal"), "text", text_hash(F.col("text")).alias("text_hash"))


def markdown_chunks(df: DataFrame) -> DataFrame:
    return _finished(_split_at(df, MARKDOWN).where("text <> ''").withColumn("chunk_level", F.lit("section")))


def paper_chunks(df: DataFrame) -> DataFrame:
    return _finished(_split_at(df, PAPER).where("text <> ''").withColumn("chunk_level", F.regexp_extract("head", r"^([^\s]+)", 1)))


def file_chunks(df: DataFrame) -> DataFrame:
    return _finished(df.select("source_id", F.lit(0).alias("ordinal"), F.lit("file").alias("chunk_level"), "text"))


def python_parts(text: str) -> list[tuple[str, str]]:
    """(level, text) of a module's top-level functions and classes; none if it doesn't parse."""
    try:
        body = ast.parse(text).body
    except (SyntaxError, ValueError, RecursionError):
        return []
    rows, kinds = text.splitlines(keepends=True), (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef)
    parts = (("class" if isinstance(n, ast.ClassDef) else "function", "".join(rows[n.lineno - 1 : n.end_lineno])) for n in body if isinstance(n, kinds))
    return [p for p in parts if p[1].strip()]


_JS = re.compile(r"^(?:export\s+)?(?:(?:default\s+)?(?:async\s+)?function\s+\w+|(class)\s+\w+|const\s+\w+\s*=\s*(?:async\s+)?\()", re.M)
_BRACE = re.compile(r"[{}]")


def js_parts(text: str) -> list[tuple[str, str]]:
    """(level, text) of functions and classes that start in the first column, to their closing brace."""
    out = []
    for m in _JS.finditer(text):
        depth, end = 0, len(text)
        for b in _BRACE.finditer(text, m.start()):
            depth += 1 if b.group() == "{" else -1
            if depth == 0 and b.group() == "}":
                end = b.end()
                break
        if part := text[m.start() : end].strip():
            out.append(("class" if "class" in m.group() else "function", part))
    return out


def mapping_parts(text: str, is_json: bool) -> list[tuple[str, str]]:
    """A block for each top-level key of a JSON or YAML mapping."""
    try:
        if is_json:
            data = json.loads(text)
        else:
            import yaml

            data = yaml.safe_load(text)
    except Exception:  # any parser's error means: not a mapping
        return []
    return [("block", json.dumps({k: v}, ensure_ascii=False, default=str)[:2000]) for k, v in data.items()] if isinstance(data, dict) else []


def _parts(filename: str, text: str) -> list[tuple[str, str]]:
    suffix = filename.rpartition(".")[2].lower()
    if suffix == "py":
        return python_parts(text)
    if suffix in ("js", "ts", "jsx", "tsx"):
        return js_parts(text)
    return mapping_parts(text, suffix == "json")


def structural_chunks(df: DataFrame) -> DataFrame:
    """Chunks of (source_id, filename, text) by file type; blank, unparsable and other texts are one `file` chunk."""
    suffix, blank = F.lower(F.element_at(F.split("filename", r"\."), -1)), F.trim("text") == ""
    parsed = suffix.isin("py", "js", "ts", "jsx", "tsx", "json", "yaml", "yml") & ~blank
    prose = suffix.isin("md", "markdown") & ~blank & F.col("text").rlike(MARKDOWN)

    def run(batches):
        for b in batches:
            rows = []
            for source, name, text in zip(b["source_id"], b["filename"], b["text"], strict=True):
                found = _parts(name, text) or [("file", text)]
                rows += [(source, i, level, part) for i, (level, part) in enumerate(found)]
            yield pd.DataFrame(rows, columns=["source_id", "ordinal", "chunk_level", "text"])

    code = df.where(parsed).select("source_id", "filename", "text").mapInPandas(run, "source_id string, ordinal int, chunk_level string, text string")
    return _finished(code).unionByName(markdown_chunks(df.where(prose))).unionByName(file_chunks(df.where(~parsed & ~prose)))


def ingest(incoming: DataFrame, stored: DataFrame, existing: DataFrame) -> DataFrame:
    """New chunks of changed sources: state, chunking, quality filter, dedup against active chunks, first writer wins.

    `incoming`: source_id, filename, text, content_hash, source_type, workspace_id; `existing`: chunk_id, source_id,
    workspace_id, text_hash, ordinal.  Rows that repeat a text point to its canonical chunk.
    """
    fresh = source_state(incoming, stored).where("state <> 'unchanged'")
    made = structural_chunks(fresh).join(fresh.select("source_id", "source_type", "workspace_id"), "source_id")
    good = made.where(skip_reason(F.col("text"), F.col("source_type")).isNull()).select("chunk_id", "source_id", "workspace_id", "text_hash", "ordinal")
    return exact_dedup(existing, good, ["source_id", "ordinal"]).where("is_new = 1").drop("is_new")


# -- categories

DEDUCTIVE, SAME, PROMOTED_AT = 0.70, 0.92, 3
FOLD, KNOWN = 1024, 1 << 13  # candidates and categories in one product
SLACK = 1e-4  # more than the error of a product of unit vectors in 32 bits


class Categories:
    """A project's categories, in the order in which they came, and the candidates' fold over them."""

    def __init__(self, project):
        self.project, self.names, self.evidence, self.active = project, [], [], []
        self.unit, self.short = np.zeros((0, 0)), np.zeros((0, 0), np.float32)

    def add(self, name: str, evidence: int, v: np.ndarray) -> None:
        n = len(self.names)
        if n == len(self.unit):
            wider = max(64, 2 * n), len(v)
            self.unit, old = np.zeros(wider), self.unit
            self.short, brief = np.zeros(wider, np.float32), self.short
            if n:
                self.unit[:n], self.short[:n] = old[:n], brief[:n]
        self.unit[n], self.short[n] = v, v
        self.names.append(name)
        self.evidence.append(evidence)

    def first(self, v: np.ndarray, some) -> tuple[float, int]:
        """The best score and its category among some, the first of equals; a score that isn't a number is none."""
        best = (-np.inf, -1)
        for i in some:
            score = float(self.unit[i] @ v)
            if score > best[0]:
                best = (score, i)
        return best

    def fold(self, rows: list[int], labels: list[str], x: np.ndarray) -> list[tuple]:
        """(project_id, row, category, kind) of unit vectors in order.  Products say which categories each can be near
        to: those from before, in blocks, and those that the rows before it may found; the scores of these decide."""
        n, brief, out = len(self.names), x.astype(np.float32), []
        deductive = [(-np.inf, -1)] * len(x)
        if self.active:
            to = brief @ self.short[self.active].T
            for r, top in enumerate(to.max(axis=1)):
                if top >= DEDUCTIVE - SLACK:
                    deductive[r] = self.first(x[r], (self.active[j] for j in np.flatnonzero(to[r] >= top - SLACK)))
        left = np.flatnonzero([score < DEDUCTIVE for score, _ in deductive])
        near, ahead = [[] for _ in x], [[] for _ in x]
        for low in range(0, n if len(left) else 0, KNOWN):
            for r, j in np.argwhere(brief[left] @ self.short[low : min(n, low + KNOWN)].T > SAME - SLACK):
                near[left[r]].append(low + int(j))
        for r, j in np.argwhere(np.tril(brief[left] @ brief[left].T > SAME - SLACK, -1)):
            ahead[left[r]].append(int(left[j]))
        founded = {}
        for r, (row, label) in enumerate(zip(rows, labels, strict=True)):
            if deductive[r][0] >= DEDUCTIVE:
                out.append((self.project, row, self.names[deductive[r][1]], "deductive"))
                continue
            score, at = self.first(x[r], [*near[r], *(founded[j] for j in ahead[r] if j in founded)])
            if score > SAME:
                self.evidence[at] += 1
                out.append((self.project, row, self.names[at], "promoted" if self.evidence[at] == PROMOTED_AT else "merged"))
            else:
                founded[r] = len(self.names)
                self.add(label, 1, x[r])
                out.append((self.project, row, label, "new"))
        return out


def _fold(batches):
    """Rows (project_id, is_candidate, row, label, embedding, status, evidence_count) in order, a project's categories
    first, to the candidates' categories."""
    have = None
    for b in batches:
        columns = [b.column(i).to_pylist() for i in (0, 1, 2, 3, 5, 6)]
        vectors = b.column(4)
        low, n = 0, b.num_rows
        while low < n:
            project, candidates, high = columns[0][low], columns[1][low], low + 1
            while high < min(n, low + FOLD) and columns[0][high] == project and columns[1][high] == candidates:
                high += 1
            x = np.array([np.asarray(v, float) for v in vectors.slice(low, high - low).to_pylist()])
            norm = np.array([np.linalg.norm(v) for v in x])
            x = x / np.where(norm == 0, 1.0, norm)[:, None]
            if have is None or have.project != project:
                have = Categories(project)
            if candidates:
                out = have.fold(columns[2][low:high], columns[3][low:high], x)
                kinds = (b.schema.field(0).type, pa.int64(), pa.string(), pa.string())
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names=["project_id", "row", "category", "kind"])
            else:
                for i in range(low, high):
                    if columns[4][i] == "active":
                        have.active.append(len(have.names))
                    have.add(columns[3][i], columns[5][i], x[i - low])
            low = high


def assign_or_create(candidates: DataFrame, categories: DataFrame) -> DataFrame:
    """(project_id, row, category, kind): each candidate, in order of `row`, to the best active category at 0.70 or
    more, else to one above 0.92 among all (its evidence grows), else to a new one that later rows see.

    The order matters, so one task has a project's candidates; it streams them in order and holds the categories alone.
    `categories` holds (category_id, status, centre, evidence_count, project_id).  Candidates without label or embedding
    are skipped.
    """
    use_package(candidates.sparkSession)
    rows = candidates.where((F.trim("label") != "") & (F.size("embedding") > 0)).select("project_id", F.lit(True).alias("is_candidate"), F.col("row").cast("long").alias("row"), "label", F.col("embedding").cast("array<double>").alias("embedding"), F.lit("").alias("status"), F.lit(None).cast("int").alias("evidence_count"))
    known = categories.where("status IS NOT NULL").select("project_id", F.lit(False).alias("is_candidate"), F.col("category_id").cast("long").alias("row"), F.col("category_id").cast("string").alias("label"), F.col("centre").cast("array<double>").alias("embedding"), "status", F.col("evidence_count").cast("int").alias("evidence_count"))
    inorder = rows.unionByName(known).repartition("project_id").sortWithinPartitions("project_id", "is_candidate", "row")
    return inorder.mapInArrow(_fold, "project_id string, row long, category string, kind string")


def labels_view(links: DataFrame, most: int = 5) -> DataFrame:
    """(chunk_id, labels): names by confidence, distinct, at most five."""
    ordered = F.array_sort(F.collect_list(F.struct((-F.col("confidence")).alias("c"), "name")))
    return links.groupBy("chunk_id").agg(F.slice(F.array_distinct(F.transform(ordered, lambda x: x["name"])), 1, most).alias("labels"))


def remapped(labels: Column, mapping: Column) -> Column:
    """Labels without "[neu]" in lower case, mapped, distinct in order."""
    bare = F.transform(labels, lambda x: F.trim(F.regexp_replace(F.lower(F.trim(x)), r"^\[neu\]", "")))
    return F.array_distinct(F.transform(bare, lambda x: F.coalesce(F.element_at(mapping, x), x)))
