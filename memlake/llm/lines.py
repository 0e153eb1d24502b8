"""Line dedup by winnowing, with DataFrame operations only.

A document is its lines; GRAM neighbouring lines make a gram, and of every WINDOW neighbouring grams the one with the
least hash is a fingerprint (all of them, where they tie).  Only fingerprints go on, each with its position and the
WINDOW - 1 lines on either side.  So any RUN = WINDOW + GRAM - 1 lines hold a fingerprint, and equal runs hold the same
one at the same place.  Positions of one fingerprint are joined with its earliest that has the same line before, and
with its earliest that has the same line after: the match is extended by that line either way, and the RUN lines are
repeated.  Longer runs are chains of such matches, so they are found whole, from whichever documents they come.  A line of
LONG characters or more is a run of its own.  Lines of later runs are deleted, the earliest stay.

"Earlier" is a smaller doc_id (null before all), or in one document an earlier line; different texts of one doc_id are
ordered by a hash, rows equal in both are one document and treated alike.  Runs are judged on the input, so overlaps
count.  Null texts have no lines and stay null; an empty text has one empty line.  Short lines of documents of fewer
than RUN lines stay.  Lines are compared by hashes of 128 bits.  Hot fingerprints are reduced to their first before any
shuffle by fingerprint; their later positions are only filtered by it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from memlake.llm.common import drop_written, row_key, table, written

GRAM, WINDOW = 2, 2
RUN = WINDOW + GRAM - 1
LONG = 60
NONE = -(1 << 63)


def _fingerprints(lined: DataFrame) -> DataFrame:
    """(ord, rid, at, fp, check, before, after) of the fingerprints; `lined` has (ord, rid, h, g, long)."""
    h, g = F.col("h"), F.col("g")
    grams = F.when(F.size(h) >= RUN, F.transform(F.sequence(F.lit(0), F.size(h) - GRAM), lambda i: F.xxhash64(F.get(h, i), F.get(h, i + 1)))).otherwise(F.array().cast("array<bigint>"))
    lined = lined.withColumn("grams", grams)
    least = lambda i: (F.get("grams", i) <= F.coalesce(F.get("grams", i - 1), F.get("grams", i))) | (F.get("grams", i) <= F.coalesce(F.get("grams", i + 1), F.get("grams", i)))
    places = F.filter(F.when(F.size("grams") > 0, F.sequence(F.lit(0), F.size("grams") - 1)).otherwise(F.array().cast("array<int>")), least)
    entry = lambda i: F.struct(i.alias("at"), F.get("grams", i).alias("fp"), F.xxhash64(F.get(g, i), F.get(g, i + 1)).alias("check"), F.get(h, i - 1).alias("before"), F.get(h, i + 2).alias("after"))
    return lined.select("ord", "rid", F.explode(F.transform(places, entry)).alias("x")).select("ord", "rid", "x.*")


def _later(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Rows that aren't the first of their keys."""
    first = rows.groupBy(*keys).agg(F.min(F.struct("ord", "rid", "at")).alias("first"), F.count("*").alias("n")).where("n > 1").drop("n")
    return rows.join(first, keys).where(F.struct("ord", "rid", "at") != F.col("first"))


def repeated_lines(docs: DataFrame) -> DataFrame:
    """(ord, rid, runs): for each document the repeated runs (at, n) of lines, in order."""
    lines = F.split("text", "\n", -1)
    long = F.filter(F.transform(lines, lambda x, i: F.when(F.length(x) >= LONG, i)), lambda i: i.isNotNull())
    lined = docs.select("ord", "rid", F.transform(lines, lambda x: F.xxhash64(x)).alias("h"), F.transform(lines, lambda x: F.xxhash64(x, F.lit(1))).alias("g"), long.alias("long"))
    single = lined.select("ord", "rid", F.explode(F.transform("long", lambda i: F.struct(i.alias("at"), F.get("h", i).alias("fp"), F.get("g", i).alias("check")))).alias("x")).select("ord", "rid", "x.*", F.lit(None).cast("long").alias("before"), F.lit(None).cast("long").alias("after"))
    every = single.withColumn("single", F.lit(True)).unionByName(_fingerprints(lined).withColumn("single", F.lit(False)))
    often = every.groupBy("single", "fp", "check").agg(F.count("*").alias("n")).where("n > 1").drop("n")
    met = written(every.join(often, ["single", "fp", "check"], "left_semi"))
    grams = met.where(~F.col("single"))
    back = _later(grams.where("before IS NOT NULL"), ["fp", "check", "before"]).select("ord", "rid", (F.col("at") - 1).alias("at"), F.lit(RUN).alias("n"))
    forth = _later(grams.where("after IS NOT NULL"), ["fp", "check", "after"]).select("ord", "rid", "at", F.lit(RUN).alias("n"))
    alone = _later(met.where("single"), ["fp", "check"]).select("ord", "rid", "at", F.lit(1).alias("n"))
    found = back.unionByName(forth).unionByName(alone).groupBy("ord", "rid").agg(F.array_sort(F.collect_set(F.struct("at", "n"))).alias("runs"))
    out = written(found)
    drop_written(met)
    return out


def deduplicated(docs: DataFrame) -> DataFrame:
    """`docs` with what is left of the text, and the columns memlake_n and memlake_kept: lines before and after."""
    order = F.coalesce(F.col("doc_id").cast("long"), F.lit(NONE))
    gone = repeated_lines(docs.select(order.alias("ord"), row_key().alias("rid"), "text"))
    gone = gone.select(F.col("ord").alias("memlake_ord"), F.col("rid").alias("memlake_rid"), F.col("runs").alias("memlake_runs"))
    # The runs grow with the input: one plan for all sizes, no broadcast while they happen to be few.
    out = docs.withColumns({"memlake_ord": order, "memlake_rid": row_key()}).join(gone.hint("merge"), ["memlake_ord", "memlake_rid"], "left")
    lines, runs, m = F.split("text", "\n", -1), F.col("memlake_runs"), F.size("memlake_runs")

    def piece(j: Column) -> Column:
        """The lines between the runs j - 1 and j; runs are at most RUN lines long and sorted, so RUN of them reach back."""
        ends = [F.when(j >= k, F.get(runs, j - k)["at"] + F.get(runs, j - k)["n"]).otherwise(0) for k in range(1, 2 * RUN + 1)]
        begin, end = F.greatest(*ends), F.when(j == m, F.size(lines)).otherwise(F.get(runs, j)["at"])
        return F.slice(lines, begin + 1, F.greatest(end - begin, F.lit(0)))

    out = out.withColumns({"memlake_n": F.when(F.col("text").isNull(), 0).otherwise(F.size(lines)), "memlake_left": F.flatten(F.transform(F.sequence(F.lit(0), m), piece))})
    kept = F.when(runs.isNull(), F.col("memlake_n")).otherwise(F.size("memlake_left"))
    return out.withColumns({"memlake_kept": kept, "text": F.when(runs.isNull(), F.col("text")).otherwise(F.array_join("memlake_left", "\n"))}).drop("memlake_ord", "memlake_rid", "memlake_runs", "memlake_left")


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = deduplicated(table(spark, sf_dir, "documents").select("doc_id", "text"))
    n, gone = F.col("memlake_n").cast("long"), (F.col("memlake_n") - F.col("memlake_kept")).cast("long")
    return out.select("doc_id", n.alias("n_lines"), gone.alias("n_removed"), F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pipeline's line dedup: texts without their repeated runs; documents of which no line is left go."""
    out = deduplicated(docs).where((F.col("memlake_n") == 0) | (F.col("memlake_kept") > 0))
    if "n_chars" in docs.columns:
        changed = F.col("memlake_kept") < F.col("memlake_n")
        out = out.withColumn("n_chars", F.when(changed, F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars")))
    return out.select(docs.columns)


ORACLE = f"""
WITH l AS (
  SELECT doc_id, CAST(i - 1 AS BIGINT) AS i, lines[i] AS line, len(lines) AS n
  FROM (SELECT doc_id, lines, unnest(range(1, len(lines) + 1)) AS i FROM (SELECT doc_id, string_split(text, chr(10)) AS lines FROM documents))
), r AS (
  SELECT doc_id, i, line || chr(10) || lead(line, 1) OVER w || chr(10) || lead(line, 2) OVER w AS run FROM l
  WINDOW w AS (PARTITION BY doc_id ORDER BY i)
), f AS (
  SELECT doc_id, i, row_number() OVER (PARTITION BY run ORDER BY doc_id, i) AS k FROM r WHERE run IS NOT NULL
), gone AS (
  SELECT DISTINCT doc_id, i + d AS i FROM f, (SELECT unnest(range(0, {RUN})) AS d) WHERE k > 1
  UNION SELECT doc_id, i FROM (SELECT doc_id, i, row_number() OVER (PARTITION BY line ORDER BY doc_id, i) AS k FROM l WHERE length(line) >= {LONG}) WHERE k > 1
), kept AS (
  SELECT l.doc_id, count(*) AS n_lines, count(gone.i) AS n_removed, string_agg(l.line, chr(10) ORDER BY l.i) FILTER (WHERE gone.i IS NULL) AS kept
  FROM l LEFT JOIN gone ON l.doc_id = gone.doc_id AND l.i = gone.i GROUP BY l.doc_id
)
SELECT d.doc_id, coalesce(n_lines, 0) AS n_lines, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM documents d LEFT JOIN kept ON d.doc_id = kept.doc_id
"""
