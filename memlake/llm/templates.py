"""Benchmark decontamination by templates, with DataFrame operations only.

Texts become templates: words in lower case, with typed placeholders for numbers (#n), units after a number (#u) and
names (#p: capitalised inside a sentence).  Windows of WIDTH template words are hashed and joined with the benchmark's
(an item of fewer words is one window of its own width).  Windows of as many words as placeholders, and LEAST words, are
rich.  Rich matches of a document and an item at one offset are a re-parameterised passage if their slots agree: wherever
the item repeats a value the document must repeat its own.  Where they disagree, and of windows that aren't rich, those
count whose placeholders stand for the same in both, word for word.

Two forms make the same template words: `canonical`, a few replacements over a whole text, asks all documents which of
them have a window of the benchmark's at all; `templated` keeps what each placeholder stands for and is made of those
alone.  The benchmark's windows are counted and broadcast up to BROADCAST rows; beyond that the join is left to Spark.
Long texts, hot sources and passages that many documents share cost their own length: windows meet the benchmark's
before any shuffle, and only ids of documents that match move.  Nulls and texts of fewer words than a window match
nothing; benchmark rows that are null or repeat one item_id with one text count once.  Rows equal in doc_id and text are
one document.  The characters U+E001 to U+E003 count as spaces.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from memlake.llm.common import drop_written, only_keys, row_key, table, use_package, written

WIDTH = 8
LEAST = 3
BROADCAST = 1_000_000
UNITS = "mm cm m km in ft yd mi mg g kg t lb oz ml cl l gal s sec min h hr hrs hour hours day days week weeks month months year years am pm hz khz mhz ghz kb mb gb tb w kw mw v kv a ma j kj cal kcal n pa kpa bar mph kmh percent pct usd eur gbp chf jpy dollar dollars cent cents euro euros pound pounds degree degrees meter meters metre metres kilometer kilometers mile miles inch inches foot feet gram grams kilogram kilograms liter liters litre litres second seconds minute minutes".split()


STOPS, SIGNS = ".!?:;\n", "%€$£°"
_W = r"\p{L}\p{M}\p{N}_"
_WORDS = rf"\p{{N}}+(?:[.,]\p{{N}}+)*|[\p{{L}}\p{{M}}\p{{N}}_]+|[{STOPS}{SIGNS}]"


#: Placeholders within a text: number, unit, name.
_N, _U, _P = "\ue001", "\ue002", "\ue003"


def canonical(text: Column) -> Column:
    """The template words of a text, with placeholders of one private character each."""
    between = rf"[^{_W}{STOPS}{SIGNS}{_N}{_U}]"  # what separates two words of a sentence
    units, capital = "|".join(sorted(UNITS, key=lambda u: (-len(u), u))), r"\p{Lu}\p{Ll}"
    clash = F.contains(text, F.lit(_N)) | F.contains(text, F.lit(_U)) | F.contains(text, F.lit(_P))
    s = F.when(clash, F.translate(text, _N + _U + _P, "   ")).otherwise(text)
    s = F.regexp_replace(s, rf"(?=\p{{N}})(?<![{_W}])\p{{N}}+(?:[.,]\p{{N}}+)*+", _N)
    s = F.regexp_replace(s, rf"{_N}({between}*+)(?:[{SIGNS}]|(?i:{units})(?![{_W}]))", f"{_N}$1{_U}")
    s = F.regexp_replace(s, rf"((?={between})(?<=[{_W}{SIGNS}{_N}{_U}]){between}++|(?={capital})(?<=[{SIGNS}{_N}{_U}])){capital}[{_W}]*+", f"$1{_P}")
    words = F.regexp_extract_all(F.lower(s), F.lit(rf"[{_N}{_U}{_P}]|[{_W}]+"), F.lit(0))
    return words


def templated(df: DataFrame) -> DataFrame:
    """`df` with the column t in place of its text: array<struct<c, v>> of template words and what they stand for."""
    words = F.regexp_extract_all(F.col("text"), F.lit(_WORDS), F.lit(0))

    def marked(x: Column) -> Column:
        low = F.lower(x)
        return F.struct(low.alias("c"), x.alias("v"), F.when(x.rlike(r"^\p{Lu}\p{Ll}"), "p").when(x.rlike(r"^\p{N}"), "n").alias("k"))

    def typed(x: Column, i: Column) -> Column:
        before = F.get("memlake_words", i - 1)
        unit = (before["k"] == "n") & (x["c"].isin(*UNITS) | x["c"].isin(*SIGNS))
        name = (x["k"] == "p") & (i > 0) & ~before["c"].isin(*STOPS)
        return F.struct(F.when(x["k"] == "n", "#n").when(unit, "#u").when(name, "#p").otherwise(x["c"]).alias("c"), x["v"].alias("v"))

    made = F.filter(F.transform("memlake_words", typed), lambda s: ~s["c"].isin(*STOPS, *SIGNS))
    return df.withColumn("memlake_words", F.transform(words, marked)).withColumn("t", made).drop("memlake_words", "text")


def _windows(hashes: Column, width: int) -> Column:
    """Hashes of all windows of `width` hashed words."""
    n = F.size(hashes) - width + 1
    rows = F.arrays_zip(*(F.slice(hashes, F.lit(k + 1), n).alias(str(k)) for k in range(width)))
    return F.when(n > 0, F.transform(rows, lambda w: F.xxhash64(F.lit(width), w))).otherwise(F.array().cast("array<bigint>"))


def windows(df: DataFrame, width: int) -> DataFrame:
    """A row for each window: `at` and `window` (a hash), beside the columns other than t."""
    rest = [c for c in df.columns if c != "t"]
    hashed = df.select(*rest, F.transform("t", lambda s: F.xxhash64(s["c"])).alias("h"))
    return hashed.select(*rest, F.posexplode(_windows(F.col("h"), width)).alias("at", "window"))


def asking(docs: DataFrame, widths: list[int], asked: DataFrame) -> DataFrame:
    """(ord, rid) of documents that have one of the windows in `asked`."""
    names = F.array(F.lit(_N), F.lit(_U), F.lit(_P))
    kinds = F.array(F.lit("#n"), F.lit("#u"), F.lit("#p"))
    hashed = F.transform(canonical(F.col("text")), lambda x: F.xxhash64(F.coalesce(F.get(kinds, F.array_position(names, x).cast("int") - 1), x)))
    h = docs.select("ord", "rid", hashed.alias("h"))
    every = [_windows(F.col("h"), w) for w in widths]
    made = h.select("ord", "rid", F.explode(F.concat(*every) if len(every) > 1 else every[0]).alias("window"))
    return made.join(asked, "window", "left_semi").select("ord", "rid").distinct()


def contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(ord, rid, doc_id, item_id, n_windows, doc_at, item_at, n_words, slots): passages of items in documents.

    doc_at, item_at and n_words span the matched windows in template words; slots holds (item value, document value).
    """
    items = written(templated(benchmark.select("item_id", "text").where(F.col("text").isNotNull() & F.col("item_id").isNotNull()).distinct()))
    short = [r["n"] for r in items.select(F.size("t").alias("n")).where(F.col("n").between(1, WIDTH - 1)).distinct().collect()]
    whole = F.when(F.size("t") < WIDTH, F.size("t")).otherwise(WIDTH).alias("width")
    named = items.select(F.xxhash64("item_id", F.to_json("t")).alias("item"), "item_id", whole, F.col("t").alias("words"), "t")
    widths = [WIDTH, *sorted(short)]
    asked = reduce(DataFrame.unionByName, (windows(named.where(F.col("width") == w), w) for w in widths))
    # As equal windows have as many literal words, the documents' needn't be counted.
    literal = F.size(F.filter(F.slice("words", F.col("at") + 1, F.col("width")), lambda s: ~s["c"].startswith("#")))
    rich = literal >= F.greatest(F.lit(LEAST), F.ceil(F.col("width") / 2))
    asked = written(asked.select("item", "item_id", "width", "window", F.col("at").alias("item_at"), rich.alias("rich")))
    bounded = asked.count() <= BROADCAST
    order = F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63)))
    keyed = docs.where(F.col("text").isNotNull()).select("doc_id", order.alias("ord"), row_key().alias("rid"), "text")
    sought = asked.select("window").distinct()
    few = written(asking(keyed, widths, F.broadcast(sought) if bounded else sought))
    texts = only_keys(keyed, few, "rid").join(few, ["ord", "rid"]).dropDuplicates(["ord", "rid"])
    texts = written(templated(texts))
    drop_written(few)
    made = reduce(DataFrame.unionByName, (windows(texts, w) for w in widths))
    hits = made.join(F.broadcast(asked) if bounded else asked, "window")
    spans = hits.groupBy("ord", "rid", "item", "item_id", (F.col("at") - F.col("item_at")).alias("shift")).agg(F.sort_array(F.collect_set(F.struct("item_at", "width", "rich"))).alias("windows"))
    values = items.select(F.xxhash64("item_id", F.to_json("t")).alias("item"), F.col("t").alias("ti")).dropDuplicates(["item"])
    both = spans.join(values, "item").join(texts.select("ord", "rid", "doc_id", F.col("t").alias("td")), ["ord", "rid"])

    def places(found: Column) -> Column:
        return F.array_distinct(F.flatten(F.transform(found, lambda w: F.sequence(w["item_at"], w["item_at"] + w["width"] - 1))))

    def slots(found: Column) -> Column:
        return F.array_distinct(F.transform(F.filter(places(found), lambda p: F.get("ti", p)["c"].startswith("#")), lambda p: F.struct(F.get("ti", p)["v"].alias("item_value"), F.get("td", p + F.col("shift"))["v"].alias("doc_value"))))

    def verbatim(w: Column) -> Column:
        return F.forall(F.sequence(w["item_at"], w["item_at"] + w["width"] - 1), lambda p: ~F.get("ti", p)["c"].startswith("#") | (F.get("ti", p)["v"] == F.get("td", p + F.col("shift"))["v"]))

    both = both.withColumns({"rich": F.filter("windows", lambda w: w["rich"]), "exact": F.filter("windows", verbatim)}).withColumn("agreed", slots(F.col("rich")))
    agree = F.size("agreed") == F.size(F.array_distinct(F.col("agreed.item_value")))
    kept = both.withColumn("windows", F.when(agree, F.sort_array(F.array_union("rich", "exact"))).otherwise(F.col("exact"))).where(F.size("windows") > 0)
    checked = kept.withColumns({"places": places(F.col("windows")), "slots": slots(F.col("windows"))})
    return checked.select("ord", "rid", "doc_id", "item_id", F.size("windows").alias("n_windows"), (F.array_min("places") + F.col("shift")).alias("doc_at"), F.array_min("places").alias("item_at"), F.size("places").alias("n_words"), "slots")


def op2_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, item_id, n_windows, n_words) of every document and item that match, over all offsets."""
    found = contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.groupBy("doc_id", "item_id").agg(F.sum("n_windows").cast("long").alias("n_windows"), F.max("n_words").cast("long").alias("n_words"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pipeline's decontamination: documents that hold a passage of an item go."""
    use_package(spark)
    found = contaminated(docs.select("doc_id", "text"), table(spark, sf_dir, "benchmark")).select(F.col("ord").alias("memlake_ord"), F.col("rid").alias("memlake_rid")).distinct()
    keyed = docs.withColumns({"memlake_ord": F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63))), "memlake_rid": row_key()})
    return keyed.join(found, ["memlake_ord", "memlake_rid"], "left_anti").select(docs.columns)
