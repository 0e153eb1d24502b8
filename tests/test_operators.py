"""Invariants on inline rows."""

import pytest
from pyspark.sql import functions as F

from memlake.functions import text as T
from memlake.operators import ingest, lexical, rank, vector, work
from memlake.operators.scope import Scope, metadata_filter, scoped
from memlake.plans.retrieval import search_


@pytest.fixture(scope="module")
def chunks(spark):
    rows = [
        ("own", "s1", "private", None, "u1", "ws2", "code"),
        ("foreign", "s2", "private", None, "u2", "ws1", "code"),
        ("org", "s3", "org", "org-x", None, "ws1", "code"),
        ("public", "s4", "public", None, None, "ws1", "code"),
        ("reference", "s5", "public", None, None, "ws1", "reference"),
    ]
    df = spark.createDataFrame(rows, "chunk_id string, source_id string, visibility string, org_id string, user_id string, workspace_id string, source_class string")
    return df.withColumns({"is_active": F.lit(True), "repo": F.lit("r"), "source_type": F.lit("note"), "scope_key": F.lit(None).cast("string"), "labels": F.array(F.lit("Auth"))})


def ids(df):
    return {r["chunk_id"] for r in df.collect()}


def test_visibility(chunks):
    assert ids(scoped(chunks, Scope("ws1", "u1", ("org-x",)))) == {"own", "org", "public"}
    assert ids(scoped(chunks, Scope("ws1", "u1"))) == {"own", "public"}
    assert ids(scoped(chunks, Scope("ws1"))) == {"public"}
    assert ids(scoped(chunks, Scope())) == {"own", "foreign", "org", "public"}


def test_reference_policy(spark, chunks):
    links = spark.createDataFrame([("reference", "p", "ws1"), ("reference", "q", "ws9")], "chunk_id string, project_id string, workspace_id string")
    assert ids(scoped(chunks, Scope("ws1", reference_only=True))) == {"reference"}
    assert ids(scoped(chunks, Scope("ws1", include_reference=True))) == {"public", "reference"}
    assert ids(scoped(chunks, Scope("ws1", project_id="p"), links)) == {"public", "reference"}
    assert ids(scoped(chunks, Scope("ws1", project_id="q"), links)) == {"public"}
    assert ids(scoped(chunks, Scope(categories=("auth ",)))) == {"own", "foreign", "org", "public"}
    assert ids(chunks.where(metadata_filter({"$or": [{"user_id": "u1"}, {"org_id": {"$in": ["org-x"]}}]}))) == {"own", "org"}


def test_keyword_lane_finds_rare_tokens(spark):
    rows = [(f"n{i}", f"unrelated filler text number {i}", "") for i in range(40)] + [("t", "here is zebrafish", ""), ("s", "other", "the zebrafish summary")]
    df = spark.createDataFrame(rows, "chunk_id string, text string, summary string").withColumns({"source_id": F.col("chunk_id"), "labels": F.array().cast("array<string>"), "is_active": F.lit(True), "source_class": F.lit("code"), "created_at": F.lit("2024-01-01").cast("timestamp")})
    q = spark.createDataFrame([(1, "zebrafish")], "query_id int, query string")
    hits = search_(lexical.Index.of(df), df, q, Scope(), F.lit("2024-01-02").cast("timestamp"))
    assert {r["chunk_id"] for r in hits.collect()} == {"t", "s"}


def test_project_boost_is_exact(spark):
    df = spark.createDataFrame([("a", 1.0), ("b", 0.0)], "chunk_id string, project double")
    stages = {c: F.lit(0.4) for c in ("vector", "symbolic")} | {c: F.lit(0.0) for c in ("recency", "affinity", "predicted", "hint", "category")} | {c: F.lit(None).cast("double") for c in ("feedback", "advisor")}
    got = {r[0]: r[1] for r in df.withColumns(stages).select("chunk_id", rank.score_v1()).collect()}
    assert got["a"] - got["b"] == pytest.approx(0.08)


def test_session_rows_are_admitted(spark):
    rows = [(1, f"c{i}", 0.9 - i / 100, False) for i in range(5)] + [(1, "s", 0.1, True)]
    out = rank.admitted(spark.createDataFrame(rows, "query_id int, chunk_id string, score double, is_session boolean"), 3).collect()
    assert [r["chunk_id"] for r in sorted(out, key=lambda r: r["place"])] == ["c0", "c1", "s"]


def test_prompt_stops_at_the_budget(spark):
    entry = lambda s, t: F.struct(F.lit(s).alias("source_id"), F.lit(t).alias("text"), F.lit("").alias("summary"), F.array(F.lit("x")).alias("labels"))
    prompt = lambda budget, *e: spark.range(1).select(rank.compressed(F.array(*e), budget)).first()[0]
    assert prompt(500, entry("a", "one"), entry("a", "two"), entry("b", "three")) == "## Memory Context\n\n- [x] a\n  one\n- [x] b\n  three"
    assert prompt(30, entry("a", "y" * 90)) == ""
    assert prompt(400, entry("a", "y" * 300), entry("b", "z")) == "## Memory Context\n\n- [x] a\n  " + "y" * 187 + "...\n- [x] b\n  z"


def test_cosine(spark):
    f = lambda a, b: spark.range(1).select(vector.cosine(F.array(*map(F.lit, a)), F.array(*map(F.lit, b)))).first()[0]
    assert f([1.0, 0.0], [0.0, 0.0]) == 0 and f([1.0], [1.0, 0.0]) == 0
    assert f([3.0, 4.0], [3.0, 4.0]) == pytest.approx(1)


def test_chunkers(spark):
    py = "import x\n\n@d\ndef f():\n    return 1\n\nclass C:\n    pass\n"
    rows = [("p", "a.py", py), ("bad", "b.py", "def ("), ("j", "c.js", "function f() { { } }\nlet z;\nexport class D { }"), ("m", "d.md", "lost\n# One\ntext\n## Two\n"), ("o", "e.json", '{"k": 1, "l": [2]}'), ("l", "f.json", "[1]"), ("e", "g.py", "  "), ("t", "h.txt", "plain")]
    got = {}
    for r in sorted(ingest.structural_chunks(spark.createDataFrame(rows, "source_id string, filename string, text string")).collect(), key=lambda r: r["ordinal"]):
        got.setdefault(r["source_id"], []).append((r["chunk_level"], r["text"]))
    assert got["p"] == [("function", "def f():\n    return 1\n"), ("class", "class C:\n    pass\n")]
    assert got["j"] == [("function", "function f() { { } }"), ("class", "export class D { }")]
    assert got["m"] == [("section", "# One\ntext"), ("section", "## Two")]
    assert got["o"] == [("block", '{"k": 1}'), ("block", '{"l": [2]}')]
    assert [got[x][0][0] for x in ("bad", "l", "e", "t")] == ["file"] * 4
    paper = spark.createDataFrame([("x", "Title\nAbstract\nshort\n1. Introduction\nlong\nRelated Work\nothers")], "source_id string, text string")
    assert [r["chunk_level"] for r in sorted(ingest.paper_chunks(paper).collect(), key=lambda r: r["ordinal"])] == ["abstract", "1.", "related"]


def test_quality_filter(spark):
    cases = [("short", "too_short"), ("@@ -1,2 +3,4 @@ " + "x" * 90, "diff_output"), ("```\n" + "code line\n" * 20 + "\n```", "code_density"), ("a plain sentence of prose " * 10, None)]
    df = spark.createDataFrame(cases, "text string, reason string")
    assert all(r[0] == r[1] for r in df.select(T.skip_reason(F.col("text"), F.lit("conversation_summary")), "reason").collect())
    assert df.where(T.skip_reason(F.col("text"), F.lit("note")).isNotNull()).isEmpty()


def test_urls_and_labels(spark):
    one = lambda c: spark.range(1).select(c).first()[0]
    assert one(T.canonical_url(F.lit("HTTPS://Host:8080/A/b/?q#f"))) == "https://host/a/b"
    assert one(T.canonical_url(F.lit("git@Host:Own/Repo.git"))) == "https://host/own/repo"
    assert [one(T.plausible_label(F.lit(x))) for x in ("auth", "a", "aaaaaa", "x y", "css")] == [True, False, False, False, True]
    assert one(T.valid_scope_key(F.lit("repo:x"))) and not one(T.valid_scope_key(F.lit("other:x")))


def test_categories_fold(spark):
    cats = spark.createDataFrame([(1, "active", [1.0, 0.0, 0.0], 5, "p")], "category_id long, status string, centre array<double>, evidence_count int, project_id string")
    rows = [("p", 1, "auth", [1.0, 0.0, 0.0]), ("p", 2, "new", [0.0, 1.0, 0.0]), ("p", 3, "again", [0.0, 1.0, 0.0]), ("p", 4, "more", [0.0, 1.0, 0.01]), ("p", 5, " ", [1.0, 0.0, 0.0])]
    out = ingest.assign_or_create(spark.createDataFrame(rows, "project_id string, row long, label string, embedding array<double>").repartition(3), cats).collect()
    assert [(r["row"], r["category"], r["kind"]) for r in sorted(out, key=lambda r: r["row"])] == [(1, "1", "deductive"), (2, "new", "new"), (3, "new", "merged"), (4, "new", "promoted")]


def test_trigger_that_was_off_stays_off(spark):
    rows = [(1, i, False) for i in range(50)] + [(1, 50 + i, True) for i in range(50)] + [(2, i, True) for i in range(60)]
    out = work.trigger_stats(spark.createDataFrame(rows, "trigger_id long, seq long, was_referenced boolean")).collect()
    assert {r["trigger_id"]: (r["fires"], r["active"]) for r in out} == {1: (100, False), 2: (60, True)}


def test_dedup_is_independent_of_partitioning(spark):
    df = spark.createDataFrame([(f"c{i}", f"s{i}", "w", str(i % 3), i) for i in range(20)], "chunk_id string, source_id string, workspace_id string, text_hash string, ordinal int")
    run = lambda n: sorted(map(tuple, ingest.exact_dedup(df.where("ordinal < 3").repartition(n), df.where("ordinal >= 3").repartition(n), ["ordinal"]).select("chunk_id", "canonical_id").collect()))
    assert run(1) == run(5) and {c for _, c in run(1)} == {"c0", "c1", "c2"}


def test_streams(spark, tmp_path):
    from memlake.streaming import incremental as S

    schema = "trigger_id long, seq long, was_referenced boolean, text string, ts timestamp, user_id long"
    rows = [(1, i, i % 2 == 0, "alpha then beta", None, 1) for i in range(30)]
    spark.createDataFrame(rows, schema).write.parquet(str(tmp_path / "in"))
    stream = S.event_stream(spark, str(tmp_path / "in"), spark.createDataFrame([], schema).schema)
    index = F.create_map(F.lit("alpha"), F.array(F.lit("A")), F.lit("beta"), F.array(F.lit("B")))
    for name, df, mode in (("counters", S.trigger_counters(stream.select("trigger_id", "seq", "was_referenced")), "update"), ("moves", S.topic_transitions(stream, index), "complete")):
        df.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start().awaitTermination(60)
    assert [tuple(r) for r in spark.table("counters").collect()] == [(1, 30, 15, True)]
    assert [tuple(r) for r in spark.table("moves").collect()] == [("A", "B", 30)]


def test_neighbours_in_blocks_are_those_by_pairs(spark, monkeypatch):
    import random

    from memlake.operators import dense

    rng = random.Random(5)
    some = [[rng.choice((-1.0, 0.0, 0.5, 1.0)) for _ in range(3)] for _ in range(120)]
    odd = [None, [], [0.0, 0.0, 0.0], [1.0, None, 1.0], [1.0, 2.0], [1e-200, 0.0, 1e-200], [1e160, 1e160, 0.0], [float("nan"), 1.0, 0.0], [3e-155, 1e-155, 0.0]]
    rows = list(enumerate([*some, *odd, *some]))
    items = spark.createDataFrame(rows, "i long, v array<double>")
    queries = spark.createDataFrame(rows[100:140], "n long, q array<double>")
    monkeypatch.setattr(dense, "ITEMS", 50)
    monkeypatch.setattr(dense, "QUERIES", 16)
    monkeypatch.setattr(dense, "PAIRS", 100)
    plain = lambda df: sorted((r["n"], r["rank"], r["i"], str(r["similarity"])) for r in df.collect())
    for before, least in ((False, None), (True, 0.5)):
        found = []
        for few in (10_000, 0):
            monkeypatch.setattr(vector, "FEW", few)
            found.append(plain(vector.nearest(queries, items, 7, "n", "i", least=least, before=before)))
        assert found[0] == found[1] and len(found[0]) > 40


def test_neighbours_of_many_items_are_no_join(spark):
    items = spark.range(300).select(F.col("id").alias("i"), F.array(F.cos("id"), F.sin("id")).alias("v"))
    found = vector.nearest(items.where("i < 5").select(F.col("i").alias("n"), F.col("v").alias("q")), items, 2, "n", "i")
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan and "MapInArrow" in plan
    assert [r["i"] for r in found.where("rank = 1").orderBy("n").collect()] == [0, 1, 2, 3, 4]


def test_fold_is_that_of_one_row_at_a_time(spark, monkeypatch):
    import numpy as np

    rng = np.random.default_rng(3)
    at = rng.integers(0, 40, 400)
    made = rng.normal(size=(40, 8))[at] + rng.normal(size=(400, 8)) * rng.choice([0.0, 0.1, 0.3], 400)[:, None]
    made[7] = 0.0
    rows = [(f"p{i % 2}", i, f"n{i}", v.tolist()) for i, v in enumerate(made)]
    known = [(j, ("active", "proposed")[j % 2], made[j * 9].tolist(), 1, p) for j in range(6) for p in ("p0", "p1")]
    want = []
    for p in ("p0", "p1"):
        names, status, evidence, unit = [], [], [], []

        def add(name, how, v, names=names, status=status, evidence=evidence, unit=unit):
            names.append(name), status.append(how), evidence.append(1), unit.append(v)

        norm = lambda v: np.asarray(v) / (np.linalg.norm(v) or 1.0)
        for j, how, v, _, _ in (k for k in known if k[4] == p):
            add(str(j), how, norm(v))
        for _, i, label, v in (r for r in rows if r[0] == p):
            scores = [float(u @ norm(v)) for u in unit]
            best = max((j for j in range(len(unit)) if status[j] == "active"), key=lambda j: (scores[j], -j))
            near = max(range(len(unit)), key=lambda j: (scores[j], -j))
            if scores[best] >= 0.70:
                want.append((p, i, names[best], "deductive"))
            elif scores[near] > 0.92:
                evidence[near] += 1
                want.append((p, i, names[near], "promoted" if evidence[near] == 3 else "merged"))
            else:
                add(label, "proposed", norm(v))
                want.append((p, i, label, "new"))
    cats = spark.createDataFrame(known, "category_id long, status string, centre array<double>, evidence_count int, project_id string")
    out = ingest.assign_or_create(spark.createDataFrame(rows, "project_id string, row long, label string, embedding array<double>").repartition(5), cats)
    assert sorted(map(tuple, out.collect())) == sorted(want)
    assert {k for *_, k in want} == {"deductive", "merged", "promoted", "new"}
    monkeypatch.setattr(ingest, "FOLD", 32)
    monkeypatch.setattr(ingest, "KNOWN", 16)
    kind = "project_id string, is_candidate boolean, row long, label string, embedding array<double>, status string, evidence_count int"
    alone = [(p, c, i, label, v, how, n) for p in ("p0", "p1") for c, i, label, v, how, n in [*((False, j, str(j), v, how, n) for j, how, v, n, q in known if q == p), *((True, i, label, v, "", None) for q, i, label, v in rows if q == p)]]
    batches = spark.createDataFrame(alone, kind).coalesce(1).toArrow().to_batches(max_chunksize=70)
    assert sorted(tuple(r.values()) for b in ingest._fold(batches) for r in b.to_pylist()) == sorted(want)
    assert "FlatMapGroupsInPandas" not in out._jdf.queryExecution().optimizedPlan().toString()  # else a project is one group in memory


def test_pairs_of_queries_and_documents_are_not_shuffled(spark):
    df = spark.range(200).select(F.col("id").cast("string").alias("chunk_id"), F.lit("common words").alias("text"), F.lit("").alias("summary"))
    q = spark.range(5).select(F.col("id").alias("query_id"), F.lit("common").alias("query"))
    top = lexical.best(lexical.matches(lexical.Index.of(df), q).drop("shared"), "bm25", 3)
    assert {(r["query_id"], r["rank"], r["chunk_id"]) for r in top.collect()} == {(i, n + 1, c) for i in range(5) for n, c in enumerate(("0", "1", "10"))}
    plan = top._jdf.queryExecution().executedPlan().toString()
    by_query = [x for x in plan.split("Final Plan")[-1].splitlines() if "Exchange hashpartitioning(" in x and "query_id" in x and "chunk_id" in x.split("ENSURE")[0]]
    assert not by_query, plan
