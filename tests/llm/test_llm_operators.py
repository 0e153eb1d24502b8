"""The ten operators against brute force, exact round trips or held-out accuracy, and on the rows that break things."""

import hashlib
import itertools
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import tiktoken
from pyspark.sql import functions as F

from memlake.llm import bpe, chains, chat, graphs, lines, neardup, sharding, suffix, templates, topk, toxicity

SCHEMA = "doc_id long, text string"
#: Nulls, empty and blank texts, one word, repeated rows, a repeated id, an odd script.
ODD = [(None, None), (None, "null id"), (1, None), (2, ""), (3, " \n\t "), (4, "word"), (5, "a b c d e f g h i j"), (5, "a b c d e f g h i j"), (5, "other text"), (6, "é 中文 \U0001f600 x"), (7, "z" * 20_000), (8, "w " * 9_000)]


def table(spark, rows, schema=SCHEMA):
    return spark.createDataFrame(rows, schema)


def rows_of(df):
    return sorted(map(tuple, df.collect()), key=repr)


def sha(raw):
    return hashlib.sha256(raw).hexdigest()


# -- 1


def legal(roles):
    state = 0
    for r in roles:
        if r not in chat.NEXT[state]:
            return False
        state = r + 1
    return state == chat.END


def cheapest(roles):
    """All merges, relabels and insertions of up to two empty turns."""
    best = [chat.FAR]
    gaps = [p for n in range(3) for p in itertools.product(range(3), repeat=n)]

    def walk(i, turns, cost):
        if cost >= best[0]:
            return
        if i == len(roles):
            best[0] = min([best[0]] + [cost + 3 * len(g) for g in gaps if legal([*turns, *g])])
            return
        if turns:
            walk(i + 1, turns, cost + (1 if turns[-1] == roles[i] else 3 if roles[i] == 3 else 5))
        for g in gaps:
            for r in range(3):
                new, state = [*turns, *g, r], 0
                for x in new:
                    state = x + 1 if state is not None and x in chat.NEXT[state] else None
                if state is not None:
                    walk(i + 1, new, cost + 3 * len(g) + (0 if r == roles[i] else 2 if roles[i] == 3 else 4))

    walk(0, [], 0)
    return best[0]


def test_chat_costs_are_minimal():
    rng = random.Random(0)
    for _ in range(80):
        roles = [rng.randint(0, 3) for _ in range(rng.randint(1, 4))]
        assert chat.solve(roles, chat.START, None)[0] == cheapest(roles)
    for _ in range(50):  # cut anywhere, the chained segments cost what the whole does
        roles = [rng.randint(0, 3) for _ in range(rng.randint(2, 30))]
        parts = [roles[i : i + 4] for i in range(0, len(roles), 4)]
        states = chat.chain([chat.matrix(p) for p in parts])
        assert sum(chat.solve(p, *s)[0] + 3 * len(chat.solve(p, *s)[2]) * 0 for p, s in zip(parts, states)) == chat.solve(roles, chat.START, None)[0]


def test_chat_rendering(spark):
    rng = random.Random(1)
    rows = [(c, t if t % 5 else None, rng.choice(["user", "assistant", "SYSTEM ", None, "tool", "bot"]), None if t == 3 else f"t{c}.{t} <|im_end|>") for c in range(12) for t in range(rng.randint(1, 25))]
    rows += [(None, 0, "user", "x")] + [(99, 1, "user", "same")] * 3
    df = table(spark, rows, "conv_id long, turn long, role string, text string").withColumn("rid", F.lit("clash")).withColumn("code", F.lit(1))
    for limit in (chat.SEGMENT, 3):
        found = defaultdict(list)
        for r in chat.repaired(df, limit).collect():
            found[r["conv_id"]].append(r)
        assert sum(r["action"] != "insert" for v in found.values() for r in v) == len(rows)
        for c, pieces in found.items():
            pieces.sort(key=lambda r: (r["seq"], r["sub"]))
            assert legal([chat.ROLES.index(r["role"]) for r in pieces if not r["action"].startswith("merge")])
            text = "".join(r["rendered"] for r in pieces)
            assert text.startswith("<|im_start|>") and text.endswith("<|im_end|>\n") and text.count("<|im_start|>") == text.count("<|im_end|>")
    assert chat.repaired(df.limit(0)).isEmpty()


# -- 2


def test_templates(spark):
    item = "Then Tom has 3 apples and Tom gives 5 kg of pears to Ann every single day."
    docs = ODD + [
        (10, "Intro words. Tom has 3 apples and Tom gives 5 kg of pears to Ann every single day. End"),
        (11, "so Bob has 7.5 apples and Bob gives 9 lb of pears to Eve every single day"),
        (12, "so Bob has 7 apples and Zed gives 9 lb of pears to Eve every single day"),
        (13, "nothing of the kind is in this text about pears and apples on a single day"),
        (14, "and here one two three four five stands"),
    ]
    bench = table(spark, [(1, item), (1, item), (2, None), (3, ""), (4, "one two three four five"), (None, item)], "item_id long, text string")
    found = templates.contaminated(table(spark, docs).withColumn("t", F.lit(1)), bench).collect()
    assert sorted((r["doc_id"], r["item_id"]) for r in found) == [(10, 1), (11, 1), (14, 4)]
    slots = {s["item_value"]: s["doc_value"] for r in found if r["doc_id"] == 11 for s in r["slots"]}
    assert slots == {"Tom": "Bob", "3": "7.5", "5": "9", "kg": "lb", "Ann": "Eve"}
    assert templates.contaminated(table(spark, []), bench).isEmpty()
    assert templates.contaminated(table(spark, docs), bench.limit(0)).isEmpty()


def test_short_items_leave_long_ones_alone(spark):
    """A 4-word item beside long ones: these match by 8 words as before, and it by its own 4."""
    bench = [(1, "red kites soar over quiet northern lakes while farmers mend broken fences"), (2, "seven grey owls listen"), (3, "we saw 3 or 4 or 5 or 6 of those by the big old barn")]
    docs = [(1, "yes farmers mend broken fences in spring"), (2, "there seven grey owls listen at night"), (3, "so red kites soar over quiet northern lakes while it rains"), (4, "it was 8 or 9 or 7 or 2 in all"), (5, "nothing here at all to see")]
    found = templates.contaminated(table(spark, docs), table(spark, bench, "item_id long, text string")).collect()
    assert sorted((r["doc_id"], r["item_id"], r["n_windows"], r["n_words"]) for r in found) == [(2, 2, 1, 4), (3, 1, 1, 8)]


def test_verbatim_windows_count(spark):
    """Copies rich in numbers and names, very short items, and a long copy of which one repeated number differs."""
    tail = "while the old river keeps running slowly past our quiet village mill towards 7 distant hills"
    bench = [(1, "Compute 17 + 25 - 9."), (2, "Zanzibar"), (3, f"first take 7 coins {tail}"), (4, "Add 3 4 5 6 7 8 9 10 now")]
    docs = [(1, "please compute 17 + 25 - 9. thanks"), (2, "please compute 17 + 25 - 8. thanks"), (3, "the zanzibar coast"), (4, f"first take 6 coins {tail}"), (5, "then add 3 4 5 6 7 8 9 10 now"), (6, "then add 3 4 5 6 7 8 8 10 now")]
    found = templates.contaminated(table(spark, docs), table(spark, bench, "item_id long, text string")).collect()
    assert sorted((r["doc_id"], r["item_id"]) for r in found) == [(1, 1), (3, 2), (4, 3), (5, 4)]


def test_both_forms_make_the_same_template_words(spark):
    rng = random.Random(15)
    parts = ["Tom", "tom", "É", "Éa", "élan", "mm", "Kg", "KG", "12", "3.5", "1,2,", "٣", "%", "€", ".", "!", ":", "\n", " ", " ", " ", ", ", "'", "-", "_x", "a1", "N", "Ab", "aB", "日本", "\u0301", "5kg", "\ue001", "ß"]
    rows = [(i, "".join(rng.choice(parts) for _ in range(rng.randint(0, 25)))) for i in range(3000)] + [(5000, None)]
    df = table(spark, rows)
    names = F.create_map(*(F.lit(x) for kv in ((templates._N, "#n"), (templates._U, "#u"), (templates._P, "#p")) for x in kv))
    short = df.select("doc_id", F.transform(templates.canonical(F.col("text")), lambda x: F.coalesce(F.element_at(names, x), x)).alias("a"))
    whole = templates.templated(df.where("text IS NOT NULL")).select("doc_id", F.transform("t", lambda s: s["c"]).alias("b"))
    both = short.join(whole, "doc_id")
    assert both.count() == 3000 and [tuple(r) for r in both.where("a <> b").limit(3).collect()] == []


def brute_templates(docs, bench):
    """Windows by comparing every position of every document with every one of each item, in plain Python."""
    import regex

    def words(text):
        found, out, before = regex.findall(templates._WORDS, text), [], None
        for x in found:
            low = x.lower()
            kind = "n" if regex.match(r"\p{N}", x) else "p" if regex.match(r"\p{Lu}\p{Ll}", x) else None
            unit = before and before[1] == "n" and (low in templates.UNITS or x in templates.SIGNS)
            name = kind == "p" and before and before[0] not in templates.STOPS
            if unit or x not in templates.STOPS + templates.SIGNS:
                out.append(("#n" if kind == "n" else "#u" if unit else "#p" if name else low, x))
            before = (x, kind)
        return out

    out = set()
    for item, text in bench:
        a = words(text)
        width = min(len(a), templates.WIDTH)
        for doc, other in docs:
            b, matched = words(other), defaultdict(list)
            for i in range(len(a) - width + 1 if width else 0):
                for j in range(len(b) - width + 1):
                    if [x for x, _ in a[i : i + width]] == [x for x, _ in b[j : j + width]]:
                        matched[j - i].append(i)
            for shift, at in matched.items():
                literal = lambda i: sum(not x.startswith("#") for x, _ in a[i : i + width])
                rich = [i for i in at if literal(i) >= max(templates.LEAST, -(-width // 2))]
                slots = {(a[p][1], b[p + shift][1]) for i in rich for p in range(i, i + width) if a[p][0].startswith("#")}
                agree = len(slots) == len({x for x, _ in slots})
                exact = [i for i in at if all(a[p][1] == b[p + shift][1] for p in range(i, i + width) if a[p][0].startswith("#"))]
                if kept := set(exact) | (set(rich) if agree else set()):
                    out.add((doc, item, shift, len(kept)))
    return out


def test_contamination_is_what_brute_force_finds(spark):
    rng = random.Random(16)
    words = ["the", "red", "Tom", "Ann", "kg", "7", "12", "has", "pears", "of", ".", "and", "3.5", "near", "old"]
    text = lambda n: " ".join(rng.choice(words) for _ in range(n))
    bench = [(i, text(rng.randint(1, 14))) for i in range(12)]
    docs = []
    for i in range(120):
        quoted = " ".join(rng.choice(["Tom", "Ann", "7", "12"]) if w in ("Tom", "Ann", "7", "12") and rng.random() < 0.4 else w for w in rng.choice(bench)[1].split())
        docs.append((i, f"{text(rng.randint(0, 6))} {quoted} {text(rng.randint(0, 6))}"))
    found = templates.contaminated(table(spark, docs), table(spark, bench, "item_id long, text string")).collect()
    got = {(r["doc_id"], r["item_id"], r["doc_at"] - r["item_at"], r["n_windows"]) for r in found}
    want = brute_templates(docs, bench)
    assert got == want and len({d for d, *_ in want}) > 40


# -- 3


def brute_near(rows, width, percent=80):
    sets = []
    for i, t in rows:
        w = (t or "").encode().lower().split()
        sets.append((i, frozenset(tuple(w[j : j + width]) for j in range(max(1, len(w) - width + 1))) if w else frozenset()))
    group = list(range(len(sets)))

    def root(x):
        while group[x] != x:
            x = group[x]
        return x

    for a in range(len(sets)):
        for b in range(a):
            x, y = sets[a][1], sets[b][1]
            if x and y and 100 * len(x & y) >= percent * len(x | y):
                group[root(a)] = root(b)
    least = defaultdict(list)
    for a, (i, s) in enumerate(sets):
        least[root(a)].append(i)
    name = {r: min((i for i in v if i is not None), default=None) for r, v in least.items()}
    return sorted(((i, len(s), name[root(a)] if s else i, (i == name[root(a)]) if s else True) for a, (i, s) in enumerate(sets)), key=repr)


def near_rows():
    rng = random.Random(5)
    vocabulary = [f"w{i}" for i in range(400)]
    shared = [rng.choice(vocabulary) for _ in range(40)]
    rows = list(ODD)
    for i in range(100, 130):
        base = [rng.choice(vocabulary) for _ in range(rng.randint(3, 120))]
        if i % 3 == 0:
            base[2:2] = shared
        for k in range(rng.randint(1, 5)):
            copy = list(base)
            for _ in range(rng.randint(0, len(base) // 20)):
                copy[rng.randrange(len(copy))] = rng.choice(vocabulary)
            rows.append((i * 10 + k, " ".join(copy)))
    return rows


@pytest.mark.parametrize("width", [4, 5])
def test_near_duplicates(spark, width):
    rows = near_rows()
    df = table(spark, rows).withColumns({"n": F.lit(0), "node": F.lit(0), "root": F.lit(0)})
    got = rows_of(neardup.near_duplicates(df, width).select("doc_id", "n_shingles", "component_id", "kept"))
    assert got == brute_near(rows, width)


def test_near_duplicate_stage(spark):
    df = table(spark, ODD + [(20, "A b c d e f g h i j")]).withColumn("kept", F.lit("clash"))
    left = neardup.stage(spark, df, "")
    assert left.columns == df.columns
    ids = Counter(r["doc_id"] for r in left.collect())
    assert 20 not in ids and ids[5] == 2 and ids[1] == ids[2] == ids[3] == 1
    assert neardup.stage(spark, df.limit(0), "").isEmpty()


def test_crowded_lists_lose_no_link():
    import pandas as pd

    rng = np.random.default_rng(0)
    common = rng.integers(0, 1 << 60, 45)
    sets = [np.unique(np.concatenate([common[: 45 - k], rng.integers(0, 1 << 60, k)])) for k in (0, 2, 3, 4, 20, 30)]
    rows = [(1, 0, i, i, len(s), 2, s) for i, s in enumerate(sets)]
    out = neardup._across(80)(pd.DataFrame(rows, columns=["value", "cell", "node", "root", "n", "side", "sketch"]))
    want = {(i, j) for i in range(6) for j in range(i + 1, 6) if 100 * len(np.intersect1d(sets[i], sets[j])) >= 80 * len(np.union1d(sets[i], sets[j]))}
    assert set(zip(out["a"], out["b"])) == want and len(want) >= 6


def test_crowds_are_not_compared_all_with_all(spark, monkeypatch):
    """Many variants of one text around the threshold: every link is found, and pairs to verify follow the documents."""
    rng = random.Random(9)
    base = [f"w{rng.randrange(3000)}" for _ in range(300)]
    rows = []
    for i in range(400):
        copy = list(base)
        for _ in range(rng.randint(0, 36)):
            copy[rng.randrange(300)] = f"x{rng.randrange(10**9)}"
        rows.append((i, " ".join(copy)))
    pairs, written = [], neardup.written

    def counted(df):
        out = written(df)
        pairs.extend([out.count()] if out.columns == ["a", "b", "similar"] else [])
        return out

    monkeypatch.setattr(neardup, "written", counted)
    got = rows_of(neardup.near_duplicates(table(spark, rows), 4).select("doc_id", "n_shingles", "component_id", "kept"))
    assert got == brute_near(rows, 4)
    assert sum(pairs) < 20 * len(rows)


def test_components(spark):
    rng = random.Random(2)
    links = [(rng.randrange(200), rng.randrange(200)) for _ in range(150)] + [(1000 + i, 1001 + i) for i in range(40)]
    group = {}

    def root(x):
        while group.setdefault(x, x) != x:
            x = group[x]
        return x

    for a, b in links:
        if a != b:
            x, y = root(a), root(b)
            group[max(x, y)] = min(x, y)
    assert rows_of(graphs.components(table(spark, links, "a long, b long"))) == sorted(((x, root(x)) for x in list(group)), key=repr)


# -- 4


def test_toxicity(spark):
    rng = random.Random(3)
    plain, bad = [f"{a}{b}" for a in ("tor", "lin", "mes", "rak", "fon") for b in ("ada", "eli", "ono", "usa")], ["grumbold", "vexnatter", "skrelling"]
    rows, labels = [], []
    for i in range(900):
        text = [rng.choice(plain) for _ in range(rng.randint(5, 150))]
        toxic = i % 4 == 0
        if toxic:
            word = rng.choice(bad)
            text[rng.randrange(len(text))] = word if i % 8 else word[:-1] + rng.choice("xyz")
        rows.append((i, " ".join(text)))
        labels.append((i, int(toxic)))
    docs, marked = table(spark, rows), table(spark, labels + [(3, None), (None, 1)], "doc_id long, toxic int")
    model = toxicity.fit(docs, marked)
    scored = {r["doc_id"]: r["score"] for r in toxicity.score(docs, model).collect()}
    held = [i for i, _ in rows if zlib.crc32(str(i).encode()) % 3 == 1]
    right = sum((scored[i] >= toxicity.THRESHOLD) == (i % 4 == 0) for i in held)
    assert len(held) > 200 and right / len(held) > 0.97
    assert model.score("grumbbold") > model.score("toradab")
    odd = toxicity.score(table(spark, ODD).withColumn("score", F.lit("clash")), model).collect()
    assert len(odd) == len(ODD) and all(0 <= r["score"] <= 1 for r in odd)
    assert toxicity.fit(docs, marked.limit(0)).score("x") == 0
    assert toxicity.score(docs.limit(0), model).isEmpty()


# -- 5


def test_bpe(spark):
    path, pattern = bpe.default_ranks()
    codec = bpe.codec(path, pattern)
    rng = random.Random(4)
    texts = ["".join(rng.choice(" \n\t'sabé1٣!\x1c\x85\xa0 中ſ") for _ in range(rng.randint(0, 30))) for _ in range(2000)]
    texts += [("ab" + s * n + tail) for s in (" ", "\n", "\t ") for n in (900, 1500) for tail in ("", "x", " \nx", "1")]
    texts += ["word " * 40_000, "x" * 100_000, " " * 300_000 + "y", "<|endoftext|>"]
    for t in texts:
        ids = codec.encode(t)
        if len(t) < 200_000:
            assert ids.tolist() == codec._ordinary(t)
        assert codec.decode(ids) == t.encode()
    assert tiktoken.__version__
    df = table(spark, ODD).withColumn("ids", F.lit("clash"))
    got = rows_of(bpe.digests(table(spark, ODD), path, pattern))
    want = [(i, len(x := codec.encode(t or "")), sha(",".join(map(str, x)).encode()), sha((t or "").encode())) for i, t in ODD]
    assert got == sorted(want, key=repr)
    back = bpe.decode(bpe.encode(df, path, pattern), path, pattern).collect()
    assert all(bytes(r["decoded"]) == (r["text"] or "").encode() for r in back)
    assert bpe.digests(table(spark, []), path, pattern).isEmpty()
    bad = spark.sql("SELECT 1L AS doc_id, cast(X'61FF62' AS string) AS text")  # not UTF-8
    assert bpe.digests(bad, path, pattern).first()["decoded_sha256"] == sha("a\ufffdb".encode())


def test_bpe_emits_bounded_batches(monkeypatch, spark):
    path, pattern = bpe.default_ranks()
    monkeypatch.setattr(bpe, "HELD", 50)
    rows = [(i, "some words of a text " * (i % 7)) for i in range(40)] + [(99, None)]
    got = {r["doc_id"]: r["ids"] for r in bpe.encode(table(spark, rows), path, pattern).collect()}
    assert got == {i: bpe.codec(path, pattern).encode(t or "").tolist() for i, t in rows}


# -- 6


def brute_lines(rows):
    """Lines left of each document: those of runs that start earlier go."""
    seen, out = set(), []
    for i, t in sorted(rows, key=lambda r: r[0]):
        if t is None:
            out.append((i, None))
            continue
        found = t.split("\n")
        gone = set()
        for j in range(len(found) - lines.RUN + 1):
            run = tuple(found[j : j + lines.RUN])
            gone |= set(range(j, j + lines.RUN)) if run in seen else set()
            seen.add(run)
        for j, x in enumerate(found):
            if len(x) >= lines.LONG:
                gone |= {j} if x in seen else set()
                seen.add(x)
        out.append((i, "\n".join(x for j, x in enumerate(found) if j not in gone)))
    return sorted(out, key=repr)


def test_line_dedup(spark):
    rng = random.Random(6)
    rows = [(i, "\n".join(rng.choice("abcde") for _ in range(rng.randint(0, 12)))) for i in range(60)] + [(70, None), (71, ""), (72, "x\n" * 400), (73, "x\n" * 400)]
    long = ["".join(rng.choice("abc ") for _ in range(n)) for n in (lines.LONG - 1, lines.LONG, 300)]
    rows += [(80 + i, "\n".join(rng.choice([*long, "a", "b"]) for _ in range(rng.randint(1, 4)))) for i in range(15)]
    df = table(spark, rows).withColumns({"at": F.lit(1), "run": F.lit(1), "n_chars": F.length("text").cast("long")})
    got = lines.deduplicated(df)
    assert rows_of(got.select("doc_id", "text")) == brute_lines(rows)
    left = lines.stage(spark, df, "")
    assert left.columns == df.columns and {r["doc_id"] for r in left.collect()} >= {0, 70, 71, 72}
    odd = lines.deduplicated(table(spark, [*ODD, (90, "p\nq\nr"), (90, "p\nq\nr"), (None, "p\nq\nr")])).collect()
    assert len(odd) == len(ODD) + 3 and sorted(r["memlake_kept"] for r in odd if r["text"] in ("p\nq\nr", "") and r["doc_id"] in (90, None)) == [0, 0, 3]
    assert lines.deduplicated(df.limit(0)).isEmpty()


def test_line_dedup_has_one_plan_for_all_sizes(spark):
    """Texts meet their runs by a sort-merge join, however few the runs are."""
    rows = [(i, "p\nq\nr") for i in range(20)]
    out = lines.deduplicated(table(spark, rows))
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "BroadcastHashJoin" not in plan


def test_only_window_minima_are_kept(spark):
    """Fewer fingerprints than grams, one of every two neighbouring grams at least, and matches extended both ways."""
    rng = random.Random(13)
    rows = [(i, "\n".join(rng.choice("abcdefgh") + rng.choice("xyz") for _ in range(40))) for i in range(20)]
    split = F.split("text", "\n", -1)
    lined = table(spark, rows).select(F.col("doc_id").alias("ord"), F.col("doc_id").alias("rid"), F.transform(split, lambda x: F.xxhash64(x)).alias("h"), F.transform(split, lambda x: F.xxhash64(x, F.lit(1))).alias("g"))
    at = defaultdict(set)
    for r in lines._fingerprints(lined).collect():
        at[r["ord"]].add(r["at"])
    assert sum(map(len, at.values())) < 0.8 * 20 * 39
    assert all(j in x or j + 1 in x for x in at.values() for j in range(38))
    block = [f"line {i}" for i in range(9)]
    docs = [(1, "\n".join(["p", *block, "q"])), (2, "\n".join(["r", *block[:5], "s"])), (3, "\n".join(["t", *block[4:], "u"]))]
    assert {r["doc_id"]: r["text"] for r in lines.deduplicated(table(spark, docs)).collect()} == {1: docs[0][1], 2: "r\ns", 3: "t\nu"}


# -- 7


def brute_bytes(rows):
    seen, out = set(), []
    for i, t in sorted(rows, key=lambda r: r[0]):
        raw = (t or "").encode()
        gone = np.zeros(len(raw), bool)
        for j in range(len(raw) - suffix.LENGTH + 1):
            window = raw[j : j + suffix.LENGTH]
            if window in seen:
                gone[j : j + suffix.LENGTH] = True
            seen.add(window)
        spans = int((gone & ~np.concatenate([[False], gone[:-1]])).sum()) if len(gone) else 0
        out.append((i, len(raw), int(gone.sum()), spans, sha(bytes(np.frombuffer(raw, np.uint8)[~gone]))))
    return sorted(out, key=repr)


def byte_rows():
    rng = random.Random(3)
    pool = ["".join(rng.choice("ab cdé") for _ in range(rng.randint(90, 260))) for _ in range(8)]
    rows = []
    for i in range(60):
        parts = []
        for _ in range(rng.randint(0, 5)):
            kind = rng.random()
            p = rng.choice(pool)
            parts.append(p[rng.randint(0, 40) : len(p) - rng.randint(0, 40)] if kind < 0.5 else "a" * rng.randint(50, 300) if kind < 0.65 else "xyz" * rng.randint(10, 90) if kind < 0.8 else "".join(rng.choice("abcdefgh") for _ in range(150)))
        rows.append((i, "".join(parts)))
    return [*rows, (200, None), (201, ""), (202, "a" * 3000)]


@pytest.mark.parametrize("shard", [suffix.SHARD, 2000])
def test_suffix_arrays(spark, shard):
    rows = byte_rows()
    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"
    df = table(spark, rows).withColumns({"rid": F.lit(1), "anchor": F.lit(1)}).repartition(5)
    assert rows_of(suffix.deduplicated(df, shard).mapInArrow(suffix._digest, schema)) == brute_bytes(rows)
    if shard == suffix.SHARD:
        assert suffix.deduplicated(df.limit(0)).isEmpty()
        assert suffix.deduplicated(table(spark, ODD)).count() == len(ODD)


def test_suffix_array_and_common_prefixes():
    rng = np.random.default_rng(1)
    for n in (1, 2, 50, 300):
        for text in (rng.integers(0, 3, n).astype(np.uint8), np.zeros(n, np.uint8)):
            sa, half, again, known = suffix.suffix_array(text)
            raw = text.tolist()
            assert sa.tolist() == sorted(range(n), key=lambda i: raw[i:])
            true = [0]
            for i in range(1, n):
                a, b = raw[sa[i - 1] :], raw[sa[i] :]
                true.append(min(suffix.LENGTH, next((k for k, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))))
            assert suffix.common_prefixes(text, sa, np.arange(1, n)).tolist() == true[1:]
            assert half[again].tolist() == [i for i in range(n) if true[i] >= known]
            assert suffix.common_prefixes(text, sa, half[again], known).tolist() == [x for x in true if x >= known]


def test_repeats_across_shards(spark):
    """Each document is a shard of its own, so that only the merge can find what they share; equal rows cost one."""
    rng = random.Random(14)
    letters = lambda n: "".join(rng.choice("abcdefgh ") for _ in range(n))
    shared = letters(400)
    rows = [(i, letters(150) + shared[i * 20 : i * 20 + 200] + letters(150)) for i in range(8)]
    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"
    got = rows_of(suffix.deduplicated(table(spark, rows).repartition(8), 300).mapInArrow(suffix._digest, schema))
    assert got == brute_bytes(rows) and sum(r[2] for r in got) > 1000
    same = table(spark, [(1, shared)] + [(2, shared + "x")] * 300).repartition(4)
    found = suffix.deduplicated(same).collect()
    assert len(found) == 301 and max(len(r["runs"] or []) for r in found) < 20


# -- 8


def test_chaining(spark):
    rng = random.Random(7)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(5))
    passage = [word() for _ in range(80)]
    fuzzy = [w if i % 17 else word() for i, w in enumerate(passage) if i % 29]
    other = [word() for _ in range(40)]
    text = lambda middle: " ".join([word() for _ in range(30)] + middle + [word() for _ in range(30)])
    rows = [*ODD, (20, text(passage)), (21, text(passage)), (22, text(fuzzy)), (23, text(other)), (24, text(other)), (25, text([]))]
    df = table(spark, rows).withColumns({"rid": F.lit(1), "seed": F.lit(1)})
    found = {r["doc_id"]: r for r in chains.passages(df).collect()}
    assert set(found) == {21, 22} and found[21]["source_ids"] == [20]
    assert found[21]["start_word"] == 30 and found[21]["n_words"] == 80 and found[21]["identity"] == 1
    assert 65 <= found[22]["n_words"] <= 85 and 0.8 <= found[22]["identity"] < 1
    assert chains.passages(df.limit(0)).isEmpty()


def test_chains_follow_gap_costs():
    rng = random.Random(8)
    for _ in range(60):
        m = sorted({(rng.randint(0, 60), rng.randint(0, 60)) for _ in range(rng.randint(2, 14))})
        score = {}
        for x, y in m:  # quadratic programme without the tree
            best = max((score[a, b] - chains.GAP * (x - a + y - b) for a, b in score if a < x and b < y), default=0)
            score[x, y] = 1 + best if best > 0 else 1.0
        found = chains.chains(m)
        top = max((len(c) - chains.GAP * (c[-1][0] - c[0][0] + c[-1][1] - c[0][1]) for c in found), default=1)
        if all(q[0] - p[0] <= chains.JUMP and q[1] - p[1] <= chains.JUMP for p in m for q in m):
            assert top == pytest.approx(max(max(score.values()), top)) or not found
        for c in found:
            assert all(p[0] < q[0] and p[1] < q[1] for p, q in itertools.pairwise(c))


@pytest.mark.parametrize("apart", [50, 60, 200, 1000])
def test_chains_on_both_sides_of_a_gap(apart):
    """A passage after the gap is chained, however good the chain before it is; against a quadratic programme."""
    first = [(5 * i, 5 * i) for i in range(200)]
    second = [(1000 + apart + 5 * i, 1000 + apart + 7 + 5 * i) for i in range(30)]
    found = sorted(chains.chains(first + second), key=len)
    assert found == [second, first]
    rng = random.Random(apart)
    for _ in range(40):
        m = sorted({(rng.randint(0, 300), rng.randint(0, 300)) for _ in range(rng.randint(2, 60))})
        score = {}
        for x, y in m:
            near = [score[a, b] - chains.GAP * (x - a + y - b) for a, b in score if 0 < x - a <= chains.JUMP and 0 < y - b <= chains.JUMP]
            score[x, y] = 1 + max(near, default=0) if max(near, default=0) > 0 else 1.0
        top = max((len(c) - chains.GAP * (c[-1][0] - c[0][0] + c[-1][1] - c[0][1]) for c in chains.chains(m)), default=1)
        assert top == pytest.approx(max(score.values()))


def test_chaining_across_a_replaced_block(spark):
    """Two documents, equal but for 60 words in the middle: both halves are reported."""
    rng = random.Random(11)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(5))
    left, right = [word() for _ in range(1000)], [word() for _ in range(1000)]
    rows = [(i, " ".join(left + [word() for _ in range(60)] + right)) for i in (1, 2)]
    found = sorted((r["start_word"], r["n_words"]) for r in chains.passages(table(spark, rows)).collect())
    assert found == [(0, 1000), (1060, 1000)]


def test_chaining_finds_every_copy(spark):
    """A passage that a later document holds twice, or that it has begun to quote before."""
    rng = random.Random(12)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(5))
    words = lambda n: [word() for _ in range(n)]
    passage = words(60)
    rows = [(1, words(30) + passage + words(30)), (2, words(30) + passage + words(100) + passage + words(30)), (3, words(30) + passage[:40] + words(100) + passage + words(30))]
    found = sorted((r["doc_id"], r["start_word"], r["n_words"]) for r in chains.passages(table(spark, [(i, " ".join(w)) for i, w in rows])).collect())
    assert found == [(2, 30, 60), (2, 190, 60), (3, 170, 60)]


def test_chaining_finds_passages_of_scattered_firsts(spark):
    """Every stretch of 12 words was in some earlier document, but only one of them holds the whole passage."""
    rng = random.Random(14)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(5))
    words = lambda n: [word() for _ in range(n)]
    passage = words(72)
    scattered = [(i, words(20) + passage[6 * i : 6 * i + 12] + words(20)) for i in range(11)]
    rows = [*scattered, (20, words(30) + passage + words(30)), (21, words(40) + passage + words(10)), (22, words(60))]
    found = {r["doc_id"]: r for r in chains.passages(table(spark, [(i, " ".join(w)) for i, w in rows])).collect()}
    assert set(found) == {21} and found[21]["source_ids"] == [20]
    assert (found[21]["start_word"], found[21]["n_words"], found[21]["identity"]) == (40, 72, 1)


def test_edit_distance():
    def plain(a, b):
        d = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            d = [i] + [0] * len(b) if not (e := d) else [i] + list(itertools.repeat(0, len(b)))
            for j, y in enumerate(b, 1):
                d[j] = min(e[j] + 1, d[j - 1] + 1, e[j - 1] + (x != y))
        return d[-1]

    rng = np.random.default_rng(0)
    for _ in range(100):
        a, b = rng.integers(0, 3, rng.integers(0, 9)), rng.integers(0, 3, rng.integers(0, 9))
        assert chains.distance(a, b) == plain(a.tolist(), b.tolist())


# -- 9


def test_best_fit_decreasing():
    rng = random.Random(9)
    for _ in range(40):
        sizes, capacity = [rng.randint(1, 60) for _ in range(rng.randint(1, 60))], 60
        at, room = sharding.pack(sizes, capacity), []
        for i in sorted(range(len(sizes)), key=lambda i: (-sizes[i], i)):  # the same by looking at every bin
            fits = [(r, b) for b, r in enumerate(room) if r >= sizes[i]]
            b = min(fits)[1] if fits else len(room)
            if not fits:
                room.append(capacity)
            room[b] -= sizes[i]
            assert at[i] == b


def test_shards(spark):
    rng = random.Random(10)
    rows = [(i, "x" * rng.randint(0, 400) + str(i % 90)) for i in range(300)] + [(1000 + i, "copy " * 30) for i in range(250)] + ODD[:9]
    got = sharding.shards(table(spark, rows).withColumns({"shard": F.lit(1), "piece": F.lit(1)}), 6, 64).collect()
    assert len(got) == len(rows)
    load, slots, where = Counter(), defaultdict(list), defaultdict(set)
    crc = lambda t: zlib.crc32((t or "").encode())
    for r in got:
        load[r["shard"]] += r["size"]
        slots[r["shard"]].append(r["slot"])
        where[r["text_crc32"]].add(r["shard"])
    assert set(load) <= set(range(6)) and max(load.values()) < 1.05 * min(load.values())
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert all(len(s) == 1 for c, s in where.items() if c != crc("copy " * 30))
    assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in got) == Counter((i, len((t or "").encode()) + 8, crc(t)) for i, t in rows)
    assert sharding.shards(table(spark, []), 6).isEmpty()


# -- 10


def brute_top(rows, every, k=5):
    whole = [(i, topk.quantised([float(np.float32(x)) for x in v])) for i, v in rows]
    out = []
    for i, q in whole:
        if i % every == 0:
            best = sorted((-sum(a * b for a, b in zip(q, v)), j) for j, v in whole if j != i)[:k]
            out += [(i, r, j, -s) for r, (s, j) in enumerate(best, 1)]
    return sorted(out, key=repr)


@pytest.mark.parametrize("dim,n", [(1, 300), (3, 400), (8, 200)])
def test_top_k(spark, monkeypatch, dim, n):
    rng = np.random.default_rng(dim)
    rows = [(int(i // 2), [float(x) for x in v]) for i, v in enumerate(rng.normal(size=(n, dim)))]
    rows += [(6, []), (n + 1, [70000.0] * dim), (n + 2, [0.0] * dim), (n + 3, [1.5] * (dim + 2)), (20, [-3.0])]
    bad = [(5, None), (7, [float("nan")] * dim), (8, [None] * dim), (9, [float("inf")] * dim), (None, [0.0] * dim)]
    for block in (topk.BLOCK, 64):
        monkeypatch.setattr(topk, "BLOCK", block)
        df = table(spark, [(*r, "") for r in rows + bad], "vec_id long, embedding array<float>, score string")
        assert rows_of(topk.top_k(df, F.col("vec_id") % 10 == 0, 5)) == brute_top(rows, 10)
    assert topk.top_k(df.limit(0), F.col("vec_id") % 10 == 0, 5).isEmpty()


def test_bounds_end_the_reading():
    """In few dimensions the threshold decides nearly every query, in many the rows run out; the answers are exact."""
    rng = np.random.default_rng(0)
    for dim, least in ((2, 30), (16, 0)):
        x = np.floor(rng.normal(size=(3000, dim)) * 50).astype(np.int64)
        block = topk.Lists(np.arange(3000), list(x))
        found = [block.top(i, x[i], 5) for i in range(40)]
        assert sum(f[3] for f in found) >= least and all(f[2] < 3000 for f in found)
        for i, f in enumerate(found):
            assert list(zip([-s for s in f[1]], f[0])) == sorted((-int(x[i] @ v), j) for j, v in enumerate(x) if j != i)[:5]


def test_scores_beyond_floats_are_exact():
    vectors = [np.array(v, object) for v in ([1 << 40, 3], [(1 << 40) + 1, 3], [1 << 40, 2], [-(1 << 40), 0])]
    assert topk.Lists(np.arange(4), vectors).top(9, np.array([1 << 40, 1], object), 4)[:2] == ([1, 0, 2, 3], [(1 << 80) + (1 << 40) + 3, (1 << 80) + 3, (1 << 80) + 2, -(1 << 80)])
    assert topk.quantised([0.5, -0.001, 1e305]) == [128, -1, int(1e305) * 256]
    assert topk.unpacked(topk.packed([1 << 70, -2])).tolist() == [1 << 70, -2]
