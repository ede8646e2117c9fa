"""Cross-validation, exclusive assignment, batched propagation, decoding and page reading against plain versions."""

import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpuslens.operators import decoding, graphs, matching, sequences, validation

CUT = lambda df: df.checkpoint()


def levenshtein(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, before = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(before[j] + 1, row[-1] + 1, before[j - 1] + (x != y)))
    return row[-1]


def test_group_scores_match_refits(spark):
    rng = random.Random(1)
    units = [(f"u{i}", rng.choice(["x", "y", "z", None]), rng.randrange(3)) for i in range(60)]
    feats = {(u, f"f{rng.randrange(12)}", rng.choice([1, 2])) for u, _, _ in units for _ in range(3) if u != "u7"}
    feats = {(u, f"{f}.{g}", g) for u, f, g in feats}
    got = validation.group_scores(spark.createDataFrame(units, "unit string, label string, fold int"), spark.createDataFrame(sorted(feats), "unit string, feature string, grp int"), 3, [1, 2]).collect()
    of = defaultdict(set)
    for u, f, g in feats:
        of[u].add((g, f))
    every = sorted({(g, f) for _, f, g in feats})
    labels = sorted({y for _, y, _ in units}, key=str)
    assert len(got) == len(units) * len(labels)
    for r in got:
        rest = [u for u, y, k in units if y == r["label"] and k != r["fold"]]
        assert abs(r["prior"] - math.log(len(rest) + 1)) < 1e-9
        for part, g in zip(r["parts"], (1, 2)):
            want = 0.0
            for x in every:
                if x[0] == g:
                    n1 = sum(x in of[u] for u in rest)
                    want += math.log(((n1 if x in of[r["unit"]] else len(rest) - n1) + 1) / (len(rest) + 2))
            assert abs(part - want) < 1e-9


def test_chosen_takes_the_smaller_label_of_equals(spark):
    s = spark.createDataFrame([("a", "y", 1.0), ("a", "x", 1.0), ("a", "z", 0.0)], "unit string, label string, s double")
    r = validation.chosen(s, F.col("s"), "unit").first()
    assert r["label"] == "x" and abs(r["conf"] - 1 / (2 + math.exp(-1))) < 1e-12


@pytest.mark.parametrize("seed", range(3))
def test_exclusive_is_greedy_assignment(spark, seed):
    rng = random.Random(seed)
    edges = {(a, b): rng.choice([0.25, 0.5, 0.5, 1.0]) for a in range(20) for b in range(20) if rng.random() < 0.3}
    edges.update({(0, b): 0.9 for b in range(20)})  # an end of many edges
    got = matching.exclusive(spark.createDataFrame([(a, b, s) for (a, b), s in edges.items()], "a long, b long, s double"), "a", "b", "s", CUT).collect()
    free_a, free_b, want = set(range(20)), set(range(20)), set()
    for (a, b), s in sorted(edges.items(), key=lambda e: (-e[1], e[0])):
        if a in free_a and b in free_b:
            want.add((a, b, s))
            free_a.discard(a), free_b.discard(b)
    assert {tuple(r) for r in got} == want
    assert matching.exclusive(spark.createDataFrame([], "a long, b long, s double"), "a", "b", "s", CUT).collect() == []


def test_propagation_of_all_folds_is_that_of_each(spark):
    rng = np.random.default_rng(2)
    n, names, folds, rounds = 30, [0, 1, 2], 3, 7
    pairs = {(int(a), int(b)): float(w) for a, b, w in zip(rng.integers(0, n, 90), rng.integers(0, n, 90), rng.random(90)) if a != b}
    edges = graphs.symmetric(spark.createDataFrame([(a, b, w) for (a, b), w in pairs.items()], "src long, dst long, w double"))
    labels = [(i, int(rng.integers(0, 3)), int(rng.integers(0, 3))) for i in range(n)]
    got = {r["id"]: r["f"] for r in graphs.propagate_folds(edges, spark.createDataFrame(labels, "id long, label int, fold int"), names, folds, rounds=rounds, cut=CUT).collect()}
    s = np.zeros((n, n))
    for r in edges.collect():
        s[r["src"], r["dst"]] = r["p"]
    for k in range(folds):
        y = np.zeros((n, 3))
        for i, label, fold in labels:
            y[i, label] = fold != k
        f = y.copy()
        for _ in range(rounds):
            f = 0.85 * s @ f + 0.15 * y
        for i in range(n):
            assert np.allclose(got[i][k * 3:k * 3 + 3], f[i], atol=1e-12)
        # One fold's run by itself says the same.
        seeds = spark.createDataFrame([(i, label) for i, label, fold in labels if fold != k], "id long, label int")
        one = {(r["id"], r["label"]): r["f"] for r in graphs.propagate(edges, seeds, "label", rounds=rounds, cut=CUT).collect()}
        assert all(abs(got[i][k * 3 + label] - x) < 1e-12 for (i, label), x in one.items())


@pytest.mark.parametrize("seed", range(2))
def test_nearest_is_a_comparison_of_all_pairs(spark, seed):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choices("abcdei", k=rng.randint(3, 8)))
    forms = sorted({word() for _ in range(400)}) + ["é", ""]
    probes = rng.sample(forms[:400], 12) + [word() for _ in range(12)]
    bare = lambda w: re.sub("[aeiou]", "", w)
    like = lambda a, b: 1 - levenshtein(a, b) / max(len(a), len(b))
    got = matching.nearest(spark.createDataFrame([(p,) for p in probes], "p string"), spark.createDataFrame([(f,) for f in forms], "f string"), "p", "f", lambda c: F.regexp_replace(c, "[aeiou]", "")).collect()
    want = set()
    for p in set(probes):
        sims = []
        for f in set(forms) - {""}:
            s = max([x for x in (like(p, f), like(bare(p), bare(f)) if len(bare(p)) >= 2 and bare(f) else 0) if x >= 0.7 - 1e-12], default=None)
            if s is not None:
                sims.append((-round(s, 9), f))
        want |= {(p, f, i + 1) for i, (_, f) in enumerate(sorted(sims)[:5])}
    assert {(r["p"], r["f"], r["rank"]) for r in got} == want


def test_decided_by_the_lexicon(spark):
    tokens = spark.createDataFrame([("w0rd",), ("w1ne",), ("11",), ("a5k",), ("--",), ("0ld",), ("8ig",), ("plain",), (None,), ("6a",)], "token string")
    lexicon = spark.createDataFrame([("word",), ("wine",), ("wlne",), ("fig",), ("θig",), ("",)], "w string")
    got = {r["token"]: (r["decoded"], r["flag"]) for r in decoding.decided(tokens, lexicon, {"8": ("f", "θ"), "0": ("o", "θ"), "1": ("i", "l"), "5": ("s",)}, {"6": "θ", "9": "θ"}).collect()}
    assert got == {"w0rd": ("word", "ocr-fixed"), "w1ne": ("wine", "ocr?"), "11": ("11", "num"), "a5k": ("ask", ""), "--": ("--", ""), "0ld": ("old", "ocr?"), "8ig": ("fig", "ocr?"), "plain": ("plain", ""), "6a": ("θa", "")}


def test_glued_words(spark):
    rows = [(1, i, w) for i, w in enumerate("vip i an a wor d the t ab c".split())]
    lexicon = spark.createDataFrame([("vipi",), ("word",), ("the",), ("thet",), ("abc",)], "w string")
    out = decoding.glued(spark.createDataFrame(rows, "l int, i int, w string"), lexicon, ["l"], "i", "w").orderBy("i").collect()
    assert [(r["w"], r["joined"]) for r in out] == [("vipi", True), ("an", False), ("a", False), ("word", True), ("the", False), ("t", False), ("ab", False), ("c", False)]


def test_lines_gathered_from_pages(spark):
    rows = [
        (1, "E", 1, 0, "short"), (1, None, 1, 1, "a longer one"), (1, None, 2, 2, "begins/"), (1, None, 2, 3, "goes on"), (1, "E", 2, 4, "/ and on"), (1, None, 3, 5, "/ first"),
        (2, "E", 1, 0, "x"), (2, "F", 1, 1, "y"), (2, None, 1, 2, "nobody's"), (3, None, 1, 0, "nameless"),
    ]
    got = decoding.gathered(spark.createDataFrame(rows, "page int, entry string, num int, at int, text string"), ["page"], "entry", "num", "at", "text").collect()
    assert {(r["page"], r["entry"], r["num"], r["text"], r["n_parts"]) for r in got} == {(1, "E", 1, "a longer one", 2), (1, "E", 2, "begins goes on and on", 3), (1, "E", 3, "first", 1), (2, "E", 1, "x", 1), (2, "F", 1, "y", 1)}


def test_stumps_take_loose_lines_in_order(spark):
    rng = random.Random(7)
    lines, loose = [], []
    for page in range(12):
        for num in range(rng.randint(0, 9)):
            lines.append((page, num, rng.choice(["ab", "abc", "ABCD", "b", "", "bcd", "a whole line", "a.b", "ba"])))
        for at in range(rng.randint(0, 6)):
            loose.append((page, at, rng.choice(["abcd", "AB cd ef", "bcdx", "b a c", "zz", "a whole line"])))
    df = decoding.inherited(spark.createDataFrame(lines, "page int, num int, text string"), spark.createDataFrame(loose, "page int, at int, text string"), ["page"], "num", "text", "at")
    bare = lambda t: re.sub("[^A-Za-z]", "", t).upper()
    want, used = [], set()
    for page, num, t in sorted(lines):
        hit = next((x for x in sorted(loose) if x[0] == page and (page, x[1]) not in used and 2 <= len(bare(t)) <= 4 and bare(x[2]).startswith(bare(t)[:3])), None)
        if hit:
            used.add((page, hit[1]))
        want.append((page, num, hit[2] if hit else t, hit[1] if hit else None))
    assert sorted(map(repr, ((r["page"], r["num"], r["text"], r["taken"]) for r in df.collect()))) == sorted(map(repr, want))
    assert any(w[3] is not None for w in want)


def test_page_stumps_read_whole_tables(spark):
    from corpuslens.plans import reading

    rows = reading.page_stumps(spark, "/root/testdata/sf0.001").collect()
    assert len({(r["page"], r["num"]) for r in rows}) == len(rows) and any(r["taken"] is not None for r in rows)
    assert Counter((r["page"], r["taken"]) for r in rows if r["taken"] is not None).most_common(1)[0][1] == 1


def test_boxes_in_reading_order(spark):
    boxes = [(1, 300.0, 340.0, 10.0, "Head")]
    for col, words in ((0, ["one two", "three", "four five"]), (1, ["six", "seven eight"])):
        for i, line in enumerate(words):
            for j, w in enumerate(line.split()):
                boxes.append((1, 50.0 + 400 * col + 60 * j, 100.0 + 400 * col + 60 * j, 100.0 + 12 * i + j % 2, w))
    boxes += [(1, 20.0, 25.0, 124.0, "3"), (1, 480.0, 490.0, 112.0, "77"), (2, 50.0, 90.0, 100.0, "lone"), (2, 70.0, 90.0, 115.0, "12")]
    random.Random(1).shuffle(boxes)
    got = decoding.reading_order(spark.createDataFrame(boxes, "page int, x double, right double, y double, word string"), ["page"], "x", "right", "y", "word", 90, 6, 50, 20).collect()
    assert {(r["page"], r["col"], r["role"], r["line"], r["text"]) for r in got} == {
        (1, 0, "header", 1, "Head"), (1, 1, "text", 1, "one two"), (1, 1, "text", 2, "three"), (1, 1, "text", 3, "four five"), (1, 1, "number", 1, "3"),
        (1, 2, "text", 1, "six"), (1, 2, "text", 2, "seven 77 eight"), (2, 1, "text", 1, "lone"), (2, 1, "text", 2, "12"),
    }


def test_pages_are_read_a_row_each(spark):
    """Ties, nulls and pages without boxes; a page is sent once, as a row, and its reading sends nothing."""
    box = "struct<x:double,right:double,y:double,word:string>"
    tied = [(10.0, 20.0, 100.0, "b"), (10.0, 20.0, 100.0, "a"), (5.0, 9.0, 102.0, None), (5.0, 9.0, 101.0, "z"), (1.0, 2.0, None, "lost"), (5.0, 9.0, 106.0, "next"), (None, None, 113.0, "x")]
    df = spark.createDataFrame([(1, tied), (2, []), (3, None), (4, [(0.0, 9.0, 10.0, None)])], f"page int, boxes array<{box}>")
    got = decoding.read_pages(df, ["page"], 90, 6, 50, 20)
    assert sorted((r["page"], r["col"], r["role"], r["line"], r["text"], r["n"]) for r in got.collect()) == [(1, 1, "text", 1, "z next a b", 5), (1, 1, "text", 2, "x", 1), (4, 0, "header", 1, "", 1)]
    flat = df.select("page", F.explode("boxes").alias("b")).select("page", "b.*")
    again = decoding.reading_order(flat, ["page"], "x", "right", "y", "word", 90, 6, 50, 20)
    assert again._jdf.queryExecution().executedPlan().toString().count("Exchange") == 1
    assert sorted(map(tuple, again.collect())) == sorted(map(tuple, got.collect()))


def plain_offsets(anchors, columns):
    """Of one book: columns in order as (col, lines), anchors as (col, line, pos)."""
    known = {}
    for c, _ in columns:
        d = sorted(p - line for k, line, p in anchors if k == c)
        if d:
            known[c] = math.floor((d[(len(d) - 1) // 2] + d[len(d) // 2]) / 2)
    near = {}
    for i, (c, lines) in enumerate(columns):
        if c in known:
            near[c] = known[c]
        elif i and columns[i - 1][0] in known:
            near[c] = known[columns[i - 1][0]] + columns[i - 1][1]
        elif i + 1 < len(columns) and columns[i + 1][0] in known:
            near[c] = known[columns[i + 1][0]] - lines
    for (before, lines), (c, _) in zip(columns, columns[1:]):
        if c not in near and before in near:
            near[c] = near[before] + lines
    return near, known


@pytest.mark.parametrize("seed", range(3))
def test_promotion_until_nothing_changes(spark, seed):
    rng = random.Random(seed)
    anchors, rows, columns, want, key = [], [], [], set(), 0
    for book in range(6):
        pos, cols = 0, [(c, rng.randint(1, 6)) for c in range(1, 9)]
        columns += [(book, c, n) for c, n in cols]
        own, open_ = [], []
        for c, n in cols:
            bare = rng.random() < 0.5
            for line in range(1, n + 1):
                pos += 1
                if not bare and rng.random() < 0.4:
                    own.append((c, line, pos + rng.choice((0, 0, 0, 1))))
                else:
                    key += 1
                    a = pos - rng.randint(0, 2)
                    open_.append((key, c, line + rng.choice((0, 0, 1)), a, a + rng.randint(0, 3)))
        anchors += [(book, *x) for x in own]
        rows += [(book, *x) for x in open_]
        n = 0
        while True:
            n += 1
            near, known = plain_offsets(own, cols)
            best = {}
            for k, c, line, a, b in sorted(open_):
                if c in near and a <= near[c] + line <= b and near[c] + line not in {p for _, _, p in own}:
                    best.setdefault(near[c] + line, (k, c, line))
            if not best:
                break
            want |= {(book, k, c, p, c not in known, n) for p, (k, c, line) in best.items()}
            own += [(c, line, p) for p, (k, c, line) in best.items()]
            open_ = [x for x in open_ if x[0] not in {k for k, _, _ in best.values()}]
    got = sequences.promoted(
        spark.createDataFrame(anchors, "book int, col int, line int, pos long"), spark.createDataFrame(rows, "book int, key long, col int, line int, a long, b long"),
        spark.createDataFrame(columns, "book int, col int, lines int"), "book", CUT,
    ).collect()
    assert {tuple(r) for r in got} == want and want
