"""Miniature fixtures with known answers."""

import hashlib
import math
import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from corpuslens.functions import stats, text
from corpuslens.operators import association, graphs, induction, matching, models, morphology, nulls, sequences, tokens


def one(spark, col, **values):
    names = list(values)
    df = spark.createDataFrame([tuple(values.values())], names)
    return df.select(col.alias("x")).first()["x"]


@pytest.mark.parametrize(
    "seg,form,kind,flags",
    [
        ("ma<e>ra", "maera", "W", ["emended"]), ("s<ur>/", "sur", "W", ["emended", "line_split"]), ("se(th)", "seth", "W", ["expanded"]),
        ("en--------", "en--------", "W", ["damaged"]), ("---", "-", "G", []), ("XIV", "XIV", "N", []), ("12", "12", "N", []), ("a{b}c", "ac", "W", ["scribal_extra"]),
        ("{abc}", "abc", "W", ["braced"]), ("Ab.c", "abc", "W", ["caps", "uncertain"]), ("[ar]nth", "arnth", "W", ["restored"]), ("ab%", "ab", "W", ["stripped_chars"]),
    ],
)
def test_segments(spark, seg, form, kind, flags):
    got = one(spark, text.segment(F.col("s")), s=seg)
    assert (got["form"], got["kind"], got["flags"]) == (form, kind, flags)


def test_segment_of_nothing(spark):
    assert one(spark, text.segment(F.col("s")), s="%") is None
    got = one(spark, text.parse(F.col("s")), s="mi: larθ | a[vacat]b [3-5 letters] ...")
    assert [t["form"] for t in got] == ["mi", "larθ", "a", "b", "-"]


@pytest.mark.parametrize("w,want", [("śuθi", "suthi"), ("χ", "ch"), ("φ'", "ph")])
def test_ascii(spark, w, want):
    assert one(spark, text.to_ascii(F.col("s")), s=w) == want


def test_words_and_stems(spark):
    assert one(spark, text.words(F.col("s")), s="Ärger, über-all 12x") == ["ärger", "über", "all", "x"]
    assert one(spark, text.strip_case(F.col("s")), s="velthurisa") == "velthur" and one(spark, text.strip_case(F.col("s")), s="als") == "als"
    assert one(spark, text.skeleton(F.col("s")), s="shekel") == "SKL" and one(spark, text.skeleton(F.col("s")), s="woinos") == "WNS"
    assert one(spark, text.suffixes(F.col("s")), s="abc") == ["c", "bc"]
    assert one(spark, text.bigrams(F.col("s")), s="abc") == ["ab", "bc"]
    assert abs(one(spark, text.similarity(F.col("a"), F.col("b")), a="velus", b="velthur") - 4 / 7) < 1e-12
    assert one(spark, text.gloss_class(F.col("s")), s="of mrs-x and mr-y") == "NAME-F" and one(spark, text.gloss_class(F.col("s")), s="mr-y") == "NAME-M"
    assert one(spark, text.century_years(F.col("s")), s="exeunti IV - III saec.") == (325, 201)
    assert one(spark, text.fold(F.col("s"), "minimal"), s="Caś’a") == "kasa"
    assert sorted(one(spark, text.ocr_variants(F.col("s"), {"8": ["f", "θ"], "1": ["i", "l"]}), s="A81")) == ["afi", "afl", "aθi", "aθl"]
    assert abs(one(spark, text.ratcliff(F.col("a"), F.col("b")), a="abcd", b="bcde") - 0.75) < 1e-12
    assert one(spark, text.nfc(F.col("s")), s="é") == "é"


def test_exact_tails(spark):
    long = lambda v: F.lit(v).cast("long")
    x = spark.range(1).select(
        stats.hypergeometric_upper(long(2), long(10), long(4), long(3)).alias("h"), stats.binomial_upper(long(5), long(6)).alias("b"), *[c.alias(n) for c, n in zip(stats.wilson(F.lit(8), F.lit(10)), ("lo", "hi"))],
        stats.stratified_lower(F.array(long(4), long(4)), F.array(long(2), long(2)), F.array(long(2), long(2)), long(0)).alias("s"), stats.ln_factorial(long(200)).alias("f"),
    ).first()
    assert abs(x["h"] - 40 / 120) < 1e-9 and abs(x["b"] - 7 / 64) < 1e-9 and abs(x["lo"] - 0.490162) < 1e-6 and abs(x["hi"] - 0.943318) < 1e-6
    assert abs(x["s"] - 1 / 36) < 1e-9 and abs(x["f"] - math.lgamma(201)) < 1e-9


def test_benjamini_hochberg(spark):
    df = spark.createDataFrame([(i, p) for i, p in enumerate((0.01, 0.03, 0.04, 0.5))], "i int, p double")
    got = [round(r["p_bh"], 6) for r in stats.benjamini_hochberg(df, "p", ties=("i",)).orderBy("i").collect()]
    assert got == [0.04, 0.053333, 0.053333, 0.5]


def test_mutual_information_and_majority(spark):
    cells = spark.createDataFrame([("a", "x", 2), ("b", "y", 2)], "a string, b string, c long")
    assert abs(association.mutual_information(cells, "a", "b").first()["mi"] - math.log(2)) < 1e-12
    votes = spark.createDataFrame([("w", "THEO", 1), ("w", "VERB", 1), ("v", "KIN", 2), ("v", "VERB", 1)], "w string, label string, c long")
    assert [r["w"] for r in association.majority(votes, "w", "label").collect()] == ["v"]
    assert {r["w"]: r["label"] for r in association.majority(votes, "w", "label", F.col("label")).collect()} == {"w": "THEO", "v": "KIN"}


def test_sections_and_fills(spark):
    df = spark.createDataFrame([(1, i, f, v) for i, (f, v) in enumerate(zip((0, 1, 1, 0, 1), (1.0, None, 3.0, None, None)))], "g int, i int, f int, v double")
    assert [r["section"] for r in sequences.sections(df, "g", ["i"], F.col("f") == 1).orderBy("i").collect()] == [0, 1, 1, 1, 2]
    assert [r["x"] for r in sequences.forward_fill(df, "g", ["i"], F.col("v"), "x").orderBy("i").collect()] == [1, 1, 3, 3, 3]
    assert [r["x"] for r in sequences.interpolate(df, "g", ["i"], F.col("i"), F.col("v"), "x").orderBy("i").collect()] == [1, 2, 3, 3, 3]


def test_minimal_pairs_need_two_units(spark):
    df = spark.createDataFrame([(1, ["a", "b", "c"]), (2, ["a", "x", "c"]), (1, ["a", "y", "c"])], "u int, ws array<string>")
    assert {(r["a"], r["b"], r["n_contexts"]) for r in matching.minimal_pairs(df, "ws", "u").collect()} == {("b", "x", 1), ("x", "y", 1)}


def test_fuzzy_equals_brute_force(spark):
    import random

    rng = random.Random(1)
    words = ["".join(rng.choices("abc", k=rng.randint(3, 7))) for _ in range(120)]
    df = spark.createDataFrame([(w,) for w in set(words)], "w string")
    got = {(r["p"], r["f"]) for r in matching.fuzzy(df.select(F.col("w").alias("p")), df.select(F.col("w").alias("f")), "p", "f", 0.7).collect()}
    pairs = df.select(F.col("w").alias("p")).crossJoin(df.select(F.col("w").alias("f"))).where(text.similarity(F.col("p"), F.col("f")) >= 0.7 - 1e-12)
    assert got == {(r["p"], r["f"]) for r in pairs.collect()}


def test_permutations_keep_margins_and_p_values_their_range(spark):
    units = spark.createDataFrame([(i, i % 3, i % 2) for i in range(30)], "id int, g int, v int")
    sim = nulls.permute(units, 9, 42, "v", F.col("id"), ("g",))
    assert {r["s"] for r in sim.groupBy("rep", "g").agg(F.sum("v").alias("s")).collect()} == {5}
    obs = units.where("v = 1").groupBy("g").agg(F.sum("id").alias("stat"))
    p = nulls.min_p(obs, sim.where("v = 1").groupBy("rep", "g").agg(F.sum("id").alias("stat")), "g", 9).collect()
    assert all(0.1 <= r["p"] <= r["p_adj"] <= 1 for r in p)


def test_shuffled_values_are_few_runs_and_follow_the_hashes(spark, monkeypatch):
    """Ranks of replicates need a row a run, not one of 4096 buckets, and units meet values by md5 order."""
    rows = [(i * 7, f"g{i % 2}", None if i % 11 == 0 else f"v{i % 5}", i) for i in range(200)]
    units = spark.createDataFrame(rows, "id int, g string, v string, other int")
    assert nulls.shuffled(units, 5, 42, "v", F.col("id")).count() == 5
    assert nulls.shuffled(units, 5, 42, "v", F.col("id"), ("g",)).count() == 10
    monkeypatch.setattr(nulls, "RUN", 8)
    monkeypatch.setattr(nulls, "CHUNK", 16)
    for strata in ((), ("g",)):
        assert nulls.shuffled(units, 5, 42, "v", F.col("id"), strata).count() <= 5 * 256
        got = {(r["rep"], r["id"]): (r["v"], r["other"]) for r in nulls.permute(units, 5, 42, "v", F.col("id"), strata).collect()}
        want = {}
        for rep in range(1, 6):
            for g in ("g0", "g1") if strata else (None,):
                mine = [x for x in rows if g in (None, x[1])]
                drawn = sorted(mine, key=lambda x: hashlib.md5(f"42:{rep}:{x[0]}".encode()).hexdigest())
                want |= {(rep, x[0]): (y[2], x[3]) for x, y in zip(mine, drawn)}
        assert got == want


def test_openings_are_the_least_hashes_over_batches(spark):
    rows = [(None if i % 7 == 0 else i % 3, i, None if i % 13 == 0 else f"t{i % 4}") for i in range(120)]
    df = spark.createDataFrame(rows, "u long, e long, t string")
    want = {}
    for rep in range(1, 13):
        for g in (None, 0, 1, 2):
            mine = [x for x in rows if x[0] == g]
            t = min(mine, key=lambda x: hashlib.md5(":".join(str(y) for y in (42, rep, x[0], x[1]) if y is not None).encode()).hexdigest())[2]
            want[rep, t] = want.get((rep, t), 0) + 1
    for size in ("7", "10000"):
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)
        out = nulls.openings(df, 12, 42, "u", "e", "t")
        assert {(r["rep"], r["t"]): r["stat"] for r in out.collect()} == want
    # The replicates are not multiplied with the rows in front of a shuffle or sort.
    assert "Generate" not in out._jdf.queryExecution().toString()


def test_md5_of_many_texts():
    import numpy as np

    from corpuslens.functions import hashes

    texts = np.array([("x" * i).encode() for i in range(49)])
    for prefix in (b"42:7:", b"42:17:"):
        want = [hashlib.md5(prefix + t).hexdigest() for t in texts.tolist()]
        for high, low in (hashes.md5(hashes.blocks(texts, len(prefix)), prefix), hashes.md5_one_by_one(texts, prefix)):
            assert [f"{int(a):016x}{int(b):016x}" for a, b in zip(high, low)] == want
    assert hashes.blocks(np.array([b"x" * 50]), 6) is None


def test_sides_that_share_a_word_are_not_compared(spark, monkeypatch):
    rng = random.Random(3)
    rows = {(rng.choice("xyz"), rng.choice("pqr"), "".join(rng.choices("abc", k=rng.randint(4, 8)))) for _ in range(60)} | {("x", None, "abcabc")}
    df = spark.createDataFrame(sorted(rows, key=str), "side string, g string, w string").select(F.col("side").alias("g"), F.col("g").alias("s"), "w")
    got = {r["g"]: (r["n_pairs"], r["score"]) for r in matching.alike_sides(df, "g", "s", "w", 0.7).collect()}
    pairs = df.alias("a").join(df.alias("b"), F.expr("a.g = b.g and a.s < b.s")).groupBy("a.g", "a.s", "b.s").agg(F.max(text.similarity(F.col("a.w"), F.col("b.w"))).alias("m")).collect()
    want = {g: (sum(r[0] == g for r in pairs), sum(r[0] == g and r["m"] >= 0.7 for r in pairs)) for g in "xyz"}
    assert got == want
    refuse = F.udf(lambda a, b: 1 / 0, "double")
    monkeypatch.setattr(matching, "similarity", refuse)
    shared = spark.createDataFrame([("x", "p", f"w{i}") for i in range(9)] + [("x", "q", "w3"), ("x", "q", "other")], "g string, s string, w string")
    assert [tuple(r) for r in matching.alike_sides(shared, "g", "s", "w", 0.7).collect()] == [("x", 1, 1)]


def test_edges_meet_all_worlds_in_one_row(spark):
    rng = random.Random(5)
    units = spark.createDataFrame([(i, None if i % 9 == 0 else f"b{i % 4}") for i in range(60)], "id long, lab string")
    edges = spark.createDataFrame(sorted({(rng.randrange(70), rng.randrange(60)) for _ in range(200)}), "x long, y long")
    vec = nulls.vectors(units, 6, 42, "lab", F.col("id"))
    assert vec.count() == 60 and {len(r["vec"]) for r in vec.collect()} == {7}
    got = {r["rep"]: (r["stat"], r["c"]) for r in graphs.equal_ends(edges, vec, 6).collect()}
    worlds = {k: {} for k in range(7)}
    for row in nulls.permute(units, 6, 42, "lab", F.col("id")).collect() + units.withColumn("rep", F.lit(0)).collect():
        worlds[row["rep"]][row["id"]] = row["lab"]
    ends = [(r["x"], r["y"]) for r in edges.collect() if r["x"] < 60]
    assert got == {k: (sum(w[x] is not None and w[x] == w[y] for x, y in ends), len(ends)) for k, w in worlds.items()}


def test_partition_count_does_not_change_results(spark):
    df = spark.createDataFrame([(i, f"w{i % 7} w{i % 5} w{i % 3}") for i in range(50)], "doc_id long, text string")
    runs = []
    for n in (1, 8):
        spark.conf.set("spark.sql.shuffle.partitions", n)
        runs.append(sorted(map(tuple, tokens.positions(tokens.tokens(df)).collect())))
    spark.conf.set("spark.sql.shuffle.partitions", 4)
    assert runs[0] == runs[1]


def test_knn_components_and_propagation(spark):
    vecs = spark.createDataFrame([(i, [float(i % 2), float(1 - i % 2), 0.01 * i]) for i in range(12)], "vec_id long, embedding array<double>")
    v = models.unit_vectors(vecs, "vec_id", "embedding")
    edges = graphs.knn(v, "vec_id", 3)
    assert edges.groupBy("src").count().where("count > 3").count() == 0
    comp = graphs.components(edges.select(F.col("src").alias("a"), F.col("dst").alias("b")), lambda d: d.checkpoint())
    assert comp.count() == 12
    seeds = spark.createDataFrame([(0, "even"), (1, "odd")], "id long, y string")
    best = models.decide(graphs.propagate(graphs.symmetric(edges), seeds, "y", rounds=4, cut=lambda d: d.checkpoint()).select("id", "y", F.col("f").alias("score")), "id", "y")
    assert all(r["predicted"] == ("even", "odd")[r["id"] % 2] for r in best.collect())


def test_longest_suffix_and_paradigms(spark):
    types = spark.createDataFrame([("walking", 1), ("walked", 1), ("walks", 1), ("sing", 1)], "w string, freq int")
    ends = spark.createDataFrame([("ing",), ("ed",), ("s",), ("g",)], "suffix string")
    asg = morphology.longest_suffix(types, ends)
    assert {(r["w"], r["suffix"]) for r in asg.collect()} == {("walking", "ing"), ("walked", "ed"), ("walks", "s"), ("sing", "g")}
    assert [r["suffixes"] for r in morphology.paradigms(asg).collect()] == ["ed|ing|s"]


def test_alignment(spark):
    df = spark.createDataFrame([("p", [["a", "b"], ["c"], ["d"]], [["a", "b"], ["d"]])], "pair string, a array<array<string>>, b array<array<string>>")
    assert [(r["i"], r["j"]) for r in matching.align(df).orderBy("i").collect()] == [(0, 0), (2, 1)]


def test_markov_sequences_draw_one_history_per_history(spark):
    pairs = pd.DataFrame({"a": ["x", "x", "y"], "b": ["y", "z", "x"], "c": [3, 1, 2]})  # z has no follower
    histories = spark.createDataFrame([(i, 4) for i in range(300)] + [(None, 7)], "seq long, n long")
    got = induction.markov_sequences(histories, pairs, 2, 42).toPandas()
    assert len(got) == 2 * (300 * 4 + 7) and got["seq"].isna().sum() == 2 * 7
    assert (got[got["seq"].notna()].groupby(["rep", "seq"])["i"].apply(sorted).map(tuple) == (0, 1, 2, 3)).all()
    first = got[got["i"] == 0]["w"].value_counts(normalize=True)
    assert abs(first["x"] - 4 / 6) < 0.08 and "z" not in first
    runs = got[got["seq"].notna()].sort_values(["rep", "seq", "i"])
    after = runs["w"].shift(-1)[(runs["w"] == "x") & (runs["i"] < 3)].value_counts(normalize=True)
    assert abs(after["y"] - 3 / 4) < 0.06 and set(after.index) == {"y", "z"}
    again = induction.markov_sequences(histories.repartition(3), pairs, 2, 42).toPandas()
    key = ["rep", "seq", "i", "w"]
    assert got.sort_values(key)[key].reset_index(drop=True).equals(again.sort_values(key)[key].reset_index(drop=True))


def test_markov_null_simulates_every_event(spark):
    from corpuslens.plans import inference

    sf = "/root/testdata/sf0.001"
    n = spark.read.parquet(f"{sf}/events.parquet").count()
    got = inference.markov_null(spark, sf).groupBy("rep").agg(F.sum("n").alias("n"), F.sum("n_initial").alias("k")).collect()
    users = spark.read.parquet(f"{sf}/events.parquet").select("user_id").distinct().count()
    assert len(got) == inference.R and {(r["n"], r["k"]) for r in got} == {(n, users)}


def test_families_of_all_records_equal_brute_force(spark):
    from corpuslens.plans import inference

    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", text.words(F.col("text")).alias("ws")).collect()
    sets = {r["doc_id"]: set(r["ws"]) for r in docs if r["ws"]}
    root = {d: d for d in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    linked = set()
    for a in sorted(sets):
        for b in (b for b in sets if b > a and 2 * len(sets[a] & sets[b]) >= len(sets[a] | sets[b])):
            x, y = sorted((find(a), find(b)))
            root[y] = x
            linked |= {a, b}
    assert any(len(r["ws"]) > 40 for r in docs if r["doc_id"] in linked)
    assert {(r["id"], r["comp"]) for r in inference.jaccard_families(spark, sf).collect()} == {(d, find(d)) for d in linked}


@pytest.mark.parametrize("threshold", [0.08, 0.5, 0.8])
def test_jaccard_pairs_equal_brute_force(spark, threshold):
    import random

    rng = random.Random(3)
    sets = {i: set(rng.choices("abcdefghijklmnop", k=rng.randint(1, 20))) for i in range(60)}
    df = spark.createDataFrame([(i, w) for i, ws in sets.items() for w in ws], "k long, w string")
    want = {(a, b) for a in sets for b in sets if a < b and len(sets[a] & sets[b]) / len(sets[a] | sets[b]) >= threshold}
    assert {(r["a"], r["b"]) for r in matching.jaccard_pairs(df, "k", "w", threshold).collect()} == want


def test_fuzzy_probe_finds_rare_words(spark):
    from corpuslens.plans import inference

    sf = "/root/testdata/sf0.001"
    types = tokens.vocabulary(tokens.tokens(spark.read.parquet(f"{sf}/documents.parquet"))).select(F.col("w").alias("form"), "freq")
    probes = spark.read.parquet(f"{sf}/part.parquet").select(F.explode(text.words(F.col("p_name"))).alias("probe")).where(F.length("probe") >= 3).distinct()
    near = probes.crossJoin(types).where(text.similarity(F.col("probe"), F.col("form")) >= 0.7 - 1e-12).collect()
    assert {(r["probe"], r["form"]) for r in inference.fuzzy_probe(spark, sf).collect()} == {(r["probe"], r["form"]) for r in near}
    assert any(r["freq"] < 20 for r in near)


def test_null_models_have_the_replicates_of_their_module(spark):
    from corpuslens.plans import inference, registry

    sf, of = "/root/testdata/sf0.001", registry.QUERIES
    assert inference.R == 200
    for name in ("perm_block", "letter_scramble_r200", "max_stat_fwer"):
        p = [r[-1] for r in of[name](spark, sf).collect()]
        assert all(abs(x * 201 - round(x * 201)) < 1e-3 and 1 <= round(x * 201) <= 201 for x in p)


def test_label_propagation_runs_all_rounds(spark, monkeypatch):
    from corpuslens.plans import inference

    seen = {}
    whole = graphs.propagate

    def spy(edges, seeds, label, alpha=0.85, rounds=30, cut=lambda df: df):
        seen["rounds"] = rounds
        return whole(edges, seeds, label, alpha, 1, cut)

    monkeypatch.setattr(inference.graphs, "propagate", spy)
    inference.label_propagation(spark, "/root/testdata/sf0.001")
    assert seen == {"rounds": 30}


def test_ratcliff_containment(spark):
    for a, b, want in (("abcd", "bcde", 0.75), ("bc", "abcd", 1.0), ("", "x", 0.0), ("xy", "ab", 0.0)):
        assert abs(one(spark, text.ratcliff_contained(F.col("a"), F.col("b")), a=a, b=b) - want) < 1e-12


def test_greedy_variants_match_brute_force(spark):
    from corpuslens.operators import graphs, matching

    rng = random.Random(3)
    base = [[rng.choice("abcdefgh") for _ in range(n)] for n in (5, 5, 10, 10, 1)]
    rows = []
    for i in range(60):
        ws = list(rng.choice(base))
        for _ in range(rng.choice((0, 0, 1, 2))):
            ws[rng.randrange(len(ws))] = rng.choice("abxyz")
        rows.append((i, rng.choice("st"), ws))
    d = spark.createDataFrame(rows, "id long, g string, ws array<string>")
    cut = lambda df: df.checkpoint()
    got = {r["id"]: r["canon"] for r in graphs.first_wins(matching.agreeing(d, "id", "g", "ws", 8, 10, cut), cut).collect()}
    canon, want = [], {}
    for i, g, ws in rows:
        near = [j for j, h, vs in canon if h == g and len(vs) == len(ws) and sum(x == y for x, y in zip(vs, ws)) * 10 >= 8 * len(ws)]
        if near:
            want[i] = near[0]
        else:
            canon.append((i, g, ws))
    assert got == want


def test_contained_items_of_any_length(spark):
    docs = spark.createDataFrame([(1, "One two three four five six"), (2, "two three"), (3, ""), (4, None), (5, "six five four three two one")], "doc_id long, text string")
    items = spark.createDataFrame([(1, "two three"), (2, "three"), (3, "two three four five six"), (4, "one two three four five six"), (5, ""), (6, None), (7, "five seven")], "item_id long, text string")
    got = {(r["item_id"], r["doc_id"]) for r in matching.contained(docs, items).collect()}
    assert got == {(1, 1), (1, 2), (2, 1), (2, 2), (2, 5), (3, 1), (4, 1)}
    assert matching.contained(docs, items.limit(0)).collect() == []


def test_hypergeometric_tail_over_its_whole_range(spark):
    rows = [(x, total, marked, drawn) for total, marked, drawn in ((40, 12, 9), (50, 25, 30), (3000, 900, 1500), (100000, 40000, 30000)) for x in {0, 1, 5, 9, drawn * marked // total, drawn * marked // total + 3, min(marked, drawn), min(marked, drawn) + 1}]
    df = spark.createDataFrame(rows, "x long, total long, marked long, drawn long")
    got = df.select("x", "total", "marked", "drawn", stats.hypergeometric_upper(F.col("x"), F.col("total"), F.col("marked"), F.col("drawn")).alias("p")).collect()
    for r in got:
        low, top = max(r["x"], r["marked"] + r["drawn"] - r["total"], 0), min(r["marked"], r["drawn"])
        c = lambda n, k: math.lgamma(n + 1) - math.lgamma(k + 1) - math.lgamma(n - k + 1)
        want = math.fsum(math.exp(c(r["marked"], k) + c(r["total"] - r["marked"], r["drawn"] - k) - c(r["total"], r["drawn"])) for k in range(low, top + 1))
        assert abs(r["p"] - min(want, 1.0)) < 1e-7, r


def test_parities_never_differ_in_more_places_than_the_sets(spark):
    rng = random.Random(5)
    sets = {i: set(rng.sample(range(4000), rng.choice((0, 3, 60, 900)))) for i in range(40)}
    df = spark.createDataFrame([(i, [str(w) for w in ws]) for i, ws in sets.items()], "k long, x array<string>")
    bits = {r["k"]: r["bits"] for r in matching.parities(df, "k", "x", 32).collect()}
    far = lambda a, b: sum(((p ^ q) & (2**64 - 1)).bit_count() for p, q in zip(bits[a], bits[b]))
    assert all(far(a, b) <= len(sets[a] ^ sets[b]) and (far(a, b) - len(sets[a] ^ sets[b])) % 2 == 0 for a in sets for b in sets)
    assert any(far(a, b) > 50 for a in sets for b in sets)


def test_left_out_densities_take_one_row_a_group(spark):
    counts = {(u, y, b): (u + 1) * (b + 2 * y + 1) % 5 for u in range(30) for y in (0, 1) for b in range(6)}
    rows = [(u, [(y, b, counts[u, y, b]) for y in (0, 1) for b in range(6) if counts[u, y, b]]) for u in range(30)]
    every = [(y, b, sum(counts[u, y, b] for u in range(30))) for y in (0, 1) for b in range(6)]
    cell = "array<struct<y: int, b: int, c: bigint>>"
    df = spark.createDataFrame([(own, every) for _, own in rows], f"own {cell}, all {cell}")
    got = sorted((r["pos"], r["neg"], round(r["d1"], 9), round(r["d0"], 9)) for r in df.mapInArrow(models.left_out(5, 2.0), "pos long, neg long, d1 double, d0 double").collect())
    d = lambda u, y, x: sum((t - counts[u, y, b]) * math.exp(-0.5 * ((x - b) / 2.0) ** 2) for z, b, t in every if z == y)
    assert got == sorted((counts[u, 1, x], counts[u, 0, x], round(d(u, 1, x), 9), round(d(u, 0, x), 9)) for u in range(30) for x in range(6) if counts[u, 0, x] + counts[u, 1, x])


@pytest.mark.parametrize("blocks", [1, 5, None])
def test_nearest_vectors_equal_brute_force_among_copies_and_blocks_meet_once(spark, blocks):
    import numpy as np

    rng = np.random.default_rng(2)
    x = np.concatenate([rng.normal(size=(30, 4)), np.tile(rng.normal(size=(1, 4)), (12, 1))])
    x /= np.linalg.norm(x, axis=1)[:, None]
    s = np.round(x @ x.T, 12)
    want = {(i, j) for i in range(42) for j in sorted((j for j in range(42) if j != i and s[i, j] > 0), key=lambda j: (-s[i, j], j))[:3]}
    got = graphs.knn(spark.createDataFrame([(i, row.tolist()) for i, row in enumerate(x)], "u long, v array<double>"), "u", 3, blocks)
    assert {(r["src"], r["dst"]) for r in got.collect()} == want
    assert "CoGroup" not in got._jdf.queryExecution().executedPlan().toString()


def test_restoration_tiers_count_equal_contexts_once(spark, tmp_path):
    from datetime import datetime

    from corpuslens.plans import variants

    history = ["view", "click", "purchase", "view"]
    rows = [(u * 10 + i, datetime(2024, 1, 1, 0, i), u, w) for u in range(64) for i, w in enumerate(history)]
    spark.createDataFrame(rows, "event_id long, ts timestamp, user_id long, event_type string").write.parquet(f"{tmp_path}/events.parquet")
    out = variants.restoration_tiers(spark, str(tmp_path))
    held = sum(hashlib.md5(f"42:{u}".encode()).hexdigest()[0] < "4" for u in range(64))
    assert {r["stratum"]: (r["n"], r["by_exact"], r["top1"]) for r in out.collect()} == {"all": (4 * held,) * 3, "operators": (held,) * 3, "open": (3 * held,) * 3}
    # Tiers are joined by context, not by event.
    assert "HashAggregate(keys=[held" in out._jdf.queryExecution().executedPlan().toString()


def test_permuted_values_are_not_broadcast(spark):
    units = spark.range(300).select("id", (F.col("id") % 3).alias("size"), (F.col("id") % 7).alias("v"))
    out = nulls.permute(units, 20, 42, "v", F.col("id"), ("size",))
    assert "SortMergeJoin [size" in out._jdf.queryExecution().executedPlan().toString()
    assert out.groupBy("rep", "size").agg(F.sum("v").alias("s")).select("size", "s").distinct().count() == 3
