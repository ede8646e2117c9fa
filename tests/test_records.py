"""Record functions and file sources on known rows."""

import random

import pytest
from pyspark.sql import functions as F

from corpuslens.functions import records, text
from corpuslens.operators import matching, nulls
from corpuslens.sources import files


def one(spark, column, **values):
    df = spark.createDataFrame([tuple(values.values())], list(values)) if values else spark.range(1)
    return df.select(column.alias("x")).first()["x"]


def test_torn_numbers_are_rejoined(spark):
    rows = [(5, 1, "a"), (340, 1, "b"), (34, 1, "2 c"), (338, 2, "d"), (12, 1, "e"), (900, 1, "f"), (3, 9, "x")]
    df = spark.createDataFrame([(rows,)], "r array<struct<num:int,line:int,text:string>>")
    got = [tuple(x) for x in df.select(records.healed(F.col("r")).alias("h")).first()["h"]]
    assert got == [(5, 1, "a"), (340, 1, "b"), (341, 2, "c"), (338, 2, "d"), (900, 1, "f")]


def soft_brute(a, b):
    bare = lambda x: "".join(c for c in x if c not in "aeiou")
    same = lambda x, y: bare(x) == bare(y) or (len(x) >= 4 and len(y) >= 4 and x[:4] == y[:4])
    rest, hit = sorted(set(b)), 0
    for w in a:
        v = next((v for v in rest if same(w, v)), None)
        if v is not None:
            rest.remove(v)
            hit += 1
    return hit / (len(a) + len(set(b)) - hit) if a and b else 0.0


@pytest.mark.parametrize("a,b", [(["tin", "tan", "avil"], ["tun", "avils", "x"]), ([], ["a"]), (["a", "b"], []), (["mi", "mi"], ["mi", "mi"]), (["kt"], ["zz", "kat"])])
def test_greedy_soft_overlap(spark, a, b):
    df = spark.createDataFrame([(a, b)], "a array<string>, b array<string>")
    assert df.select(records.soft_jaccard(F.col("a"), F.col("b"), text.soft_equal).alias("x")).first()["x"] == pytest.approx(soft_brute(a, b))


def test_remnants_are_glued(spark):
    known = F.create_map(F.lit("vipi"), F.lit(True), F.lit("cae"), F.lit(True))
    parts = lambda s: F.split(F.lit(s), " ")
    assert one(spark, records.glue(parts("vip i cae x"), known)) == ["vipi", "cae", "x"]  # cae is known itself
    assert one(spark, records.glue(parts("i vip"), known)) == ["i", "vip"]


def test_forms(spark):
    assert one(spark, records.norm_any(F.lit("Þéχa ś1"))) == "thechas" and one(spark, records.norm_word(F.lit(" ϑανé!"))) == "thave"
    assert one(spark, records.fix_roman(F.lit("lV"))) == "IV" and one(spark, records.fix_roman(F.lit("IVV"))) is None
    assert one(spark, records.to_theta(F.lit("thachph"))) == "ϑaχφ"
    assert one(spark, records.clean_reading(F.lit("link!show space x!a !  y"))) == "show ay"
    assert one(spark, records.pre_clean(F.lit("{lat} ab~?( T"), "•[]() -")) == "AB [---] -ś"
    assert one(spark, records.region_of(F.lit("ET1 Cl 1.0234"), ("Cl",))) == "Cl" and one(spark, records.region_of(F.lit("ET1 Zz 1"), ("Cl",))) is None
    assert [one(spark, records.ladder(F.lit(w))) for w in ("vacl", "zusleva", "ara", "tiurim", "x")] == ["VACL", "OFFER", "VERB-R", "CAL", "X"]
    assert one(spark, records.quoted(F.lit("'God', then 'a Son'"))) == ["god", "a son"] and one(spark, records.gloss_hit(F.lit("the God of"), F.array(F.lit("godly")))) is True
    assert tuple(one(spark, records.apparatus(F.lit(" 12 some lemma ] note x")))) == (12, "some lemma", "note x") and one(spark, records.apparatus(F.lit("no lemma"))) is None
    assert [tuple(x) for x in one(spark, records.index_entry(F.lit("avil I 3, 5; II 7")))] == [("avil", "I", 3), ("avil", "I", 5), ("avil", "II", 7)]
    assert [one(spark, records.is_clean(F.lit(w))) for w in ("ab", "a", "a-b", "[ab]", "ab?")] == [True, False, False, False, False]
    genre = records.genre_of(F.array(F.lit("mi"), F.lit("turce")), (("dedic", ("turce",)), ("speaking", ("mi",))))
    assert one(spark, genre) == "dedic"
    assert one(spark, records.artifact_of(F.lit("A"), F.lit(3), F.lit(None), {"B": "ART"})) == "A:3" and one(spark, records.artifact_of(F.lit("B"), F.lit(3), F.lit("x"), {"B": "ART"})) == "ART"


def test_wiki_and_html_fields(spark):
    m = one(spark, files.template_fields(F.lit("{{a|b\n| x = 1\n2\n|y=p=q\n|x=3\n|z=}}")))
    assert m == {"x": "1 2", "y": "p=q", "z": ""}
    assert one(spark, files.table_cells(F.lit("<TABLE><tr><th>a <b>b</b></th><td>c</td></tr><tr></tr></TABLE>"))) == [["a b", "c"], []]
    assert one(spark, files.xml_field(F.lit("<a x='1'>p <i>q</i>\n r</a>"), "a")) == "p q r"


def test_folders_are_scanned_and_checked(spark, tmp_path):
    (tmp_path / "one.csv").write_bytes("﻿k,v\na,1\n".encode())
    (tmp_path / "errata_one.csv").write_text("k,v\nz,\n")
    (tmp_path / "two.csv").write_text('k,v\nb,2\n"c,d",3\n')
    df = files.scan_folder(spark, f"{tmp_path}/*.csv", "k string, v int", ("k", "v"))
    assert sorted((r["k"], r["v"], r["file_name"]) for r in df.collect()) == [("a", 1, "one.csv"), ("b", 2, "two.csv"), ("c,d", 3, "two.csv")]
    (tmp_path / "two.csv").write_text("k,v\nb,\n")
    with pytest.raises(Exception, match="v is empty in two.csv"):
        files.scan_folder(spark, f"{tmp_path}/*.csv", "k string, v int", ("k", "v")).collect()


def test_keys_are_folded(spark):
    df = spark.createDataFrame([(1, 2, "b", False, "n2"), (1, 1, " ", True, ""), (1, 3, "c", None, "n3"), (2, 1, None, None, None)], "k int, o int, et string, f boolean, note string")
    got = {r["k"]: (r["et"], r["f"], r["note"]) for r in files.fold_keyed(df, "k", "o", ("et",), ("f",), ("note",)).collect()}
    assert got == {1: ("b", True, "n2 n3"), 2: (None, False, "")}


def test_ranks_in_buckets_equal_one_window(spark):
    df = spark.createDataFrame([(i % 3, (i * 37) % 100, f"w{i * 7 % 50}") for i in range(60)], "g int, u int, s string")
    for unit in ("u", "s"):
        got = nulls.ranked(df, ["g"], nulls.bucket_of(df, F.col(unit)), [unit, "u"]).collect()
        for g in range(3):
            mine = sorted((r for r in got if r["g"] == g), key=lambda r: r["_k"])
            assert [r["_k"] for r in mine] == list(range(1, 21)) and [(r[unit], r["u"]) for r in mine] == sorted((r[unit], r["u"]) for r in mine)
    worlds = nulls.permute(df.select("u", "s").dropDuplicates(["u"]), 3, 1, "s", F.col("u"))
    assert {tuple(sorted(r["s"] for r in worlds.where(f"rep = {k}").collect())) for k in (1, 2, 3)} == {tuple(sorted(r["s"] for r in df.dropDuplicates(["u"]).collect()))}
    assert nulls.permute(df.limit(0), 3, 1, "s", F.col("u")).count() == 0


def test_witnesses_are_reconciled(spark):
    rows = [(["avil", "clan", "turce", "xx", "mi", "mi"], ["mi", "avils", "clan", "turke", "zz"]), ([], ["a"]), (["a"], [])]
    df = spark.createDataFrame(rows, "a array<string>, b array<string>")
    got = [tuple(r) for r in matching.reconcile_lists(df, "a", "b").select("n_exact", "n_soft", "n_edit", "n_left", "n_right").collect()]
    assert got == [(2, 1, 1, 2, 1), (0, 0, 0, 0, 1), (0, 0, 0, 1, 0)]


def test_words_are_found_by_key_not_in_pairs(spark):
    """Long turns: free words are found by their keys, in time that grows with the words, and as by comparing all."""
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("abeikt") for _ in range(rng.randint(1, 7)))
    rows = [([word() for _ in range(n)], [word() for _ in range(m)]) for n, m in ((400, 300), (50, 400), (1, 1), (0, 3))]
    df = spark.createDataFrame(rows, "a array<string>, b array<string>")
    soft = df.select(records.soft_jaccard(F.col("a"), F.col("b"), text.soft_equal).alias("x"))
    assert [r["x"] for r in soft.collect()] == pytest.approx([soft_brute(a, b) for a, b in rows])
    left, right, counts = F.col("a"), F.col("b"), []
    for same in (lambda x, y: x == y, text.soft_equal):
        m = records.greedy(left, right, same)
        left, right, counts = m["left"], m["rest"], [*counts, m["hit"]]
    want = df.select(F.struct(*counts, left, right)).collect()
    got = df.select(records.paired(F.col("a"), F.col("b"))).collect()
    assert [tuple(r[0]) for r in got] == [tuple(r[0]) for r in want]
    assert "lambdafunction" not in soft._jdf.queryExecution().optimizedPlan().toString()
