"""Manifest, whitening and packing against plain versions: nulls, empty and long texts, ties, repeats, empty tables, clashing columns."""

import collections
import hashlib
import json
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpuslens.llm import merkle, packing, queries, whitening

DOCS = "doc_id long, text string, lang string, source string, n_chars long, pos int, n int, path string, g string"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def sha(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(doc_id, source, lang, n_chars, text):
    return sha(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (doc_id, source, lang, n_chars, text)))


def rise(nodes, fan=16):
    """All levels of a tree, from the leaves to the root."""
    out = [nodes]
    while len(out[-1]) > 1:
        out.append([sha(*out[-1][i:i + fan]) for i in range(0, len(out[-1]), fan)])
    return out


def beside(levels, i, fan=16):
    out = []
    for level in levels[:-1]:
        lo = i // fan * fan
        out.append((level[lo:i], level[i + 1:lo + fan]))
        i //= fan
    return out


def documents(seed=2):
    rng = random.Random(seed)
    rows = []
    for i in range(700):
        source = rng.choice(["hot", "hot", "b", "é", None, "a b", ""]) if i else "alone"
        text = rng.choice([None, "", "Ab cÉ", "plain", "X" * rng.randint(1, 3000), f"Text {i}"])
        rows.append((rng.choice([i, i, i, rng.randint(0, 50), None]), text, rng.choice(["en", None]), source, rng.choice([None, len(text or "")]), 1, 2, "p", "g"))
    return rows + [rows[7], rows[7], rows[8]]


def test_merkle_matches_plain_version(spark, tmp_path):
    rows = documents()
    spark.createDataFrame(rows, DOCS).write.parquet(f"{tmp_path}/documents.parquet")
    groups = collections.defaultdict(list)
    for d, text, lang, source, n, *_ in rows:
        groups[source].append((d is not None, d or 0, leaf(d, source, lang, n, text), (d, text, lang, source, n)))
    names = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    trees = {s: rise([x[2] for x in sorted(groups[s], key=lambda x: x[:3])]) for s in names}
    top = rise([trees[s][-1][0] for s in names])
    want = []
    for at, s in enumerate(names):
        for i, (_, _, own, (d, text, lang, source, n)) in enumerate(sorted(groups[s], key=lambda x: x[:3])):
            path = beside(trees[s], i) + beside(top, at)
            bad = d is not None and zlib.crc32(str(d).encode()) % 5 == 0
            h = leaf(d, source, lang, n, text.translate(LOWER) if text is not None else None) if bad else own
            for left, right in path:
                h = sha(*left, h, *right)
            want.append((d, own, trees[s][-1][0], top[-1][0], sha(*(x for left, right in path for x in left + right)), h, h == top[-1][0]))
    got = [tuple(r) for r in queries.op11_merkle(spark, str(tmp_path)).collect()]
    assert sorted(map(repr, got)) == sorted(map(repr, want))
    assert {r[6] for r in got} == {True, False}


@pytest.mark.parametrize("n", [0, 1, 2, 16, 17])
def test_merkle_of_few_rows(spark, n):
    df = spark.createDataFrame([(i, "Ab", "en", "s", 2, 1, 2, "p", "g") for i in range(n)], DOCS)
    got = merkle.manifest(df).select("leaf", "subroot", "root", merkle.siblings(F.col("path")).alias("s"), merkle.folded(F.col("leaf"), F.col("path")).alias("f")).collect()
    levels = rise([leaf(i, "s", "en", 2, "Ab") for i in range(n)]) if n else [[None]]
    assert len(got) == n and all(r["subroot"] == r["root"] == r["f"] == levels[-1][0] for r in got)
    assert sorted(len(r["s"]) for r in got) == sorted(64 * sum(len(a) + len(b) for a, b in beside(levels, i)) for i in range(n))


VECTORS = "vec_id long, embedding array<float>, x string, component string, w string"


def test_whitening_matches_numpy(spark):
    rng = np.random.default_rng(3)
    v = (rng.normal(size=(400, 6)) @ rng.normal(size=(6, 6))).astype(np.float32)
    v[50:90] = v[0]
    rows = [(i if i % 7 else None, r.tolist(), "x", "c", "w") for i, r in enumerate(v)]
    bad = [(900, None, "x", "c", "w"), (901, [1.0] * 5 + [None], "x", "c", "w"), (902, [float("nan")] * 6, "x", "c", "w"), (903, [float("inf")] + [0.0] * 5, "x", "c", "w"), (904, [1.0], "x", "c", "w"), (905, [], "x", "c", "w")]
    df = spark.createDataFrame(rows + bad, VECTORS)
    got = whitening.whiten(df, "vec_id", "embedding", components=4, scale=64, shift=1_000_000).collect()
    x = np.floor(64 * v.astype(np.float64)).astype(np.int64) + 1_000_000
    n, s = len(x), x.sum(axis=0)
    centred = (n * x - s) / n
    values, vectors = np.linalg.eigh(centred.T @ centred / n)
    values, vectors = values[::-1], vectors[:, ::-1]
    assert len(got) == 4 * n and {r["n"] for r in got} == {n}
    by = collections.defaultdict(list)
    for r in got:
        by[int(r["deviation"]), r["vec_id"]].append(r)
    want = centred @ vectors / np.sqrt(values)
    signs = {}
    for i, row in enumerate(x):
        own = by[sum((n * int(a) - int(b)) ** 2 for a, b in zip(row, s)), i if i % 7 else None]
        for r in own:
            j = r["component"] - 1
            signs.setdefault(j, np.sign(r["whitened"] * want[i, j]) if abs(want[i, j]) > 1e-3 else None) or signs.pop(j)
            assert abs(abs(r["whitened"]) - abs(want[i, j])) < 1e-9
            assert j not in signs or abs(r["whitened"] * signs[j] - want[i, j]) < 1e-9
            assert abs(r["explained"] / (values[j] / values.sum()) - 1) < 1e-9 and r["identity_error"] < 1e-9
    assert len(signs) == 4


def test_whitening_of_no_variance(spark):
    of = lambda rows: whitening.whiten(spark.createDataFrame(rows, VECTORS), "vec_id", "embedding", 4, 64, 5).collect()
    assert of([]) == [] and of([(1, None, "x", "c", "w")]) == [] and of([(1, [1.0, 2.0], "x", "c", "w")]) == [] and of([(1, [], "x", "c", "w")]) == []
    assert of([(i, [1.0, 2.0], "x", "c", "w") for i in range(9)]) == []
    line = of([(i, [float(i), 2.0], "x", "c", "w") for i in range(9)])  # one component has variance
    assert {r["component"] for r in line} == {1} and len(line) == 9 and all(r["explained"] == pytest.approx(1) for r in line)


def test_whitening_deviations_beyond_64_bits():
    row = np.array([[2**40, 3], [5, -(2**40)]], np.int64)
    assert whitening._squares(row) == [2**80 + 9, 25 + 2**80]


def least_sequences(lengths, capacity):
    """How many sequences best-fit decreasing takes."""
    gaps = collections.Counter()
    for x in sorted(lengths, reverse=True):
        at = min((g for g in gaps if g >= x and gaps[g]), default=None)
        if at is None:
            gaps[capacity - x] += 1
        else:
            gaps[at] -= 1
            gaps[at - x] += 1
    return sum(gaps.values())


@pytest.mark.parametrize("kind", ["uniform", "small", "equal", "large", "third", "halves"])
def test_packing_rounds(spark, kind, tmp_path, monkeypatch):
    from corpuslens.llm.common import Store

    monkeypatch.setattr(packing, "SWEEP_ROWS", 200)  # several ranges, so that pieces cross
    rng, capacity = random.Random(kind), 128
    many = {
        "uniform": [rng.randint(1, 128) for _ in range(1500)], "small": [rng.randint(1, 9) for _ in range(1500)], "equal": [40] * 900, "large": [rng.randint(60, 70) for _ in range(700)],
        "third": [17] * 600 + [rng.randint(1, 127) for _ in range(1200)], "halves": [64] * 301,
    }[kind]
    spark.createDataFrame(list(enumerate(many)), "uid long, length long").write.parquet(f"{tmp_path}/items")
    got = packing.placed(spark.read.parquet(f"{tmp_path}/items"), capacity, Store(spark)).collect()
    assert sorted((r["uid"], r["length"]) for r in got) == sorted(enumerate(many))
    fill = collections.Counter()
    for r in got:
        fill[r["seq"]] += r["length"]
    assert max(fill.values()) <= capacity
    assert len(fill) <= least_sequences(many, capacity) * 1.01 + 1


def test_across_is_a_match_of_brackets():
    rng = random.Random(4)
    for _ in range(200):
        counts = [(p, rng.randint(0, 5), rng.randint(0, 5)) for p in range(rng.randint(1, 8))]
        pairs, lows = packing.across(counts)
        want, free = {}, []
        for p, need, slots in counts:
            for i in range(need):
                if free:
                    want[p, i] = free.pop()
            free += [(p, k) for k in range(slots)]
        got = {(p, i): (q, top - 1 - (i - a)) for p, a, b, q, top in pairs for i in range(a, b)}
        assert got == want
        assert all((q, k) in got.values() for q, low in lows for k in range(low, dict((p, s) for p, _, s in counts)[q]))


def test_packing_keeps_every_token(spark):
    from tokenizers import Tokenizer

    path = packing.tokenizer_of(spark)
    rng = random.Random(6)
    word = lambda: "".join(rng.choices("abcdeé", k=rng.randint(1, 7)))
    texts = [" ".join(word() for _ in range(rng.choice((1, 5, 60, 300, 900)))) for _ in range(60)]
    texts += [None, "", " ", "\n\n  a  b \t c ", "one", "one", "<|endoftext|> x<|endoftext|>", "z" * 9000, " " * 700, "don't 's we'll x"]
    rows = [(i if i != 5 else None, t, "en", "s", 1, 1, 2, "p", "g") for i, t in enumerate(texts)] + [(3, texts[3], "en", "s", 1, 1, 2, "p", "g")]
    df = spark.createDataFrame(rows, DOCS)
    got = packing.pack(df, path, keep_ids=True)
    model = Tokenizer.from_file(path)
    want = collections.Counter()
    for d, t, *_ in rows:
        ids = [*model.encode(t or "", add_special_tokens=False).ids, 2]
        cuts = [0, *range(len(ids) % 1024 or 1024, len(ids) + 1, 1024)]
        for k, (a, b) in enumerate(zip(cuts, cuts[1:])):
            want[d, k, a, b - a, zlib.crc32(np.array(ids[a:b], "<u4").tobytes())] += 1
    out = got.collect()
    assert collections.Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in out) == want
    at = collections.defaultdict(list)
    for r in out:
        at[r["sequence_id"]].append((r["offset"], r["length"], bytes(r["ids"])))
    for s in packing.sequences(got).collect():
        own, end = sorted(at[s["sequence_id"]]), 0
        for offset, length, _ in own:
            assert offset == end
            end += length
        assert end <= 1024 and bytes(s["ids"]) == b"".join(x[2] for x in own) and s["n_pieces"] == len(own)
    assert packing.pack(df.limit(0), path).collect() == []


@pytest.mark.parametrize("kept", [packing.KEPT_UNITS, 60])
def test_units_spell_as_whole_texts_do(spark, tmp_path, monkeypatch, kept):
    monkeypatch.setattr(packing, "KEPT_UNITS", kept)
    path = packing.tokenizer_of(spark)
    encoder = packing.Encoder(path)
    assert encoder.cuts
    rng = random.Random(5)
    signs = [*"abc'sté ,.\n\t\r   0189ßЖ中$", " ", " ", "　", "\x85", "\x1c", "᠎", "﻿", "😀", "<|endoftext|>", " <|endoftext|> ", "'ll", " 's", "\n ", "  "]
    batches = [["".join(rng.choices(signs, k=rng.randint(0, 40))) for _ in range(rng.randint(0, 9))] for _ in range(800)]
    batches += [["".join(rng.choices("ab é.,\n", k=rng.randint(0, 60))) for _ in range(40)] for _ in range(40)]
    for texts in batches:
        assert encoder(texts) == [x.astype("<u4").tobytes() for x in encoder._alone(texts)]
    with open(path, encoding="utf-8") as f:
        other = json.load(f)
    other["pre_tokenizer"]["add_prefix_space"] = True
    (tmp_path / "t.json").write_text(json.dumps(other))
    assert not packing.Encoder(str(tmp_path / "t.json")).cuts
