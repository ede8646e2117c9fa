"""Small cases against brute force: nulls, empty and long texts, ties, repeats, empty tables, clashing columns."""

import base64
import collections
import gzip
import hashlib
import io
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpuslens.llm import decontaminate, html, jaccard, linededup, lsm, pieces, quality, suffixes, topk, warc
from corpuslens.llm.components import components
from corpuslens.llm.common import Store, hot_join, range_hash

WORD = re.compile(r"[^\x20\x09-\x0D]+")
DOCS = "doc_id long, text string, rank string, copies int, score string"


def corpus(seed=1, n=40):
    rng = random.Random(seed)
    vocab = ["".join(rng.choices("abcdeé", k=rng.randint(1, 6))) for _ in range(300)]
    line = lambda k: " ".join(rng.choices(vocab, k=k))
    shared = [line(60), line(25), line(21)]
    texts = []
    for i in range(n):
        parts = [line(rng.randint(1, 30)) for _ in range(rng.randint(1, 6))]
        if i % 3 == 0:
            parts.insert(rng.randint(0, len(parts)), rng.choice(shared))
        texts.append("\n".join(parts))
    texts[5] = texts[2]
    texts[9] = texts[2] + " x"
    words = texts[7].split(" ")
    texts[11] = " ".join([*words[:-1], "other"])
    texts += [None, "", " \t\n ", "one", "one", "two words", "ab" * 500, "ab" * 500 + "c", line(3000), "é" * 450, "z" * 1200]
    rows = [(i, t, "r", 1, "s") for i, t in enumerate(texts)]
    return rows + [(3, texts[3], "r", 1, "s"), (None, texts[4], "r", 1, "s"), (None, None, None, None, None)]


def frame(spark, rows):
    return spark.createDataFrame(rows, DOCS)


def by_id(rows):
    return {i: t for i, t, *_ in rows if i is not None}


def test_lsm_matches_brute_force(spark):
    rows = corpus()
    got = {r["doc_id"]: r for r in lsm.dedup(frame(spark, rows)).collect() if r["doc_id"] is not None}
    first = {}
    for i, t in sorted(by_id(rows).items()):
        w = WORD.findall(t or "")
        for s in range(len(w) - 19):
            first.setdefault(tuple(w[s:s + 20]), (i, s))
    for i, t in by_id(rows).items():
        w = WORD.findall(t or "")
        dead = set()
        for s in range(len(w) - 19):
            if first[tuple(w[s:s + 20])] != (i, s):
                dead |= set(range(s, s + 20))
        kept = " ".join(x for k, x in enumerate(w) if k not in dead)
        assert (got[i]["n_words"], got[i]["n_removed"], got[i]["text"]) == (len(w), len(dead), kept), i
    assert lsm.dedup(frame(spark, rows)).count() == len(rows)
    assert lsm.dedup(frame(spark, [])).count() == 0


def test_lsm_index_compacts_and_gives_the_same_for_any_batches(spark):
    rows = corpus(2)
    runs = [sorted((r["doc_id"] or -1, r["n_removed"]) for r in lsm.dedup(frame(spark, rows), batches=b).collect()) for b in (1, 7)]
    assert runs[0] == runs[1]


def test_lsm_index_is_opened_again_for_the_next_batch(spark, tmp_path):
    rows = [r for r in corpus(2) if r[0] is not None]
    whole = {(r["doc_id"], r["n_removed"], r["text"]) for r in lsm.dedup(frame(spark, rows)).collect()}
    ids = sorted({r[0] for r in rows})
    cuts = [ids[0], ids[len(ids) // 3], ids[2 * len(ids) // 3], ids[-1] + 1]
    got, path = set(), f"file://{tmp_path}/index"
    before = len(spark.catalog.listTables())
    for k in range(3):  # each batch by an index opened anew
        index = lsm.FingerprintIndex(spark, fan_in=2, path=path)
        batch, past = frame(spark, [r for r in rows if cuts[k] <= r[0] < cuts[k + 1]]), frame(spark, [r for r in rows if r[0] < cuts[k]])
        got |= {(r["doc_id"], r["n_removed"], r["text"]) for r in lsm.dedup(batch, batches=1, index=index, history=past).collect()}
        assert len(index.runs) <= 2
        index.save()
        index.close()
    assert got == whole and len(spark.catalog.listTables()) == before


def test_lsm_index_survives_a_crash_while_saving(spark, tmp_path, monkeypatch):
    path = f"file://{tmp_path}/index"
    index = lsm.FingerprintIndex(spark, fan_in=2, path=path)
    index.append(lsm.fingerprints(frame(spark, [(1, " ".join(map(str, range(60))), "", 1, "")]).withColumn("k1", F.lit(0).cast("long")), 20))
    with pytest.raises(ValueError, match="no manifest"):  # runs that were never saved are not an empty index
        lsm.FingerprintIndex(spark, path=path)
    index.save()
    index.append(lsm.fingerprints(frame(spark, [(2, " ".join(map(str, range(90, 150))), "", 1, "")]).withColumn("k1", F.lit(0).cast("long")), 20))

    def crash(*tables):
        raise RuntimeError("killed")

    monkeypatch.setattr(index.store, "drop", crash)
    with pytest.raises(RuntimeError):  # after the new manifest stands, before the old one goes
        index.save()
    assert len(lsm.FingerprintIndex(spark, path=path).runs) == 2
    last = sorted(x for x in index._names() if lsm.MANIFEST.fullmatch(x))[-1]
    (tmp_path / "index" / last).rename(tmp_path / "index" / "_draft-x")  # as if the crash came before the rename
    assert len(lsm.FingerprintIndex(spark, path=path).runs) == 1


def test_repeated_ids_with_different_texts(spark):
    t = " ".join(map(str, range(40)))
    rows = [(1, t, "", 1, ""), (1, t + " more", "", 1, ""), (2, "none of this", "", 1, "")]
    assert sum(r["n_removed"] for r in lsm.dedup(frame(spark, rows)).collect()) == 40
    out = suffixes.dedup(frame(spark, [(1, "q" * 401, "", 1, ""), (1, "x" * 10 + "q" * 400, "", 1, "")])).collect()
    assert sorted(r["n_removed"] for r in out) == [400, 401]


@pytest.mark.parametrize("n,m,k", [(400, 256, 128), (60, 40, 16), (30, 30, 30)])
def test_suffix_orders_match_brute_force(spark, n, m, k):
    rows = corpus(3)
    again = rows[5][1] + " and more " + rows[6][1]
    rows += [(3, again, "", 1, ""), (8, again[3:], "", 1, "")]  # ids that repeat are documents of their own
    rng = random.Random(9)
    short = ["".join(rng.choices("uvwxyz", k=size)) for size in (42, 300)]
    rows += [(200 + i, f"{i} own {short[i % 2]} text {i}", "", 1, "") for i in range(4)]  # long enough to be reported only
    got = collections.Counter((r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"], r["n_repeated"], bytes(r["kept"])) for r in suffixes.dedup(frame(spark, rows), n, m, k).collect() if r["doc_id"] is not None)
    texts = [(i, (t or "").encode()) for i, t, *_ in rows if i is not None]
    want = collections.Counter()
    dead = {}
    for size in (n, m):
        count = collections.Counter(b[p:p + size] for _, b in texts for p in range(len(b) - size + 1))
        for x, (_, b) in enumerate(texts):
            cover = np.zeros(len(b) + 1, int)
            for p in range(len(b) - size + 1):
                if count[b[p:p + size]] > 1:
                    cover[p] += 1
                    cover[p + size] -= 1
            dead[size, x] = np.cumsum(cover)[: len(b)] > 0
    for x, (i, b) in enumerate(texts):
        d = dead[n, x]
        spans = int((d & ~np.concatenate(([False], d[:-1]))).sum()) if len(b) else 0
        want[i, len(b), int(d.sum()), spans, int(dead[m, x].sum()), bytes(y for y, gone in zip(b, d) if not gone)] += 1
    assert got == want and any(x[2] < x[4] for x in want) == (m < n)
    assert suffixes.dedup(frame(spark, [])).count() == 0


def test_column_order_finds_common_windows():
    columns = suffixes.Columns(12)
    strings = [b"abcdefghijkl", b"xbcdefghijkl", b"abcdefghijkz", b"bcdefgh", b"abcdefghijkl"]
    columns.append(strings, np.array([0, 0, 0, 1, 0]))
    [flags] = suffixes.repeated_starts(columns, np.array([0, 0, 0, 0, 1]), (6,), 6)
    assert flags.tolist() == [[True] * 7, [False] + [True] * 6, [True] * 6 + [False], [False, True, True, False, False, False, False], [False] * 7]


def jaccard_brute(rows, k, pct):
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    sets = {}
    for i, t in by_id(rows).items():
        w = WORD.findall((t or "").translate(low))
        sets[i] = {tuple(w[j:j + k]) for j in range(len(w) - k + 1)} or ({tuple(w)} if w else set())
    parent = {i: i for i in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in sets:
        for b in sets:
            if a < b and sets[a] and sets[b]:
                c = len(sets[a] & sets[b])
                if 100 * c >= pct * (len(sets[a]) + len(sets[b]) - c):
                    x, y = root(a), root(b)
                    parent[max(x, y)] = min(x, y)
    return {i: (len(s), root(i)) for i, s in sets.items()}


@pytest.mark.parametrize("k,pct,most", [(4, 85, 20_000), (5, 80, 6)])
def test_jaccard_components_match_brute_force(spark, monkeypatch, k, pct, most):
    rng = random.Random(4)
    rows = corpus(4, 20)
    base = [f"w{rng.randint(0, 400)}" for _ in range(120)]
    for i in range(60):  # a dense and a frayed group of near copies
        w = list(base)
        for _ in range(rng.choice((1, 2, 3, 4))):
            w[rng.randrange(len(w))] = f"e{rng.randint(0, 10**6)}"
        rows.append((100 + i, " ".join(w).upper() if i % 7 == 0 else " ".join(w), "", 1, ""))
    monkeypatch.setattr(jaccard, "FREQUENT", 5)
    monkeypatch.setattr(jaccard, "STAR", 4)
    monkeypatch.setattr(jaccard, "LIST", most)  # longer lists are dealt out over parts
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard.linked(frame(spark, rows), k, pct).collect() if r["doc_id"] is not None}
    assert got == jaccard_brute(rows, k, pct)


def test_jaccard_empty_table(spark):
    assert jaccard.linked(frame(spark, [])).count() == 0


def test_a_document_links_by_any_of_its_sets(spark):
    rows = [(1, "a b c d e f"), (1, "x y z"), (2, "x y z"), (3, "A b c d e f"), (4, "p q r s t"), (4, "p q r s t"), (5, ""), (6, "p q r s t"), (None, "x y z")]
    got = sorted((r["doc_id"] or 0, r["n_shingles"], r["component_id"] or 0) for r in jaccard.linked(frame(spark, [(i, t, "", 1, "") for i, t in rows])).collect())
    assert got == [(0, 1, 0), (1, 1, 1), (1, 3, 1), (2, 1, 1), (3, 3, 1), (4, 2, 4), (5, 0, 5), (6, 2, 4)]


def test_bitmaps_never_rule_out_a_link():
    rng = np.random.default_rng(5)
    for n in (3, 70, 300):
        a = rng.integers(0, 2**63, n, dtype=np.uint64)
        b = np.concatenate((a[: int(n * 0.95)], rng.integers(0, 2**63, n // 20, dtype=np.uint64)))
        c = len(np.intersect1d(a, b))
        if 100 * c >= 85 * (len(a) + len(b) - c):
            assert jaccard.may_reach(jaccard.bitmap(a), jaccard.bitmap(b), len(a), len(b), 85)


def test_components_of_a_long_path(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101)], "x long, y long")
    got = {r["node"]: r["comp"] for r in components(edges, Store(spark)).collect()}
    assert set(got[i] for i in range(41)) == {0} and got[101] == 100


def test_hot_join_equals_a_join(spark):
    left = spark.range(1000).selectExpr("id", "if(id % 3 = 0, 7, id % 50) as k")
    right = left.groupBy("k").count()
    a = hot_join(left, right, "k", "count", 1000, share=20).orderBy("id").collect()
    assert a == left.join(right, "k", "left").orderBy("id").collect()


def test_topk_ties_and_bad_vectors(spark):
    rows = [(i, [float((i * j) % 5 - 2) / 8 for j in range(6)]) for i in range(50)] + [(60, None), (61, [None, 1.0]), (62, [float("nan")]), (63, [float("inf")]), (64, []), (65, [1e9, 1.0]), (None, [1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    v = topk.quantised(df, "vec_id", "embedding")
    got = collections.defaultdict(list)
    for r in topk.exact_topk(v, v.where("id % 5 = 0"), 7, block=8, query_block=4).orderBy("query_id", "rank").collect():
        got[r["query_id"]].append((r["vec_id"], r["score"]))
    vecs = {i: [int(np.floor(64 * x)) for x in e] for i, e in rows if i is not None and e is not None and all(x is not None and np.isfinite(x) for x in e)}
    for q in (i for i in vecs if i % 5 == 0):
        s = sorted((-sum(a * b for a, b in zip(vecs[q], e)), i) for i, e in vecs.items() if i != q)[:7]
        assert got[q] == [(i, -x) for x, i in s], q
    one = topk.quantised(df.where("vec_id = 0"), "vec_id", "embedding")
    assert topk.exact_topk(one, one).count() == 0


def test_warc_round_trip(spark, tmp_path):
    rows = [(1, "http://a\r\nb", "<p>x</p>"), (2, None, "<p>x</p>"), (3, "u", None), (4, "u", ""), (5, "u", "é\r\n\r\nWARC/1.1\r\n\r\n" * 50), (5, "u", "y"), (6, "u", "z" * 200_000), (None, "u", "<p>x</p>"), (7, "u", "q"), (7, "u", "q")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    at = str(tmp_path / "warc")
    warc.write(pages, warc.resolve(warc.headers(pages)), at, per_file=3)
    back = warc.read(spark, at).collect()
    assert len(back) == len(rows)
    by = collections.defaultdict(list)
    for r in back:
        by[r["page_id"]].append(r)
    assert by[1][0]["record_type"] == "revisit" and by[1][0]["refers_to"] == 2 and by[2][0]["record_type"] == "response"
    assert by[3][0]["refers_to"] == 4 and by[4][0]["payload_bytes"] == 0
    assert by[None][0]["refers_to"] == 2
    assert {r["html"] for r in by[5]} == {"y", rows[4][2]} and by[6][0]["payload_bytes"] == 200_000
    assert [r["record_type"] for r in by[7]] == ["response"] * 2
    files = [f["content"] for f in spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(at).collect()]
    names = [h["WARC-Record-ID"] for f in files for h, _, _ in warc.parse(gzip.GzipFile(fileobj=io.BytesIO(f)))]
    assert len(names) == len(set(names)) == len(rows)
    # Each record is a member of its own.
    for raw in files:
        while raw:
            one = zlib.decompressobj(31)
            assert len(list(warc.parse(io.BytesIO(one.decompress(raw))))) == 1 and one.eof
            raw = one.unused_data
    assert all(r["payload_digest"] == base64.b32encode(hashlib.sha1(r["html"].encode()).digest()).decode() for r in back if r["record_type"] == "response")
    none = pages.limit(0)
    warc.write(none, warc.resolve(warc.headers(none)), at + "2")
    assert warc.read(spark, at + "2").count() == 0


def test_warc_member_of_a_long_record_ends_with_a_zero(spark, tmp_path):
    html = "long " * ((1 << 24) // 5 + 9)
    out = warc.member(html) + b"\0"
    assert gzip.decompress(out) == (html + warc.END).encode()
    pages = spark.createDataFrame([(1, "u", html), (2, "u", "short")], "page_id long, url string, html string").coalesce(1)
    warc.write(pages, warc.resolve(warc.headers(pages)), str(tmp_path / "w"))
    assert {r["page_id"]: r["html"] for r in warc.read(spark, str(tmp_path / "w")).collect()} == {1: html, 2: "short"}


PAGE = """<!DOCTYPE html><html><head><title>T</title><script>var a="</p><p>no";</script></head><body><header><p>Site name</p></header><nav><ul><li><a href="/">Home</a></ul></nav>
<article><h1>Head &amp; line</h1><p><b>First   par<br>broken <p>Second &lt;b&gt; &eacute;<aside>side</aside><div class="ad">buy</div><form><p>mail</p></form><section class="comments"><p>nice!</p></section></article>
<div id="cookie-notice">We use cookies</div><footer>&copy; me</footer></body></html>"""


def test_html_keeps_the_article_only():
    assert html.main_text(PAGE) == "Head & line\nFirst par broken\nSecond <b> é"
    assert html.main_text(None) == html.main_text("") == ""
    assert html.main_text("<p>cut <b") == html.main_text("<p>cut <b")  # broken markup is no error


def test_html_furniture_by_name():
    page = "<body><div class='site-header'><p>Brand</p></div><main><div class='article-header'><h1>Title</h1></div><p>Text &nbsp; here<br>and there</p><div id=newsletter><p>Sign up</p></div><p hidden>no</p><ul><li>point</ul><table><tr><td>a<td>b</table></main></body>"
    assert html.main_text(page) == "Title\nText here and there\npoint\na\nb"


def test_html_two_passes_without_an_article():
    long = "The people of the town were in the street and it was not for them to say that this was the end of what they had. " * 3
    page = f"<body><div><a href='/'>Home</a> <a href='/x'>News</a></div><p>Short.</p><p>{long}</p><p>Between.</p><p>{long}</p><ul><li><a href=1>one</a><li><a href=2>two</a></ul></body>"
    assert html.main_text(page) == "\n".join(["Between." if x == "b" else long.strip() for x in ("l", "b", "l")])


def test_html_comments_that_are_articles_do_not_mark_the_page():
    long = "The people of the town were in the street and it was not for them to say that this was the end of what they had. " * 3
    page = f'<body><ul><li><a href=1>one</a><li><a href=2>two</a></ul><h1>Head</h1><p>{long}</p><p>Last.</p><ol class="comment-list"><li class="comment"><article class="comment-body"><p>Nice, and thanks for it.</p></article></ol></body>'
    assert html.main_text(page).split("\n")[:2] == ["Head", long.strip()] and "Nice" not in html.main_text(page)


def test_html_open_blocks_take_the_nearest_label():
    long = "The people of the town were in the street and it was not for them to say that this was the end of what they had. " * 3
    page = f"<body><div><a href='/'>Home</a></div><h2>Head</h2><p>Far.</p><p>First.</p><p>{long}</p><p>Last.</p><p>Off.</p><p>Off.</p><ul><li><a href=1>one</a></ul></body>"
    assert html.main_text(page).split("\n") == ["Head", "First.", long.strip(), "Last."]


P = "<p>It was the best of times and it was the worst of times, and this is what the people of the town had to say of it for all the years that they were in it.</p>"


def test_html_names_are_one_sign_among_others():
    page = f"""<article>{P}<section class="related-work"><p>Work like this is in the papers of the field and it was not easy to do for us.</p></section><p class="search">To search is to look.</p>
<h2 id="share-prices">Share prices</h2>{P}<div id="alert-systems">Alert systems are in use.</div><div class="share"><a href=1>Share</a></div><div class="comment-list"><p>I was there and it was not as you say it was, and they know it.</p></div></article>"""
    text = html.main_text(page)
    assert all(x in text for x in ("Work like this", "To search is", "Share prices", "Alert systems are"))
    assert "Share\n" not in text + "\n" and "I was there" not in text
    page = f'<nav><a href="/">Home</a></nav><article class="teaser"><p>Teaser</p></article><div class="post">{P * 3}</div><div class="sidebar-left">{P}</div><footer>x</footer>'
    assert html.main_text(page).split("\n") == [P[3:-4]] * 3
    assert [html.name_kind(x, True) for x in ("share-prices", "cookie_banner", "nav-main-2", "x", "Comment", "header")] == [html.PLAIN, html.PROSE, html.SIGN, html.PLAIN, html.PROSE, html.PLAIN]


def test_html_time_is_linear():
    import time

    for make in (lambda n: '<a "x ' * n, lambda n: '<a "x ' * n + ">", lambda n: "<div>" * n + "x" + "</p>" * n, lambda n: "<p><article>" + "<div>" * n + "</p>" * n, lambda n: "<![CDATA[" * n + "<!--" * n):
        html.main_text(make(100))
        began = time.process_time()
        html.main_text(make(20_000))
        assert time.process_time() - began < 3
    assert html.main_text("<p>" + "the word " * 200_000 + "</p>").count("word") == 200_000


def label_brute(found):
    """The rules of the module, one by one and with whole searches."""
    def text_label(b):
        if b.linked / len(b.text) > 0.33:
            return False
        if len(b.text) < 70:
            return False if b.linked else None
        if b.stops >= 0.32 or (b.stops >= 0.30 and len(b.text) > 200):
            return True
        return None if b.stops >= 0.30 or len(b.text) > 600 else False

    free = [not b.inside and b.kind != html.PROSE for b in found]
    own = [text_label(b) if f else None for b, f in zip(found, free)]
    size = {w: sum(len(b.text) for b, x in zip(found, own) if x and (b.article > 0) == w) for w in (True, False)}
    marked = any(f and b.article for b, f in zip(found, free)) and size[True] >= size[False]
    open_ = [b for b in found if not b.inside and b.kind == html.PLAIN and b.linked / len(b.text) <= 0.33]
    words = sum(len(b.text.split()) for b in open_)
    usual = sum(b.stops * len(b.text.split()) for b in open_) / words if words else 0
    first, counts = [], []
    for b, f, x in zip(found, free, own):
        if not f:
            label = False
        elif marked and not b.article:
            label = None if x and b.kind == html.PLAIN and not b.linked and len(b.text) > 600 else False
        elif not marked and not b.article:
            label = False if b.kind or b.linked / len(b.text) > 0.33 or (len(b.text) < 70 and b.linked) else True if len(b.text) >= 70 and b.stops >= usual / 2 else None
        else:
            linky = b.linked / len(b.text) > 0.33
            if b.kind:
                label = False if linky or len(b.text) < 70 or b.linked / len(b.text) > 0.2 or b.stops < 0.30 else (True if x else None)
            else:
                label = False if linky and len(b.text) >= 70 else (True if x else None)
        first.append(label)
        counts.append(label is not None and f and not b.kind and (bool(b.article) or not marked))  # decided by its text
    out = []
    for i, b in enumerate(found):
        if first[i] is not None:
            out.append(first[i])
            continue
        here = b.article > 0
        near = [j for j in range(len(found)) if first[j] is not None and (counts[j] if here or not marked else True) and (not here or found[j].article == b.article)]
        left, right = max((j for j in near if j < i), default=None), min((j for j in near if j > i), default=None)
        if left is None or right is None:
            out.append(here == marked if left is None and right is None else first[left if right is None else right])
        elif b.heading or right - i < i - left:
            out.append(first[right])
        elif i - left < right - i:
            out.append(first[left])
        else:
            out.append((first[left] or first[right]) if here else (first[left] and first[right]))
    return out


def test_html_labels_match_the_rules_one_by_one():
    rng = random.Random(5)
    words = ["the", "and", "was", "of", "house", "river", "table", "green"]
    for _ in range(400):
        found, article = [], 0
        for _ in range(rng.randint(1, 12)):
            article = rng.choice((article, article, 0, article + 1))
            text = " ".join(rng.choices(words, (rng.choice((1, 2, 4)),) * 4 + (3,) * 4, k=rng.choice((1, 5, 12, 20, 60, 200))))
            found.append(html.Block(text, rng.choice((0, 0, 0, len(text) // 4, len(text))), rng.random() < 0.1, rng.choice((0, 0, 0, 0, 1, 2)), article, rng.random() < 0.2))
        html.decide(found)
        assert [b.label for b in found] == label_brute(found)


def test_html_pages_without_an_article():
    short = '<nav><a href="/">Home</a></nav><div class="post"><h1>On cats</h1><p>A cat sat there.</p><p>It went.</p></div><footer>me</footer>'
    assert html.main_text(short) == "On cats\nA cat sat there.\nIt went."
    assert html.main_text("<p>One paragraph of sixty-one characters, no more and no less..</p>").startswith("One paragraph")
    news = "Prices rose sharply last month, official figures showed yesterday, surprising analysts. Ministers blamed energy costs; retailers blamed wages. Shares fell 2%. " * 3
    italian = "Il gatto dormiva vicino alla finestra mentre fuori pioveva, e nessuno sapeva dove fosse finito il padrone di casa quella sera. " * 6
    for text in (news, italian, news * 3):
        page = f'<body><div id="menu"><a href="/">Home</a> <a href="/b">B</a></div><div class="post"><h2>Title</h2><p>{text}</p><p>Fine.</p></div><div class="related"><p>{text}</p></div><div class="cookie-banner">{text}</div></body>'
        assert html.main_text(page) == f"Title\n{text.strip()}\nFine."
    assert "more of it" not in html.main_text(f'<article>{P}<div class="related"><p>It was there and it was more of it than they had to say.</p></div>{P}</article>')


def test_html_tables_without_their_article_tags(spark):
    """The main text of the test pages is what their article tags say; without these tags as much is found, and no furniture."""
    rows = spark.read.parquet("/root/testdata/sf0.01/pages.parquet").select("html").where("html is not null").collect()
    had = lost = 0
    for r in rows:
        want = html.main_text(r["html"]).split("\n")
        got = html.main_text(re.sub(r"<(/?)(article|main)\b", r"<\1div", r["html"])).split("\n")
        had += sum(map(len, want))
        lost += sum(len(x) * n for x, n in (collections.Counter(want) - collections.Counter(got)).items())
        assert not collections.Counter(got) - collections.Counter(want)
    assert rows and lost <= 0.05 * had


def test_html_operator(spark):
    df = spark.createDataFrame([(1, "u", PAGE, 7), (2, None, None, 8), (None, "u", "", 9), (1, "u", PAGE, 7)], "page_id long, url string, html string, text int")
    got = html.extract(df, keep=("url", "text", "html")).collect()
    rows = {r["page_id"]: r for r in got}
    assert rows[1]["n_chars"] == len(rows[1]["text"]) and rows[2]["text"] == "" and rows[None]["n_chars"] == 0 and len(got) == 4 and rows[1]["html"] == PAGE
    assert html.extract(df.limit(0)).count() == 0


def test_contained_items(spark):
    rng = random.Random(6)
    words = [f"w{i}" for i in range(500)]
    item = {i: rng.choices(words, k=rng.randint(1, 40)) for i in range(30)}
    docs = {}
    for i in range(60):
        w = rng.choices(words, k=rng.randint(0, 300))
        if i % 2:
            piece = list(item[i % 30])
            if i % 3 == 0 and len(piece) > 20:
                piece[rng.randrange(len(piece))] = "changed"
            w[len(w) // 2:len(w) // 2] = piece
        docs[i] = " ".join(w).upper() if i % 5 == 0 else " ".join(w)
    docs[60], docs[61] = None, ""
    d = frame(spark, [(i, t, "", 1, "") for i, t in docs.items()] + [(None, docs[1], "", 1, "")])
    it = spark.createDataFrame([(i, " ".join(w)) for i, w in item.items()] + [(90, None), (91, ""), (None, "x")], "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]): (r["n_item"], r["n_common"]) for r in decontaminate.contained(d, it).collect()}
    runs = lambda w: {tuple(w[j:j + 5]) for j in range(len(w) - 4)} or ({tuple(w)} if w else set())
    want = {}
    for i, t in docs.items():
        s = runs((t or "").lower().split())
        for j, w in item.items():
            q = runs(w)
            if len(s & q) * 100 >= 80 * len(q):
                want[i, j] = (len(q), len(s & q))
    assert got == want and want
    kept = decontaminate.clean(d, it)
    assert kept.columns == d.columns and kept.count() == len(docs) + 1 - len({i for i, _ in want})
    assert decontaminate.contained(d, it.limit(0)).count() == 0 and decontaminate.contained(d.limit(0), it).count() == 0


@pytest.mark.parametrize("least", [1, 2, 3, 7])
def test_line_runs_match_brute_force(spark, least):
    rng = random.Random(7)
    pool = [f"line {i}" for i in range(12)] + ["", " ".join(["long"] * 50)]
    runs = [[f"run {n} {j}" for j in range(n)] for n in (2, 3, 7, 40)]
    rows = [(i, "\n".join(rng.choices(pool, k=rng.randint(1, 12))), "", 1, "") for i in range(40)] + [(50, None, "", 1, ""), (51, "", "", 1, ""), (None, "line 1\nline 2", "", 1, "")]
    for i in range(60, 76):  # runs of 2, 3, 7 and 40 lines amid others, at ends of texts too, and within one text
        rows.append((i, "\n".join([f"own {i} {x}" for x in range(rng.randint(0, 3))] + runs[i % 4] + [f"end {i}"] * (i % 3) + (runs[i % 4] if i % 5 == 0 else [])), "", 1, ""))
    rows += [(3, "\n".join(runs[2]), "", 1, ""), (3, "x\ny\nz", "", 1, ""), (7, rows[7][1], "", 1, ""), (7, rows[7][1], "", 1, "")]  # ids and rows that repeat
    df = frame(spark, rows)
    out = linededup.dedup(df.withColumn("_runs", F.lit(1)).withColumn("n_runs", F.lit("clash")).withColumn("copy", F.lit(0)), least)
    key = {(r["doc_id"], r["text"]): r["k"] for r in df.select("doc_id", "text", F.xxhash64("text").alias("k")).collect()}
    lines = {(i, key[i, t]): t.split("\n") for i, t, *_ in rows if i is not None and t is not None}
    first, lone = {}, {}
    for i in sorted(lines):
        for p in range(len(lines[i])):
            if p + least <= len(lines[i]):
                first.setdefault(tuple(lines[i][p:p + least]), (i, p))
            lone.setdefault(lines[i][p], (i, p))
    places, m = {}, least
    while any(len(ls) >= m for ls in lines.values()):  # depths: the least run and its doublings, of parts that are not blank
        for i in sorted(lines):
            for p in range(len(lines[i]) - m + 1):
                if all(any(lines[i][q:q + least]) for q in range(p, p + m, least)):
                    places.setdefault((m, tuple(lines[i][p:p + m])), []).append((i, p))
        m *= 2
    copies = {}
    for (m, _), at in places.items():
        for i, p in at[1:]:
            copies.setdefault(i, []).append((-m, p, *at[0][0][:1], at[0][1]))
    for line, at in lone.items():
        for i, ls in lines.items():
            for p, x in enumerate(ls):
                if least > 1 and x == line and len(x.split()) >= 50 and (i, p) != at:
                    copies.setdefault(i, []).append((-1, p, at[0][0], at[1]))
    want = {}
    for i, ls in lines.items():
        dead = set()
        for p in range(len(ls)):
            w = tuple(ls[p:p + least])
            if len(w) == least and any(w) and first[w] != (i, p):
                dead |= set(range(p, p + least))
            if len(ls[p].split()) >= 50 and lone[ls[p]] != (i, p):
                dead.add(p)
        want[i] = (len(ls), len(dead), sum(p - 1 not in dead for p in dead), "\n".join(x for p, x in enumerate(ls) if p not in dead))
    assert out.count() == len(rows)
    found = sorted((r["doc_id"], r["n_lines"], r["n_deleted"], r["n_runs"], r["text"]) for r in out.where("doc_id is not null and text is not null").collect())
    assert found == sorted((i, *want[i, key[i, t]]) for i, t, *_ in rows if i is not None and t is not None)
    told = {(r["doc_id"], r["n_lines"], r["text"], (-r["copy"]["lines"], r["copy"]["at"], r["copy"]["first_doc_id"], r["copy"]["first_line"])) for r in out.where("copy is not null").collect()}
    assert told == {(i[0], want[i][0], want[i][3], min(c)) for i, c in copies.items()} and any(t[3][0] < -8 for t in told)
    rest = {r["doc_id"]: r["text"] for r in out.where("doc_id is null or doc_id = 50").collect()}
    assert rest == {None: "line 1\nline 2", 50: None}
    assert linededup.dedup(frame(spark, [])).count() == 0


def test_quality_learns_and_scores_everything(spark):
    rng = random.Random(8)
    good = lambda: " ".join(rng.choices(["the", "house", "stands", "by", "a", "river", "and", "old", "trees"], k=60)) + "."
    bad = lambda: " ".join(rng.choices(["%%%", "x1", "###", "buy", "$$$"], k=60))
    rows = [(i, good() if i % 3 else bad(), "", 1, "") for i in range(300)] + [(900, None, "", 1, ""), (901, "", "", 1, ""), (902, "a" * 200_000, "", 1, ""), (None, "x", "", 1, "")]
    labels = spark.createDataFrame([(i, int(i % 3 > 0), 0) for i in range(300)] + [(1, 0, 0), (None, 1, 0), (2, None, 0)], "doc_id long, quality int, toxic int")
    docs = frame(spark, rows)
    trees = quality.fit(docs, labels, trees=20)
    got = {r["doc_id"]: r["score"] for r in quality.score(docs, trees).collect()}
    assert len(got) == len(rows) and all(0 <= s <= 1 for s in got.values())
    assert np.mean([(got[i] >= 0.5) == (i % 3 > 0) for i in range(300)]) > 0.98
    flat = quality.fit(docs, labels.limit(0))
    assert {r["score"] for r in quality.score(docs, flat).collect()} == {0.5}
    assert quality.score(docs.limit(0), trees).count() == 0


def test_trees_match_exhaustive_splits_and_recursive_walks():
    rng = np.random.default_rng(3)
    x = rng.normal(size=(300, 4)).astype(np.float32)
    x[:, 3] = np.round(x[:, 3])  # ties
    y = ((x[:, 0] > 0.2) ^ (x[:, 3] > 0)).astype(float)
    t = quality.Trees.fit(x, y, trees=3, depth=3, bins=400, l2=2.0, least=1.0)
    p = y.mean()
    g, h = np.full(300, p) - y, np.full(300, p * (1 - p))
    best = max(
        (g[m].sum() ** 2 / (h[m].sum() + 2) + g[~m].sum() ** 2 / (h[~m].sum() + 2) - g.sum() ** 2 / (h.sum() + 2), j, e)
        for j in range(4) for e in np.unique(x[:, j])[:-1] if min(h[m := x[:, j] <= e].sum(), h[~m].sum()) >= 1
    )
    left = x[:, t.feature[0, 1]] <= t.threshold[0, 1]
    assert t.feature[0, 1] == best[1] and (left == (x[:, best[1]] <= best[2])).all()

    def walk(row):
        total = t.base
        for k in range(3):
            node = 1
            while node < 8:
                node = 2 * node + int(row[t.feature[k, node]] > t.threshold[k, node])
            total += float(t.value[k, node - 8])
        return 1 / (1 + np.exp(-total))

    assert np.allclose(t.score(x), [walk(r) for r in x])
    assert ((t.score(x) >= 0.5) == y).mean() > 0.9


def test_features_of_a_text_do_not_depend_on_the_batch():
    texts = [t for _, t, *_ in corpus(9) if t is not None]
    whole = quality.features(texts)
    assert np.isfinite(whole).all()
    for i in (0, 7, len(texts) - 1):
        assert np.allclose(quality.features([texts[i]])[0], whole[i], atol=1e-5)


@pytest.fixture(scope="module")
def lattices():
    return pieces.Lattices(pieces.Vocabulary(), 3e-4)


def test_samples_follow_the_lattice_without_replacement(lattices):
    v = lattices.vocabulary
    score = dict(zip(v.id.tolist(), v.score.tolist()))
    n = 20_000
    res = pieces.sample_batch(["the on"] * n, np.arange(n), 3, lattices, 3)
    seqs = [[tuple(ids[x:y].tolist()) for x, y in zip(ends[:-1], ends[1:])] for _, ids, ends, _, _ in res]
    assert all(len({a, b, c}) == 3 for a, b, c in zip(*seqs))
    known = {q: lp for s, r in zip(seqs, res) for q, lp in zip(s, r[3])}
    a, b = sorted(known, key=known.get)[-2:]
    assert abs((known[a] - known[b]) - 3e-4 * (sum(map(score.get, a)) - sum(map(score.get, b)))) < 1e-4
    assert abs(collections.Counter(seqs[0])[b] / n - np.exp(known[b])) < 0.015
    total = sum(np.exp(lp - li) for s, r in zip(seqs, res) for q, lp, li in zip(s, r[3], r[4]) if q == a)
    assert abs(total / n - np.exp(known[a])) < 0.03  # inverse-inclusion estimates are unbiased


@pytest.mark.parametrize("text", ["on", "the on", "ab", "een"])
def test_samples_match_all_segmentations(lattices, text):
    """Distinct samples, exact probabilities and inclusion scores against the list of all segmentations."""
    v = lattices.vocabulary
    scores = {}
    for i, key in enumerate(v.key.tolist()):
        scores[key] = (int(v.id[i]), float(v.score[i]))
    chars = np.array([pieces.BLANK if c == " " else ord(c) for c in " " + text], np.uint32)
    edges = {}
    for a in range(len(chars)):
        for b in range(a + 1, len(chars) + 1):
            if b == a + 1 or pieces.BLANK not in chars[a + 1:b]:
                key = int(range_hash(chars, np.array([a]), np.array([b]))[0])
                if key in scores:
                    edges[a, b] = scores[key]
                elif b == a + 1:
                    edges[a, b] = (None, v.spelt)
    paths = []

    def walk(at, ids, total):
        if at == len(chars):
            paths.append((tuple(ids), total))
        for b in range(at + 1, len(chars) + 1):
            if (at, b) in edges:
                i, x = edges[at, b]
                walk(b, [*ids, *([i] if i is not None else [int(v.byte_ids[y]) for y in chr(chars[at]).encode()])], total + lattices.theta * x)

    walk(0, [], 0.0)
    z = np.logaddexp.reduce([x for _, x in paths])
    p = {}
    for ids, x in paths:
        p[ids] = p.get(ids, 0.0) + np.exp(x - z)
    k, rounds = min(3, len(p)), 4000
    out = pieces.sample_batch([text] * rounds, np.arange(rounds), k, lattices, 5)
    drawn = []
    for live, ids, ends, logp, score in out:
        cut = [tuple(ids[a:b].tolist()) for a, b in zip(ends[:-1], ends[1:])]
        assert len(live) == rounds and all(x in p for x in cut)
        assert np.allclose(logp, [np.log(p[x]) for x in cut], atol=2e-3)
        drawn.append(cut)
    assert all(len(set(x)) == k for x in zip(*drawn))
    first, pairs = collections.Counter(drawn[0]), collections.Counter(zip(*drawn[:2])) if k > 1 else {}
    for x in p:  # the first by probability, the second by what is left without it
        assert abs(first[x] / rounds - p[x]) < 4 * np.sqrt(p[x] / rounds) + 2e-3
        for y in p if k > 1 else ():
            if x != y:
                q = p[x] * p[y] / (1 - p[x])
                assert abs(pairs[x, y] / rounds - q) < 4 * np.sqrt(q / rounds) + 2e-3
    # Horvitz-Thompson: weights p / inclusion add up to 1 on average.
    if k < len(p):
        total = sum(np.exp(logp - score) for _, _, _, logp, score in out)
        assert abs(total.mean() - 1) < 5 * total.std() / np.sqrt(rounds) + 1e-3


def test_sampling_operator(spark):
    texts = [None, "", " ", "  two  blanks ", "tab\tand\nline", "☃ 漢字 é", "a", "x" * 3000, "The end.\nThe end."]
    rows = [(i, t, "", 1, "") for i, t in enumerate(texts)] + [(4, texts[4], "", 1, ""), (None, "null id", "", 1, "")]
    out = pieces.sample(frame(spark, rows), k=3).collect()
    assert all(r["exact"] for r in out) and all(r["log_prob"] <= 1e-9 and r["log_inclusion"] <= 1e-9 for r in out)
    by = collections.defaultdict(list)
    for r in out:
        by[r["doc_id"]].append(tuple(r["ids"]))
    assert by[0] == [()] and by[1] == [()]
    assert len(by[8]) == len(set(by[8])) == 3 and sorted(by[4]) == sorted(2 * [*set(by[4])])
    alone = pieces.sample(frame(spark, [rows[8]]), k=3).collect()
    assert [tuple(r["ids"]) for r in alone] == by[8]
    back = pieces.decode(pieces.sample(frame(spark, rows), k=2), to="text").collect()
    assert all(r["text"] == (texts[r["doc_id"]] or "") for r in back if r["doc_id"] is not None)
    assert pieces.sample(frame(spark, [])).count() == 0


def test_pipeline_on_a_small_folder(spark, tmp_path):
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    rng = random.Random(10)
    words = ["the", "house", "stands", "by", "a", "river", "and", "old", "trees", "grow", "near", "it", "while", "boats", "pass"]
    text = lambda n: " ".join(rng.choices(words, k=n)) + "."
    docs = [(i, text(80) if i % 4 else " ".join(rng.choices(["%%%", "x1", "###", "$$$"], k=80)), "en", "s", 1) for i in range(120)]
    item = text(30)
    docs += [(200, docs[1][1], "en", "s", 1), (201, text(50) + " " + item + " " + text(50), "en", "s", 1), (202, None, "en", "s", 1), (None, text(80), "en", "s", 1)]
    sf = str(tmp_path)
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{sf}/documents.parquet")
    spark.createDataFrame([(i, int(i % 4 > 0), 0) for i in range(120)], "doc_id long, quality int, toxic int").write.parquet(f"{sf}/labels.parquet")
    spark.createDataFrame([(0, item)], "item_id long, text string").write.parquet(f"{sf}/benchmark.parquet")
    got = corpus_pipeline.run(spark, sf).collect()
    ids = {r["doc_id"] for r in got}
    assert {i for i in range(120) if i % 4} - ids == set() and not ids & {i for i in range(120) if i % 4 == 0}
    assert 200 not in ids and 201 not in ids and None in ids and all(r["exact"] for r in got)


def test_stages_take_repeats_nulls_and_clashing_columns(spark, tmp_path):
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    rng = random.Random(11)
    words = ["the", "house", "stands", "by", "a", "river", "and", "old", "trees", "grow", "near", "it", "while", "boats", "pass"]
    text = lambda n: " ".join(rng.choices(words, k=n))
    lines = "\n".join(text(30) for _ in range(4))
    rows = [(1, lines), (1, text(60)), (2, lines), (2, lines), (3, None), (4, ""), (None, lines), (5, text(90))]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or ""), "clash", 1, 0.5) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long, n_deleted string, component_id int, score double")
    spark.createDataFrame([(i, 1, 0) for i in range(1, 6)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(0, text(40)), (None, None)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, str(tmp_path))
        kept = collections.Counter(r["doc_id"] for r in out.collect())
        assert stage(spark, docs.limit(0), str(tmp_path)).count() == 0, name
        if name != "sentencepiece":
            assert tuple(out.columns) == corpus_pipeline.COLUMNS
        if name == "near_duplicates":  # 1 and 2 share a text; of 1's rows one stays
            assert kept == {1: 1, 3: 1, 4: 1, None: 1, 5: 1}
        elif name == "line_dedup":  # both rows of 2 repeat what 1 has
            assert kept == {1: 2, 3: 1, 4: 1, None: 1, 5: 1}
        elif name in ("quality", "decontamination"):
            assert kept == {1: 2, 2: 2, 3: 1, 4: 1, None: 1, 5: 1}
        else:
            assert kept == {1: 4, 2: 4, 3: 1, 4: 1, None: 2, 5: 2}
