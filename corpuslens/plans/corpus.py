"""Counts, positions, associations and word structure over the document tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from ..functions import stats, text
from ..operators import association, morphology, sequences, tokens
from ..sources.tables import load
from .registry import REC, TOK, TYPES, WORDS, query

ENDINGS = ("en", "er", "ing", "ed", "s", "es", "tion", "ly", "e", "t")


def _tok(spark, sf):
    return tokens.tokens(load(spark, sf, "documents"), "lang", "source")


@query(f"""WITH {TOK}, c AS (SELECT lang, source, w, count(*) AS c FROM tok GROUP BY ALL),
a AS (SELECT lang, source, sum(c) AS t, count(*) AS ty, count(*) FILTER (c = 1) AS h FROM c GROUP BY ALL),
b AS (SELECT lang, w, sum(c) AS c FROM c GROUP BY ALL), d AS (SELECT lang, sum(c) AS t, count(*) AS ty, count(*) FILTER (c = 1) AS h FROM b GROUP BY ALL),
r AS (SELECT lang, source, count(*) AS n FROM documents GROUP BY ALL)
SELECT lang, source, CAST(n AS BIGINT) AS n_records, CAST(t AS BIGINT) AS n_tokens, CAST(ty AS BIGINT) AS n_types, CAST(h AS BIGINT) AS n_hapax FROM a JOIN r USING (lang, source)
UNION ALL SELECT lang, 'all', (SELECT count(*) FROM documents x WHERE x.lang = d.lang), CAST(t AS BIGINT), CAST(ty AS BIGINT), CAST(h AS BIGINT) FROM d""")
def corpus_census(spark, sf):
    """Records, tokens, types and hapaxes per language and source, with a row for each whole language (A1-A3)."""
    # Texts are tokenised once: both levels come from the counts by language, source and word.
    docs, c = load(spark, sf, "documents"), _tok(spark, sf).groupBy("lang", "source", "w").agg(F.count("*").alias("c"))
    census = lambda df, *by: df.groupBy(*by).agg(F.sum("c").alias("n_tokens"), F.count("*").alias("n_types"), F.sum((F.col("c") == 1).cast("long")).alias("n_hapax"))
    n = docs.groupBy("lang", "source").agg(F.count("*").alias("n_records"))
    per = census(c, "lang", "source").join(n, ["lang", "source"])
    whole = census(c.groupBy("lang", "w").agg(F.sum("c").alias("c")), "lang").join(n.groupBy("lang").agg(F.sum("n_records").alias("n_records")), "lang").withColumn("source", F.lit("all"))
    return per.unionByName(whole).select("lang", "source", "n_records", "n_tokens", "n_types", "n_hapax")


@query(f"""WITH {TOK}, c AS (SELECT source, w, count(*) AS c FROM tok GROUP BY ALL)
SELECT source, CAST(count(*) FILTER (c = 1) AS BIGINT) AS n_hapax, round(count(*) FILTER (c = 1) / count(*), 6) AS hapax_share FROM c GROUP BY source""")
def hapax_by_source(spark, sf):
    c = tokens.census(_tok(spark, sf), "source")
    return c.select("source", "n_hapax", F.round(F.col("n_hapax") / F.col("n_types"), 6).alias("hapax_share"))


@query(f"""WITH {REC}, k AS (SELECT md5(array_to_string(ws, ' ')) AS key, source FROM rec WHERE len(ws) > 0)
SELECT key, count(*) AS n_records, count(DISTINCT source) AS n_groups FROM k GROUP BY key HAVING count(*) > 1""")
def duplicate_sequences(spark, sf):
    """Word sequences that several records have, and in how many sources (A4)."""
    rec = load(spark, sf, "documents").select("source", text.words(F.col("text")).alias("ws")).where(F.size("ws") > 0)
    return tokens.duplicates(rec, F.md5(F.array_join("ws", " ").cast("binary")), "source")


@query(f"""WITH {TOK}, l AS (SELECT doc_id, max(toxic) AS toxic FROM labels GROUP BY doc_id), t AS (SELECT w, bool_and(coalesce(toxic, 0) = 1) AS solely, count(*) AS n FROM tok LEFT JOIN l USING (doc_id) GROUP BY w)
SELECT w, n AS n_occ FROM t WHERE solely""")
def uncertain_only_types(spark, sf):
    """Words attested only in flagged records (A5)."""
    flag = load(spark, sf, "labels").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    t = _tok(spark, sf).join(flag, "doc_id", "left").groupBy("w").agg(F.bool_and(F.coalesce("toxic", F.lit(0)) == 1).alias("only"), F.count("*").alias("n_occ"))
    return t.where("only").select("w", "n_occ")


@query(f"""WITH {TYPES}, p AS (SELECT w, freq, translate(w, 'áàâäãéèêëíìîïóòôöõúùûüñçß', 'aaaaaeeeeiiiiooooouuuuncs') AS ascii FROM types)
SELECT ascii, CAST(count(*) AS BIGINT) AS n_forms, CAST(sum(freq) AS BIGINT) AS n_occ, string_agg(w, '|' ORDER BY w) AS forms FROM p GROUP BY ascii HAVING count(*) > 1""")
def projection_collisions(spark, sf):
    """ASCII projections that merge several source forms."""
    p = tokens.vocabulary(_tok(spark, sf)).withColumn("ascii", F.translate("w", "áàâäãéèêëíìîïóòôöõúùûüñçß", "aaaaaeeeeiiiiooooouuuuncs"))
    return p.groupBy("ascii").agg(F.count("*").alias("n_forms"), F.sum("freq").alias("n_occ"), F.array_join(F.array_sort(F.collect_list("w")), "|").alias("forms")).where("n_forms > 1")


@query(f"""WITH {TOK} SELECT w, count(*) AS n_occ, count(*) FILTER (i = 0) AS n_initial, count(*) FILTER (i = 1) AS n_second, count(*) FILTER (i = n - 1) AS n_final,
round(count(*) FILTER (i = 0) / count(*), 6) AS initial_share FROM tok WHERE n >= 2 GROUP BY w ORDER BY n_occ DESC, w LIMIT 20""")
def positional_profile(spark, sf):
    """The 20 most frequent words and where they stand in their records."""
    p = tokens.top(tokens.positions(_tok(spark, sf)), 20, F.desc("n_occ"), "w")
    return p.withColumn("initial_share", F.round(F.col("n_initial") / F.col("n_occ"), 6))


@query(f"""WITH {TOK}, t AS (SELECT w FROM tok WHERE n >= 2 GROUP BY w ORDER BY count(*) DESC, w LIMIT 20)
SELECT source, w, count(*) AS n_occ, count(*) FILTER (i = 0) AS n_initial, count(*) FILTER (i = n - 1) AS n_final FROM tok JOIN t USING (w) WHERE n >= 2 GROUP BY ALL""")
def positional_by_stratum(spark, sf):
    """The same words' positions in each source."""
    tok = _tok(spark, sf)
    best = tokens.top(tokens.positions(tok), 20, F.desc("n_occ"), "w").select("w")
    return tokens.positions(tok.join(F.broadcast(best), "w"), "source").drop("n_second")


@query("""WITH s AS (SELECT user_id, CAST(ts AS DATE) AS d, list(event_type ORDER BY ts, event_id)[1:6] AS t FROM events GROUP BY ALL),
c AS (SELECT array_to_string(t, ' ') AS template, count(*) AS n FROM s GROUP BY ALL)
SELECT template, n, round(n / sum(n) OVER (), 6) AS share FROM c""")
def slot_templates(spark, sf):
    """The first six event types of each user's day, and how common each sequence is."""
    e = load(spark, sf, "events").groupBy("user_id", F.to_date("ts").alias("d")).agg(F.array_sort(F.collect_list(F.struct("ts", "event_id", "event_type"))).alias("x"))
    c = e.select(F.array_join(F.slice(F.transform("x", lambda s: s["event_type"]), 1, 6), " ").alias("template")).groupBy("template").agg(F.count("*").alias("n"))
    total = c.agg(F.sum("n").alias("t"))
    return c.crossJoin(F.broadcast(total)).select("template", "n", F.round(F.col("n") / F.col("t"), 6).alias("share"))


@query(f"""WITH {TOK}, b AS (SELECT w AS a, lead(w) OVER (PARTITION BY doc_id ORDER BY i) AS b FROM tok)
SELECT a, b, count(*) AS n FROM b WHERE b IS NOT NULL GROUP BY ALL ORDER BY n DESC, a, b LIMIT 50""")
def bigram_top(spark, sf):
    """The 50 commonest pairs of neighbouring words."""
    rec = load(spark, sf, "documents").select(text.words(F.col("text")).alias("ws"))
    # Neighbours are zipped within the record's array: no sort by position is needed.
    pairs = rec.select(F.explode(F.arrays_zip(F.slice("ws", F.lit(1), F.greatest(F.size("ws") - 1, F.lit(0))).alias("a"), F.slice("ws", F.lit(2), F.size("ws")).alias("b"))).alias("p"))
    return tokens.top(pairs.groupBy(F.col("p.a").alias("a"), F.col("p.b").alias("b")).agg(F.count("*").alias("n")), 50, F.desc("n"), "a", "b")


@query("""WITH e AS (SELECT user_id, event_type AS a, lead(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS b FROM events)
SELECT a, b, count(*) AS n, count(DISTINCT user_id) AS n_users FROM e WHERE b IS NOT NULL AND a <> b GROUP BY ALL""")
def filiation_pairs(spark, sf):
    """Changes from one event type to another, and how many users show each (W4; filiation_patterns counts A33)."""
    p = sequences.adjacent(load(spark, sf, "events"), "user_id", ["ts", "event_id"], "event_type").where("a <> b")
    per = p.groupBy("a", "b", "user_id").agg(F.count("*").alias("c"))
    return per.groupBy("a", "b").agg(F.sum("c").alias("n"), F.count("*").alias("n_users"))


_SUFFIX_SQL = f"""WITH {TYPES}, cut AS (SELECT w, k, right(w, k) AS suffix, left(w, len(w) - k) AS stem FROM types, (SELECT unnest([1, 2, 3]) AS k) WHERE len(w) - k >= 3),
m AS (SELECT c.*, t.w IS NOT NULL AS known FROM cut c LEFT JOIN types t ON c.stem = t.w),
per AS (SELECT k, suffix, count(*) AS n, count(*) FILTER (known) AS support FROM m GROUP BY ALL),
whole AS (SELECT k, sum(n) AS total, sum(support) AS marked FROM per GROUP BY k),
f AS (SELECT suffix, n, support, total::BIGINT AS total, marked::BIGINT AS marked FROM per JOIN whole USING (k) WHERE n >= 20),
x AS (SELECT *, unnest(range(greatest(support, marked + n - total, 0), least(marked, n) + 1)) AS j FROM f),
p AS (SELECT suffix, sum(exp(lgamma(marked + 1) - lgamma(j + 1) - lgamma(marked - j + 1) + lgamma(total - marked + 1) - lgamma(n - j + 1) - lgamma(total - marked - n + j + 1) - lgamma(total + 1) + lgamma(n + 1) + lgamma(total - n + 1))) AS p FROM x GROUP BY suffix)
SELECT f.suffix, n, support, round(n * marked / total, 6) AS expected, round(least(p, 1.0), 6) AS p FROM f JOIN p USING (suffix)"""


@query(_SUFFIX_SQL)
def suffix_screen(spark, sf):
    """Endings whose removal leaves known words more often than chance."""
    types = tokens.vocabulary(_tok(spark, sf))
    return morphology.suffix_screen(types).select("suffix", "n", "support", F.round("expected", 6).alias("expected"), F.round("p", 6).alias("p"))


@query(_SUFFIX_SQL.replace("range(greatest(support, marked + n - total, 0), least(marked, n) + 1)", "range(greatest(marked + n - total, 0), support + 1)"))
def suffix_avoidance(spark, sf):
    """Endings whose removal leaves known words less often than chance: the exact lower tail."""
    types = tokens.vocabulary(_tok(spark, sf))
    return morphology.suffix_screen(types).select("suffix", "n", "support", F.round("expected", 6).alias("expected"), F.round("p_low", 6).alias("p"))


_LONGEST = f"""{TYPES}, e AS (SELECT unnest({list(ENDINGS)}) AS suffix), hit AS (SELECT w, suffix, left(w, len(w) - len(suffix)) AS stem, row_number() OVER (PARTITION BY w ORDER BY len(suffix) DESC) AS r
FROM types JOIN e ON suffix(w, suffix) WHERE len(w) - len(suffix) >= 3), asg AS (SELECT w, suffix, stem FROM hit WHERE r = 1)""".replace("suffix(w, suffix)", "ends_with(w, suffix)")


def _assigned(spark, sf):
    ends = spark.createDataFrame([(e,) for e in ENDINGS], "suffix string")
    return morphology.longest_suffix(tokens.vocabulary(_tok(spark, sf)), ends)


@query(f"""WITH {_LONGEST}, s AS (SELECT stem, list_sort(list(DISTINCT suffix)) AS s FROM asg GROUP BY stem)
SELECT stem, len(s)::INTEGER AS n_suffixes, array_to_string(s, '|') AS suffixes FROM s WHERE len(s) >= 2""")
def paradigms(spark, sf):
    """Stems with several endings."""
    return morphology.paradigms(_assigned(spark, sf))


@query(f"""WITH {_LONGEST}, d AS (SELECT DISTINCT stem, suffix FROM asg), u AS (SELECT count(DISTINCT stem) AS u FROM d), z AS (SELECT suffix, count(*) AS c FROM d GROUP BY suffix),
b AS (SELECT x.suffix AS a, y.suffix AS b, count(*) AS n_both FROM d x JOIN d y ON x.stem = y.stem AND x.suffix < y.suffix GROUP BY ALL),
f AS (SELECT a, b, za.c AS n_a, zb.c AS n_b, n_both, u FROM b JOIN z za ON za.suffix = a JOIN z zb ON zb.suffix = b, u),
x AS (SELECT *, unnest(range(greatest(0, n_a + n_b - u), n_both + 1)) AS j FROM f),
p AS (SELECT a, b, sum(exp(lgamma(n_a + 1) - lgamma(j + 1) - lgamma(n_a - j + 1) + lgamma(u - n_a + 1) - lgamma(n_b - j + 1) - lgamma(u - n_a - n_b + j + 1) - lgamma(u + 1) + lgamma(n_b + 1) + lgamma(u - n_b + 1))) AS p FROM x GROUP BY a, b),
g AS (SELECT f.*, least(p, 1.0) AS p FROM f JOIN p USING (a, b))
SELECT a, b, n_a, n_b, n_both, round(n_a * n_b / u, 6) AS expected, round(p, 6) AS p, round(least(1.0, p * count(*) OVER ()), 6) AS p_bonferroni FROM g""")
def suffix_pair_longest(spark, sf):
    """Pairs of endings that share fewer stems than chance."""
    asg = _assigned(spark, sf)
    pairs = morphology.pair_overlaps(asg).crossJoin(F.broadcast(asg.agg(F.count_distinct("stem").alias("u"))))
    p = stats.stratified_lower(F.array("u"), F.array("n_a"), F.array("n_b"), F.col("n_both"))
    out = stats.bonferroni(pairs.withColumn("p", p), "p")
    return out.select("a", "b", "n_a", "n_b", "n_both", F.round(F.col("n_a") * F.col("n_b") / F.col("u"), 6).alias("expected"), F.round("p", 6).alias("p"), F.round("p_bonferroni", 6).alias("p_bonferroni"))


def _mi_sql(cells: str) -> str:
    return f"""{cells}, r AS (SELECT a, sum(c) AS ra FROM c GROUP BY a), s AS (SELECT b, sum(c) AS rb FROM c GROUP BY b), n AS (SELECT sum(c) AS n FROM c)
SELECT CAST(any_value(n) AS BIGINT) AS n, count(*) AS n_cells, round(sum(c / n * ln(c * n / (ra::DOUBLE * rb))), 6) AS mi FROM c JOIN r USING (a) JOIN s USING (b), n"""


def _mi(cells):
    return association.mutual_information(cells, "a", "b").select("n", "n_cells", F.round("mi", 6).alias("mi"))


@query(_mi_sql("WITH c AS (SELECT p_brand AS a, s_nationkey AS b, count(*) AS c FROM lineitem JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey GROUP BY ALL)"))
def mi_brand_nation(spark, sf):
    """Mutual information of part brand and supplier nation over line items."""
    li = load(spark, sf, "lineitem").select("l_partkey", "l_suppkey")
    # Both keys are dropped to counts before the second join.
    j = li.join(load(spark, sf, "part").select(F.col("p_partkey").alias("l_partkey"), F.col("p_brand").alias("a")), "l_partkey")
    j = j.join(load(spark, sf, "supplier").select(F.col("s_suppkey").alias("l_suppkey"), F.col("s_nationkey").alias("b")), "l_suppkey")
    return _mi(association.contingency(j, "a", "b"))


@query(_mi_sql(f"WITH {TOK}, c AS (SELECT w AS a, source AS b, count(*) AS c FROM tok GROUP BY ALL)"))
def mi_word_source(spark, sf):
    return _mi(association.contingency(_tok(spark, sf).select(F.col("w").alias("a"), F.col("source").alias("b")), "a", "b"))


@query(_mi_sql("WITH c AS (SELECT event_type AS a, hour(ts) AS b, count(*) AS c FROM events GROUP BY ALL)"))
def mi_event_hour(spark, sf):
    return _mi(association.contingency(load(spark, sf, "events").select(F.col("event_type").alias("a"), F.hour("ts").alias("b")), "a", "b"))


_STRIP = "CASE " + " ".join(f"WHEN ends_with(w, '{e}') AND len(w) - {len(e)} >= 3 THEN left(w, len(w) - {len(e)})" for e in text.CASE_ENDINGS) + " ELSE w END"


@query(f"""WITH {TOK}, c AS (SELECT {_STRIP} AS stem, source, count(*) AS c FROM tok GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY stem ORDER BY c DESC, source) AS r, sum(c) OVER (PARTITION BY stem) AS n FROM c)
SELECT stem, CAST(n AS BIGINT) AS n_occ, source AS top, round(c / n, 6) AS share FROM r WHERE r = 1 AND n >= 50""")
def stem_top_region(spark, sf):
    """For frequent stems the source that has most of them."""
    cells = _tok(spark, sf).select(text.strip_case(F.col("w")).alias("stem"), "source").groupBy("stem", "source").agg(F.count("*").alias("c"))
    return association.top_share(cells, "stem", "source").where("n_occ >= 50").withColumn("share", F.round("share", 6))


@query(f"""WITH t AS (SELECT conv_id, turn, role, {WORDS} AS ws FROM conversations), s AS (SELECT role, 'slot1' AS slot, ws[1] AS w FROM t WHERE len(ws) >= 2 UNION ALL SELECT role, 'slot2', ws[2] FROM t WHERE len(ws) >= 2)
SELECT role, slot, count(*) AS n, count(DISTINCT w) AS n_types, round(count(DISTINCT w) / count(*), 6) AS ttr FROM s GROUP BY ALL""")
def slot_ttr_by_genre(spark, sf):
    """Type-token ratio of the first and second word by role (A17; the classes are those of the table)."""
    t = load(spark, sf, "conversations").select("role", text.words(F.col("text")).alias("ws")).where(F.size("ws") >= 2)
    s = t.select("role", F.explode(F.array(F.struct(F.lit("slot1").alias("slot"), F.get("ws", F.lit(0)).alias("w")), F.struct(F.lit("slot2").alias("slot"), F.get("ws", F.lit(1)).alias("w")))).alias("x"))
    out = association.type_token_ratio(s.select("role", "x.slot", "x.w"), "w", "role", "slot")
    return out.withColumn("ttr", F.round("ttr", 6))


@query("""WITH r AS (SELECT o_orderpriority, year(o_orderdate) AS y, avg((o_orderstatus = 'F')::INT) AS rate FROM orders GROUP BY ALL)
SELECT o_orderpriority, count(*) AS n_bins, round(min(rate), 6) AS low, round(max(rate), 6) AS high, round(max(rate) - min(rate), 6) AS spread FROM r GROUP BY ALL""")
def rate_spread_by_period(spark, sf):
    """How far the share of finished orders differs between years, by priority."""
    o = load(spark, sf, "orders").withColumn("y", F.year("o_orderdate"))
    out = association.rate_spread(o, F.col("o_orderstatus") == "F", "y", "o_orderpriority")
    return out.select("o_orderpriority", "n_bins", *[F.round(c, 6).alias(c) for c in ("low", "high", "spread")])


_VOTES = f"{TOK}, v AS (SELECT w, quality AS label, count(*) AS c FROM (SELECT DISTINCT doc_id, w FROM tok) JOIN labels USING (doc_id) GROUP BY ALL)"


def _votes(spark, sf):
    seen = _tok(spark, sf).select("doc_id", "w").distinct()
    return seen.join(load(spark, sf, "labels"), "doc_id").groupBy("w", F.col("quality").alias("label")).agg(F.count("*").alias("c"))


@query(f"""WITH {_VOTES}, r AS (SELECT *, rank() OVER (PARTITION BY w ORDER BY c DESC) AS r FROM v), k AS (SELECT w, min(label) AS label, max(c) AS n_votes, count(*) AS t FROM r WHERE r = 1 GROUP BY w)
SELECT w, label, n_votes FROM k WHERE t = 1""")
def majority_label_ties_rejected(spark, sf):
    """Each word's majority label; ties reject the word."""
    return association.majority(_votes(spark, sf), "w", "label")


@query(f"""WITH {_VOTES}, r AS (SELECT *, row_number() OVER (PARTITION BY w ORDER BY c DESC, label) AS r FROM v) SELECT w, label, c AS n_votes FROM r WHERE r = 1""")
def majority_label_priority(spark, sf):
    """Each word's majority label; ties go to the smaller label."""
    return association.majority(_votes(spark, sf), "w", "label", F.col("label"))


_Z = stats.Z95


@query(f"""WITH {TOK}, d AS (SELECT DISTINCT doc_id, w FROM tok JOIN labels USING (doc_id)), n AS (SELECT count(*) AS n, count(*) FILTER (toxic = 1) AS ny FROM labels WHERE doc_id IN (SELECT doc_id FROM documents)),
x AS (SELECT w, count(*) AS n_x, count(*) FILTER (toxic = 1) AS n_both FROM d JOIN labels USING (doc_id) GROUP BY w HAVING count(*) >= 10)
SELECT w, n_x, n_both, round(n_both / n_x, 6) AS precision, round(ny / n, 6) AS base,
round((n_both / n_x + {_Z}*{_Z} / (2 * n_x) - {_Z} * sqrt(n_both / n_x * (1 - n_both / n_x) / n_x + {_Z}*{_Z} / (4.0 * n_x * n_x))) / (1 + {_Z}*{_Z} / n_x), 6) + 0.0 AS low,
round((n_both / n_x + {_Z}*{_Z} / (2 * n_x) + {_Z} * sqrt(n_both / n_x * (1 - n_both / n_x) / n_x + {_Z}*{_Z} / (4.0 * n_x * n_x))) / (1 + {_Z}*{_Z} / n_x), 6) AS high FROM x, n""")
def gloss_association(spark, sf):
    """Words' association with a flag of their record, with Wilson intervals."""
    lab = load(spark, sf, "labels").join(load(spark, sf, "documents").select("doc_id"), "doc_id", "left_semi")
    n = lab.agg(F.count("*").alias("n"), F.sum((F.col("toxic") == 1).cast("long")).alias("ny"))
    seen = _tok(spark, sf).select("doc_id", "w").distinct().join(lab, "doc_id")
    x = seen.groupBy("w").agg(F.count("*").alias("n_x"), F.sum((F.col("toxic") == 1).cast("long")).alias("n_both")).where("n_x >= 10")
    low, high = stats.wilson(F.col("n_both"), F.col("n_x"))
    x = x.crossJoin(F.broadcast(n))
    return x.select("w", "n_x", "n_both", F.round(F.col("n_both") / F.col("n_x"), 6).alias("precision"), F.round(F.col("ny") / F.col("n"), 6).alias("base"), (F.round(low, 6) + 0.0).alias("low"), F.round(high, 6).alias("high"))


@query(f"""WITH {TYPES}, b AS (SELECT least(len(w), 10) AS length_bucket, least(freq, 5) AS freq_bucket, count(*) AS n_types, CAST(sum(freq) AS BIGINT) AS n_tokens FROM types GROUP BY ALL)
SELECT CAST(length_bucket AS INTEGER) AS length_bucket, CAST(freq_bucket AS BIGINT) AS freq_bucket, n_types, n_tokens FROM b""")
def word_shape_buckets(spark, sf):
    """Types and tokens by length and frequency bucket."""
    t = tokens.vocabulary(_tok(spark, sf))
    return t.groupBy(F.least(F.length("w"), F.lit(10)).alias("length_bucket"), F.least("freq", F.lit(5).cast("long")).alias("freq_bucket")).agg(F.count("*").alias("n_types"), F.sum("freq").alias("n_tokens"))


_SKEL = "regexp_replace(translate(replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(w, '[^a-z]', '', 'g'), 'sh|ts|dj|tj', 'S', 'g'), 'th', 'T', 'g'), 'kh|ch', 'K', 'g'), 'ph', 'P', 'g'), 'ng', 'N'), 'pbfvwtdkgqcxszmnlrjyh', 'PPPWWTTKKKKKSSMNLRJJH'), '[a-z]', '', 'g')"


@query(f"""WITH {TYPES} SELECT {_SKEL} AS skeleton, count(*) AS n_words, CAST(sum(freq) AS BIGINT) AS n_occ, min(w) AS example FROM types GROUP BY 1""")
def skeleton_classes(spark, sf):
    """Words that share a consonant skeleton."""
    t = tokens.vocabulary(_tok(spark, sf))
    return t.groupBy(text.skeleton(F.col("w")).alias("skeleton")).agg(F.count("*").alias("n_words"), F.sum("freq").alias("n_occ"), F.min("w").alias("example"))


def leiden_tokens(spark, sf):
    """Marked-up lines parsed to tokens with kinds and flags (F1-F6), counted by kind and flag.

    The marks come from the events' properties, which hold braces and quotes.
    """
    e = load(spark, sf, "events").select("event_type", F.explode(text.parse(text.nfc(F.col("props")))).alias("t"))
    return e.select("event_type", "t.kind", F.array_join("t.flags", "+").alias("flags")).groupBy("event_type", "kind", "flags").agg(F.count("*").alias("n"))


query()(leiden_tokens)


@query("""WITH n AS (SELECT n_nationkey, n_name, r_name FROM nation JOIN region ON n_regionkey = r_regionkey)
SELECT c_custkey, n_name, r_name, CASE WHEN c_acctbal < 0 THEN 'debit' WHEN c_acctbal < 5000 THEN 'low' ELSE 'high' END AS grade FROM customer LEFT JOIN n ON c_nationkey = n_nationkey""")
def concordance_enrich(spark, sf):
    """Records enriched from a concordance of two tables."""
    n = load(spark, sf, "nation").join(F.broadcast(load(spark, sf, "region")), F.col("n_regionkey") == F.col("r_regionkey"))
    c = load(spark, sf, "customer").join(F.broadcast(n.select("n_nationkey", "n_name", "r_name")), F.col("c_nationkey") == F.col("n_nationkey"), "left")
    return c.select("c_custkey", "n_name", "r_name", F.when(F.col("c_acctbal") < 0, "debit").when(F.col("c_acctbal") < 5000, "low").otherwise("high").alias("grade"))


@query(f"""WITH {TYPES}, e AS (SELECT w, replace(replace(replace(replace(w, 'nn', 'n'), 'tt', 't'), 'ss', 's'), 'ee', 'e') AS fixed FROM types), ok AS (SELECT e.w, e.fixed FROM e JOIN types t ON t.w = e.fixed WHERE e.w <> e.fixed AND t.freq >= 100)
SELECT coalesce(fixed, w) AS w, count(*) AS n_occ, count(fixed) AS n_corrected FROM tok LEFT JOIN ok USING (w) GROUP BY 1""")
def errata_override(spark, sf):
    """Tokens with doubled letters corrected where the single form is well attested."""
    tok = _tok(spark, sf)
    types = tokens.vocabulary(tok)
    fix = types.withColumn("fixed", reduce(lambda c, x: F.replace(c, F.lit(x * 2), F.lit(x)), "ntse", F.col("w"))).where("w <> fixed").select("w", "fixed")
    good = fix.join(types.where("freq >= 100").select(F.col("w").alias("fixed")), "fixed").select("w", "fixed")
    # Types are joined before occurrences are needed: counts by word suffice.
    out = types.join(good, "w", "left")
    return out.groupBy(F.coalesce("fixed", "w").alias("w")).agg(F.sum("freq").alias("n_occ"), F.sum(F.when(F.col("fixed").isNotNull(), F.col("freq")).otherwise(0)).alias("n_corrected"))


@query("""WITH s AS (SELECT user_id, event_id, ts, event_type = 'error' AS mark FROM events), m AS (SELECT *, lag(mark) OVER w AS p FROM s WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
x AS (SELECT *, sum((mark AND NOT coalesce(p, true))::INT) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS section FROM m)
SELECT user_id, CAST(section AS BIGINT) AS section, count(*) AS n_events, min(event_id) AS first_id FROM x GROUP BY ALL""")
def sections(spark, sf):
    """Sections that begin where a run of errors begins."""
    s = sequences.sections(load(spark, sf, "events"), "user_id", ["ts", "event_id"], F.col("event_type") == "error")
    return s.groupBy("user_id", "section").agg(F.count("*").alias("n_events"), F.min("event_id").alias("first_id"))


_SEC = """WITH s AS (SELECT *, event_type = 'error' AS mark FROM events), m AS (SELECT *, lag(mark) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS p FROM s),
x AS (SELECT *, sum((mark AND NOT coalesce(p, true))::INT) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS section FROM m)"""


@query(_SEC + """, c AS (SELECT user_id, event_type, section, count(*) AS c FROM x GROUP BY ALL), a AS (SELECT user_id, event_type, sum(c * (c - 1) / 2) AS same, sum(c) AS n FROM c GROUP BY ALL)
SELECT event_type, CAST(sum(same) AS DOUBLE) AS same_pairs, CAST(sum(n * (n - 1) / 2) AS DOUBLE) AS all_pairs, round(sum(same) / sum(n * (n - 1) / 2), 6) AS coherence FROM a GROUP BY event_type""")
def section_coherence(spark, sf):
    """Share of equal-type pairs that fall in one section, from counts alone."""
    s = sequences.sections(load(spark, sf, "events"), "user_id", ["ts", "event_id"], F.col("event_type") == "error")
    c = s.groupBy("user_id", "event_type", "section").agg(F.count("*").alias("c"))
    a = c.groupBy("user_id", "event_type").agg(F.sum(F.col("c") * (F.col("c") - 1) / 2).alias("same"), F.sum("c").alias("n"))
    out = a.groupBy("event_type").agg(F.sum("same").alias("same_pairs"), F.sum(F.col("n") * (F.col("n") - 1) / 2).alias("all_pairs"))
    return out.withColumn("coherence", F.round(F.col("same_pairs") / F.col("all_pairs"), 6))


@query(f"""WITH {TOK} SELECT w, min(source) AS source, count(*) AS n_occ FROM tok GROUP BY w HAVING count(DISTINCT source) = 1 AND count(*) >= 3""")
def signature_vocab(spark, sf):
    """Words whose occurrences all lie in one source."""
    per = _tok(spark, sf).groupBy("w", "source").agg(F.count("*").alias("c"))
    return per.groupBy("w").agg(F.min("source").alias("source"), F.sum("c").alias("n_occ"), F.count("*").alias("k")).where("k = 1 and n_occ >= 3").drop("k")


@query("""WITH b AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS place FROM events), f AS (SELECT user_id, place // 5 AS block, event_type, min(place) AS first FROM b GROUP BY ALL),
o AS (SELECT x.event_type AS a, y.event_type AS b, count(*) AS n, count(*) FILTER (x.first < y.first) AS n_before FROM f x JOIN f y ON x.user_id = y.user_id AND x.block = y.block AND x.event_type < y.event_type GROUP BY ALL)
SELECT a, b, n, n_before, round(least(1.0, (SELECT sum(exp(lgamma(n + 1) - lgamma(j + 1) - lgamma(n - j + 1) - n * ln(2.0))) FROM (SELECT unnest(range(n_before, n + 1)) AS j))), 6) AS p FROM o""")
def block_first_order(spark, sf):
    """Which of two event types comes first in blocks of five events, with a sign test."""
    b = sequences.blocks(load(spark, sf, "events"), "user_id", ["ts", "event_id"])
    f = b.groupBy("user_id", "block", "event_type").agg(F.min("place").alias("first"))
    # A block has at most five types, so its pairs are made from one short array.
    s = f.groupBy("user_id", "block").agg(F.array_sort(F.collect_list(F.struct("event_type", "first"))).alias("s"))
    pairs = s.select(F.explode(F.flatten(F.transform("s", lambda x, i: F.transform(F.slice("s", i + 2, F.size("s")), lambda y: F.struct(x["event_type"].alias("a"), y["event_type"].alias("b"), (x["first"] < y["first"]).alias("before")))))).alias("p"))
    o = pairs.groupBy("p.a", "p.b").agg(F.count("*").alias("n"), F.sum(F.col("p.before").cast("long")).alias("n_before"))
    return o.withColumn("p", F.round(stats.binomial_upper(F.col("n_before"), F.col("n")), 6))


@query("""SELECT event_id, user_id, last_value(CASE WHEN event_type = 'purchase' THEN value END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS last_purchase FROM events""")
def forward_fill(spark, sf):
    """Each event with its user's latest purchase value."""
    e = sequences.forward_fill(load(spark, sf, "events"), "user_id", ["ts", "event_id"], F.when(F.col("event_type") == "purchase", F.col("value")), "last_purchase")
    return e.select("event_id", "user_id", "last_purchase")


@query("""WITH e AS (SELECT *, epoch_us(ts) / 1e6 AS x, CASE WHEN event_type = 'view' THEN value END AS y FROM events), k AS (SELECT *, CASE WHEN y IS NOT NULL THEN x END AS kx FROM e),
f AS (SELECT event_id, x, last_value(kx IGNORE NULLS) OVER b AS x0, last_value(y IGNORE NULLS) OVER b AS y0, first_value(kx IGNORE NULLS) OVER a AS x1, first_value(y IGNORE NULLS) OVER a AS y1 FROM k
WINDOW b AS (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), a AS (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))
SELECT event_id, round(coalesce(y0 + (y1 - y0) * (x - x0) / nullif(x1 - x0, 0), y0, y1), 4) AS level FROM f""")
def interpolate(spark, sf):
    """View values interpolated over time at every event."""
    e = load(spark, sf, "events").withColumn("x", F.unix_micros(F.col("ts").cast("timestamp")) / 1e6)
    out = sequences.interpolate(e, "user_id", ["ts", "event_id"], F.col("x"), F.when(F.col("event_type") == "view", F.col("value")), "level")
    return out.select("event_id", F.round("level", 4).alias("level"))


@query(f"""WITH {REC}, z AS (SELECT unnest(list_concat(list_zip(ws[1:len(ws) - 1], ws[2:len(ws)]), list_zip(ws[1:len(ws) - 2], ws[3:len(ws)]))) AS p FROM rec WHERE len(ws) > 1),
h AS (SELECT least(p[1], p[2]) AS a, greatest(p[1], p[2]) AS b, count(*) AS c FROM z GROUP BY ALL), k AS (SELECT a, b, CASE WHEN a = b THEN 2 * c ELSE c END AS c FROM h), c AS (SELECT a, b, c FROM k WHERE c >= 20 UNION SELECT b, a, c FROM k WHERE c >= 20),
m AS (SELECT w, sum(k) AS r FROM (SELECT unnest(ws) AS w, unnest(list_transform(range(len(ws)), lambda i: least(i, 2) + least(len(ws) - 1 - i, 2))) AS k FROM rec) GROUP BY w), v AS (SELECT c.*, ln(c * (SELECT sum(r) FROM m)::DOUBLE / x.r / y.r) AS x FROM c JOIN m x ON x.w = a JOIN m y ON y.w = b)
SELECT a, b, c, round(x, 6) AS ppmi FROM v WHERE x > 0""")
def cooc_pmi_window2(spark, sf):
    """Positive association of words at most two places apart, of at least 20 meetings."""
    from ..operators import models

    ws = load(spark, sf, "documents").select(text.words(F.col("text")).alias("ws"))
    return models.ppmi(*sequences.window_cells(ws, "ws", 2, 20)).select("a", "b", "c", F.round("ppmi", 6).alias("ppmi"))


@query(f"""WITH {TOK}, w AS (SELECT doc_id, w, rank() OVER (PARTITION BY doc_id ORDER BY i) AS k, percent_rank() OVER (PARTITION BY doc_id ORDER BY i) AS r FROM tok)
SELECT w, count(*) AS n_occ, round(avg(r), 6) AS mean_place, CAST(sum(least(floor(r * 3), 2)) AS BIGINT) AS sum_tercile FROM w GROUP BY w HAVING count(*) >= 100""")
def relative_position(spark, sf):
    """Mean relative place of frequent words in their record."""
    r = F.when(F.col("n") > 1, F.col("i") / (F.col("n") - 1)).otherwise(0.0)  # i / (n - 1) needs no window
    t = _tok(spark, sf).select("w", r.alias("r"))
    return t.groupBy("w").agg(F.count("*").alias("n_occ"), F.round(F.avg("r"), 6).alias("mean_place"), F.sum(F.least(F.floor(F.col("r") * 3), F.lit(2))).alias("sum_tercile")).where("n_occ >= 100")


@query(f"""WITH {TYPES}, l AS (SELECT lang, count(*) AS n FROM tok GROUP BY lang), k AS (SELECT w FROM tok GROUP BY w HAVING count(DISTINCT lang) = (SELECT count(*) FROM l))
SELECT w, count(*) AS n_occ FROM tok JOIN k USING (w) GROUP BY w""")
def shared_vocabulary(spark, sf):
    """Words that all languages have (A26, set operations)."""
    per = _tok(spark, sf).groupBy("w", "lang").agg(F.count("*").alias("c"))
    n = per.agg(F.count_distinct("lang").alias("k"))
    return per.groupBy("w").agg(F.sum("c").alias("n_occ"), F.count("*").alias("m")).crossJoin(F.broadcast(n)).where("m = k").select("w", "n_occ")


@query("""WITH d AS (SELECT regexp_extract_all(html, '<a href="([^"]*)">', 1) AS a, regexp_extract(html, 'charset="?([a-zA-Z0-9-]+)', 1) AS charset, regexp_extract(html, '<html lang="([a-z]+)"', 1) AS lang, page_id FROM pages)
SELECT page_id, lang, charset, CAST(len(a) AS INTEGER) AS n_links, array_to_string(a, ' ') AS targets FROM d""")
def html_table_extract(spark, sf):
    """Fields and link targets taken from markup by patterns (S18; table_rows reads tables, xml_scan files)."""
    p = load(spark, sf, "pages")
    a = F.regexp_extract_all("html", F.lit('<a href="([^"]*)">'), 1)
    return p.select("page_id", F.regexp_extract("html", '<html lang="([a-z]+)"', 1).alias("lang"), F.regexp_extract("html", 'charset="?([a-zA-Z0-9-]+)', 1).alias("charset"), F.size(a).alias("n_links"), F.array_join(a, " ").alias("targets"))


@query("""SELECT event_id, key, value FROM (SELECT event_id, unnest(json_keys(props)) AS key, props FROM events) q, LATERAL (SELECT json_extract_string(props, '$."' || key || '"') AS value)""")
def template_params(spark, sf):
    """Key-value properties as rows (S6; template_lines reads templates)."""
    m = load(spark, sf, "events").select("event_id", F.explode(F.from_json("props", "map<string,string>")))
    return m


@query("""SELECT sha256(text) AS sha, count(*) AS n_records, min(doc_id) AS first_id FROM documents GROUP BY 1""")
def content_manifest(spark, sf):
    """Digest of every text with its first holder."""
    return load(spark, sf, "documents").groupBy(F.sha2("text", 256).alias("sha")).agg(F.count("*").alias("n_records"), F.min("doc_id").alias("first_id"))


@query("""SELECT doc_id, source FROM documents ORDER BY md5('42:' || doc_id::VARCHAR), doc_id LIMIT 50""")
def review_sample(spark, sf):
    """A reproducible sample of 50 records by hash order."""
    return tokens.top(load(spark, sf, "documents"), 50, F.md5(F.concat(F.lit("42:"), F.col("doc_id").cast("string")).cast("binary")), "doc_id").select("doc_id", "source")
