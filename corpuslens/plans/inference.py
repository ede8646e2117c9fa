"""Null models, classifiers, graphs and matching over the tables."""

from __future__ import annotations

import tempfile

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import stats, text
from ..operators import association, graphs, induction, matching, models, nulls, sequences, tokens
from ..sources.tables import load
from .registry import REC, TOK, TYPES, WORDS, ascii_letters, query

#: Replicates of a null model; the least p is 1 / (R + 1).
R, SEED = 200, 42
_H = "md5(concat_ws(':', '42', rep::VARCHAR, {u}::VARCHAR))"


def _cut(spark):
    """Cuts lineage by reliable checkpoints; a temporary folder is set only where a session on one machine names none."""
    if not (spark.sparkContext.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)):
        if spark.sparkContext.master.split("[")[0] != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="corpuslens-"))
    return lambda df: df.checkpoint()


_PW = f"""WITH e AS (SELECT user_id, event_type, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS place FROM events),
sim AS (SELECT rep, user_id, event_type, row_number() OVER (PARTITION BY rep, user_id ORDER BY md5(concat_ws(':', '42', rep::VARCHAR, user_id::VARCHAR, event_id::VARCHAR)), event_id) - 1 AS place FROM e, (SELECT unnest(range(1, {R + 1})) AS rep)),
o AS (SELECT event_type, count(*) FILTER (place = 0) AS stat FROM e GROUP BY 1), s AS (SELECT rep, event_type, count(*) FILTER (place = 0) AS stat FROM sim GROUP BY ALL)"""


@query(_PW + f""", own AS (SELECT rep, event_type, (count(*) OVER (PARTITION BY event_type ORDER BY stat DESC RANGE UNBOUNDED PRECEDING) + 1) / ({R} + 1) AS p FROM s), m AS (SELECT rep, min(p) AS m FROM own GROUP BY rep),
raw AS (SELECT o.event_type, o.stat, (count(*) FILTER (s.stat >= o.stat) + 1) / ({R} + 1) AS p FROM o LEFT JOIN s USING (event_type) GROUP BY ALL)
SELECT event_type, stat, round(p, 6) AS p, round(((SELECT count(*) FROM m WHERE m.m <= raw.p + 1e-12) + 1) / ({R} + 1), 6) AS p_adj FROM raw""")
def perm_within_record(spark, sf, r=R):
    """Which event types open a user's history more often than order alone explains."""
    e = load(spark, sf, "events").withColumn("place", F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")) - 1).select("user_id", "event_type", "event_id", "place")
    # Only the first of a permuted history counts: the least hash.
    won = nulls.openings(e, r, SEED, "user_id", "event_id", "event_type")
    grid = nulls.repeated(e.select("event_type").distinct(), r)  # a few types
    sim = grid.join(won, ["rep", "event_type"], "left").na.fill(0, ["stat"])
    out = nulls.min_p(e.groupBy("event_type").agg(F.sum((F.col("place") == 0).cast("long")).alias("stat")), sim, "event_type", r)
    return out.select("event_type", "stat", F.round("p", 6).alias("p"), F.round("p_adj", 6).alias("p_adj"))


_PERM = """sh AS (SELECT rep, id, {strata} v, row_number() OVER (PARTITION BY rep{by} ORDER BY id) AS k, row_number() OVER (PARTITION BY rep{by} ORDER BY md5(concat_ws(':', '42', rep::VARCHAR, id::VARCHAR)), id) AS h FROM u, (SELECT unnest(range(1, {reps})) AS rep)),
pm AS (SELECT a.rep, a.id, b.v FROM sh a JOIN sh b ON a.rep = b.rep AND a.k = b.h{on})"""


def _permutation(units, spark, keys, stat, r, strata=()):
    observed = stat(units)
    sim = stat(nulls.permute(units, r, SEED, "v", F.col("id"), strata), "rep")
    return nulls.add_one(observed, sim, keys, r=r)


_LABELS = f"""u0 AS (SELECT doc_id AS id, source, min(toxic) AS v FROM labels JOIN documents USING (doc_id) GROUP BY ALL), lw AS (SELECT doc_id AS id, len({WORDS}) < 100 AS short FROM documents), u AS (SELECT u0.*, short FROM u0 JOIN lw USING (id))"""


def _label_units(spark, sf):
    docs = load(spark, sf, "documents")
    lab = load(spark, sf, "labels").groupBy("doc_id").agg(F.min("toxic").alias("v"))
    return docs.join(lab, "doc_id").select(F.col("doc_id").alias("id"), "source", "v", (F.size(text.words(F.col("text"))) < 100).alias("short"))


@query(f"""WITH {_LABELS}, {_PERM.format(reps=R + 1, strata="", by="", on="")}, o AS (SELECT short, CAST(sum(v) AS BIGINT) AS stat FROM u GROUP BY short), s AS (SELECT rep, short, sum(pm.v) AS stat FROM pm JOIN u USING (id) GROUP BY ALL)
SELECT o.short, o.stat, round((count(*) FILTER (s.stat >= o.stat) + 1) / ({R} + 1), 6) AS p FROM o LEFT JOIN s USING (short) GROUP BY ALL""")
def perm_label(spark, sf, r=R):
    """Are flags commoner in short records than a permutation of flags over records allows."""
    stat = lambda df, *rep: df.groupBy(*rep, "short").agg(F.sum("v").alias("stat"))
    return _permutation(_label_units(spark, sf), spark, ["short"], stat, r).withColumn("p", F.round("p", 6))


@query(f"""WITH {_LABELS}, {_PERM.format(reps=R + 1, strata="source,", by=", source", on=" AND a.source = b.source")}, o AS (SELECT short, CAST(sum(v) AS BIGINT) AS stat FROM u GROUP BY short), s AS (SELECT rep, short, sum(pm.v) AS stat FROM pm JOIN u USING (id) GROUP BY ALL)
SELECT o.short, o.stat, round((count(*) FILTER (s.stat >= o.stat) + 1) / ({R} + 1), 6) AS p FROM o LEFT JOIN s USING (short) GROUP BY ALL""")
def perm_strata(spark, sf, r=R):
    """The same test with flags permuted within sources only."""
    stat = lambda df, *rep: df.groupBy(*rep, "short").agg(F.sum("v").alias("stat"))
    return _permutation(_label_units(spark, sf), spark, ["short"], stat, r, ("source",)).withColumn("p", F.round("p", 6))


@query(f"""WITH u AS (SELECT c_custkey AS id, c_mktsegment AS v FROM customer), {_PERM.format(reps=R + 1, strata="", by="", on="")}, oc AS (SELECT o_custkey AS id, o_orderpriority AS pr, count(*) AS c FROM orders GROUP BY ALL),
o AS (SELECT v, pr, CAST(sum(c) AS BIGINT) AS stat FROM u JOIN oc USING (id) GROUP BY ALL), s AS (SELECT rep, v, pr, sum(c) AS stat FROM pm JOIN oc USING (id) GROUP BY ALL)
SELECT o.v AS segment, o.pr AS priority, o.stat, round((count(*) FILTER (s.stat >= o.stat) + 1) / ({R} + 1), 6) AS p FROM o LEFT JOIN s USING (v, pr) GROUP BY ALL""")
def perm_cluster(spark, sf, r=R):
    """Segments permuted among customers, then expanded to their orders."""
    u = load(spark, sf, "customer").select(F.col("c_custkey").alias("id"), F.col("c_mktsegment").alias("v"))
    oc = load(spark, sf, "orders").groupBy(F.col("o_custkey").alias("id"), F.col("o_orderpriority").alias("pr")).agg(F.count("*").alias("c"))
    # A customer's counts go with it as one array, a row a priority: no join is made in each replicate.
    u = u.join(oc.groupBy("id").agg(F.collect_list(F.struct("pr", "c")).alias("x")), "id", "left")
    stat = lambda df, *rep: df.select(*rep, "v", F.explode("x").alias("x")).groupBy(*rep, "v", F.col("x.pr").alias("pr")).agg(F.sum("x.c").alias("stat"))
    out = _permutation(u, spark, ["v", "pr"], stat, r)
    return out.select(F.col("v").alias("segment"), F.col("pr").alias("priority"), "stat", F.round("p", 6).alias("p"))


@query(f"""WITH z AS (SELECT conv_id AS id, count(*) AS size, list(role ORDER BY turn, role)[1] AS v FROM conversations GROUP BY conv_id), u AS (SELECT * FROM z), {_PERM.format(reps=R + 1, strata="size,", by=", size", on=" AND a.size = b.size")},
o AS (SELECT v, count(*) FILTER (id % 2 = 0) AS stat FROM u GROUP BY v), s AS (SELECT rep, v, count(*) FILTER (id % 2 = 0) AS stat FROM pm GROUP BY ALL)
SELECT o.v AS first_role, o.stat, round((count(*) FILTER (s.stat >= o.stat) + 1) / ({R} + 1), 6) AS p FROM o LEFT JOIN s USING (v) GROUP BY ALL""")
def perm_block(spark, sf, r=R):
    """First roles exchanged among conversations of equal length, against even ids."""
    z = load(spark, sf, "conversations").groupBy(F.col("conv_id").alias("id")).agg(F.count("*").alias("size"), F.min(F.struct("turn", "role")).alias("f"))
    u = z.select("id", "size", F.col("f.role").alias("v"))
    stat = lambda df, *rep: df.groupBy(*rep, "v").agg(F.sum((F.col("id") % 2 == 0).cast("long")).alias("stat"))
    out = _permutation(u, spark, ["v"], stat, r, ("size",))
    return out.select(F.col("v").alias("first_role"), "stat", F.round("p", 6).alias("p"))


@query("""WITH h AS (SELECT user_id, hour(ts) AS h, count(*) FILTER (event_type = 'error') AS x, count(*) FILTER (event_type = 'purchase') AS y FROM events GROUP BY ALL),
a AS (SELECT h, CAST(sum(x) AS BIGINT) AS x, CAST(sum(y) AS BIGINT) AS y FROM h GROUP BY h), n AS (SELECT count(*) AS n FROM a), r AS (SELECT row_number() OVER (ORDER BY h) - 1 AS i, x, y FROM a),
s AS (SELECT k AS shift, CAST(sum(p.x * q.y) AS BIGINT) AS stat FROM r p, n, (SELECT unnest(range(24)) AS k), r q WHERE k < n AND q.i = (p.i + n - k) % n GROUP BY k)
SELECT (SELECT stat FROM s WHERE shift = 0) AS stat, count(*) AS n_shifts, round(count(*) FILTER (stat >= (SELECT stat FROM s WHERE shift = 0)) / count(*), 6) AS p FROM s""")
def cyclic_shift(spark, sf):
    """Do errors and purchases share their hours of day, against all turns of the day, enumerated."""
    a = load(spark, sf, "events").groupBy(F.hour("ts").alias("h")).agg(F.sum((F.col("event_type") == "error").cast("long")).alias("x"), F.sum((F.col("event_type") == "purchase").cast("long")).alias("y"))
    r = a.withColumn("i", F.row_number().over(Window.orderBy("h")) - 1).withColumn("day", F.lit(1))  # one row an hour
    turned = nulls.cyclic_shifts(r.select("day", "i", "y"), "i", "y", "day").withColumnRenamed("y", "yy")
    s = turned.join(r.select("i", "x"), "i").groupBy("shift").agg(F.sum(F.col("x") * F.col("yy")).alias("stat"))
    first = s.where("shift = 0").select(F.col("stat").alias("obs"))
    return s.crossJoin(F.broadcast(first)).groupBy("obs").agg(F.count("*").alias("n_shifts"), F.round(F.sum((F.col("stat") >= F.col("obs")).cast("long")) / F.count("*"), 6).alias("p")).select(F.col("obs").alias("stat"), "n_shifts", "p")


@query(f"""WITH t AS (SELECT conv_id, turn, {WORDS} AS ws FROM conversations), s AS (SELECT conv_id, turn, ws[1] AS a, ws[2] AS b FROM t WHERE len(ws) >= 2),
o AS (SELECT count(DISTINCT a) - count(DISTINCT b) AS stat FROM s), f AS (SELECT rep, CASE WHEN substr(md5(concat_ws(':', '42', rep::VARCHAR, conv_id::VARCHAR, turn::VARCHAR)), 1, 1) < '8' THEN a ELSE b END AS x, CASE WHEN substr(md5(concat_ws(':', '42', rep::VARCHAR, conv_id::VARCHAR, turn::VARCHAR)), 1, 1) < '8' THEN b ELSE a END AS y FROM s, (SELECT unnest(range(1, {R + 1})) AS rep)),
m AS (SELECT rep, count(DISTINCT x) - count(DISTINCT y) AS stat FROM f GROUP BY rep)
SELECT o.stat, round((count(*) FILTER (m.stat >= o.stat) + 1) / ({R} + 1), 6) AS p FROM o, m GROUP BY o.stat""")
def swap_null(spark, sf, r=R):
    """Is the first word of a turn more varied than the second, against swaps within turns."""
    ws = text.words(F.col("text"))
    s = load(spark, sf, "conversations").select("conv_id", "turn", ws.alias("ws")).where(F.size("ws") >= 2).select("conv_id", "turn", F.get("ws", F.lit(0)).alias("a"), F.get("ws", F.lit(1)).alias("b"))
    keep = F.substring(nulls.hashed(SEED, F.col("rep"), F.col("conv_id"), F.col("turn")), 1, 1) < "8"
    f = nulls.repeated(s, r).select("rep", F.when(keep, F.col("a")).otherwise(F.col("b")).alias("x"), F.when(keep, F.col("b")).otherwise(F.col("a")).alias("y"))
    diff = lambda df, x, y, *by: df.groupBy(*by).agg((F.count_distinct(x) - F.count_distinct(y)).alias("stat"))
    m = diff(f, "x", "y", "rep").withColumn("one", F.lit(1))
    return nulls.add_one(diff(s, "a", "b").withColumn("one", F.lit(1)), m, ["one"], r=r).select("stat", F.round("p", 6).alias("p"))


_SETS = ["en", "er", "ing", "ed", "ly"]


@query(f"""WITH {TYPES}, ends AS (SELECT k, right(w, k) AS suffix, count(*) AS c FROM types, (SELECT unnest([2, 3]) AS k) WHERE len(w) > k GROUP BY ALL HAVING count(*) >= 30),
need AS (SELECT len(x) AS k, count(*) AS m FROM (SELECT unnest({_SETS}) AS x) GROUP BY ALL), o AS (SELECT CAST(sum(c) AS BIGINT) AS stat FROM ends WHERE suffix IN (SELECT unnest({_SETS}))),
d AS (SELECT rep, e.k, c, row_number() OVER (PARTITION BY rep, e.k ORDER BY md5(concat_ws(':', '42', rep::VARCHAR, suffix)), suffix) AS r FROM ends e, (SELECT unnest(range(1, {R + 1})) AS rep)),
s AS (SELECT rep, sum(c) AS stat FROM d JOIN need USING (k) WHERE r <= m GROUP BY rep)
SELECT o.stat, round((count(*) FILTER (s.stat >= o.stat) + 1) / ({R} + 1), 6) AS p FROM o, s GROUP BY o.stat""")
def suffix_set_null(spark, sf, r=R):
    """Coverage of a list of endings against random lists of the same lengths."""
    types = tokens.vocabulary(tokens.tokens(load(spark, sf, "documents")))
    ends = types.select(F.explode(text.suffixes(F.col("w"), 3)).alias("suffix")).where(F.length("suffix") >= 2).groupBy("suffix").agg(F.count("*").alias("c")).where("c >= 30").withColumn("cls", F.length("suffix"))
    need = spark.createDataFrame([(k, sum(len(x) == k for x in _SETS)) for k in (2, 3)], "cls int, k int")
    picked = nulls.draws(ends.select("suffix", "cls"), need, r, SEED, "suffix", "cls")
    sim = picked.join(ends, "suffix").groupBy("rep").agg(F.sum("c").alias("stat")).withColumn("one", F.lit(1))
    obs = ends.where(F.col("suffix").isin(_SETS)).agg(F.sum("c").alias("stat")).withColumn("one", F.lit(1))
    return nulls.add_one(obs, sim, ["one"], r=r).select("stat", F.round("p", 6).alias("p"))


@query(f"""WITH c AS (SELECT c_nationkey AS g, count(*) AS n, sum(c_acctbal) AS s FROM customer GROUP BY g), k AS (SELECT *, row_number() OVER (ORDER BY g) - 1 AS k FROM c), n AS (SELECT count(*) AS m FROM k),
d AS (SELECT rep, CAST(floor(CAST(concat('0x', substr(md5(concat_ws(':', '42', rep::VARCHAR, slot.k::VARCHAR)), 1, 12)) AS BIGINT)::DOUBLE / 281474976710656.0 * m) AS BIGINT) AS k FROM k slot, n, (SELECT unnest(range(1, {R + 1})) AS rep)),
m AS (SELECT rep, sum(s) / sum(n) AS mean FROM d JOIN k USING (k) GROUP BY rep)
SELECT round((SELECT sum(s) / sum(n) FROM c), 4) AS mean, round(quantile_cont(mean, 0.025), 4) AS low, round(quantile_cont(mean, 0.975), 4) AS high FROM m""")
def bootstrap_cluster(spark, sf, r=R):
    """Mean balance with an interval from resampled nations."""
    c = load(spark, sf, "customer").groupBy("c_nationkey").agg(F.count("*").alias("n"), F.sum("c_acctbal").alias("s"))
    m = nulls.bootstrap(c, r, SEED, "c_nationkey").join(c, "c_nationkey").groupBy("rep").agg((F.sum(F.col("s") * F.col("times")) / F.sum(F.col("n") * F.col("times"))).alias("mean"))
    whole = c.agg((F.sum("s") / F.sum("n")).alias("mean"))
    ci = m.agg(F.percentile("mean", 0.025).alias("low"), F.percentile("mean", 0.975).alias("high"))
    return whole.crossJoin(ci).select(*[F.round(x, 4).alias(x) for x in ("mean", "low", "high")])


@query("""WITH p AS (SELECT o_orderpriority AS a, o_orderstatus AS b, count(*) AS k FROM orders GROUP BY ALL), n AS (SELECT a, sum(k) AS n FROM p GROUP BY a), t AS (SELECT a, b, k, n::BIGINT AS n, abs(k / n - 1 / 3.0) AS d FROM p JOIN n USING (a)),
q AS (SELECT *, exp(-2 * n * d * d) AS p FROM t), r AS (SELECT *, row_number() OVER (ORDER BY p, a, b) AS r, count(*) OVER () AS m FROM q)
SELECT a, b, k, round(p, 6) AS p, round(least(1.0, min(p * m / r) OVER (ORDER BY r ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)), 6) AS p_bh, round(least(1.0, p * m), 6) AS p_bonferroni FROM r""")
def bh_adjust(spark, sf):
    """Benjamini-Hochberg and Bonferroni over a table of tests."""
    p = load(spark, sf, "orders").groupBy(F.col("o_orderpriority").alias("a"), F.col("o_orderstatus").alias("b")).agg(F.count("*").alias("k"))
    t = p.join(p.groupBy("a").agg(F.sum("k").alias("n")), "a").withColumn("d", F.abs(F.col("k") / F.col("n") - 1 / 3.0))
    t = t.withColumn("p", F.exp(-2 * F.col("n") * F.col("d") * F.col("d")))
    out = stats.bonferroni(stats.benjamini_hochberg(t, "p", ties=("a", "b")), "p")
    return out.select("a", "b", "k", *[F.round(x, 6).alias(x) for x in ("p", "p_bh", "p_bonferroni")])


# ---- models ----------------------------------------------------------------------

_SPLIT = """ranked AS (SELECT *, row_number() OVER (PARTITION BY y ORDER BY md5(concat_ws(':', '42', id::VARCHAR)), id) <= floor(count(*) OVER (PARTITION BY y) * 0.2) AS held_out FROM u)"""


def _quality_units(spark, sf):
    lab = load(spark, sf, "labels").groupBy("doc_id").agg(F.min("quality").alias("y"))
    docs = load(spark, sf, "documents").join(lab, "doc_id").select(F.col("doc_id").alias("id"), "y", text.words(F.col("text")).alias("ws"))
    return models.split(docs, F.col("id"), "y", SEED)


_NBQ = f"""WITH {REC}, u AS (SELECT doc_id AS id, min(quality) AS y, any_value(ws) AS ws FROM labels JOIN rec USING (doc_id) GROUP BY doc_id), {_SPLIT},
f AS (SELECT DISTINCT id, unnest(ws) AS feature FROM ranked), tr AS (SELECT id, y FROM ranked WHERE NOT held_out), n AS (SELECT y, count(*) AS n FROM tr GROUP BY y),
h AS (SELECT y, feature, count(*) AS n1 FROM f JOIN tr USING (id) GROUP BY ALL), g AS (SELECT n.y, v.feature, n, coalesce(n1, 0) AS n1 FROM (SELECT DISTINCT feature FROM h) v CROSS JOIN n LEFT JOIN h ON h.y = n.y AND h.feature = v.feature),
w AS (SELECT y, feature, ln((n1 + 1) / (n + 2)) AS l1, ln((n - n1 + 1) / (n + 2)) AS l0 FROM g), pr AS (SELECT n.y, ln(n + 1) + sum(l0) AS b FROM n JOIN w USING (y) GROUP BY n.y, n),
te AS (SELECT id, y AS truth FROM ranked WHERE held_out), d AS (SELECT te.id, w.y, sum(l1 - l0) AS d FROM te JOIN f USING (id) JOIN w USING (feature) GROUP BY ALL),
sc AS (SELECT te.id, truth, pr.y, b + coalesce(d, 0) AS score FROM te CROSS JOIN pr LEFT JOIN d ON d.id = te.id AND d.y = pr.y),
de AS (SELECT id, truth, y AS predicted FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY score DESC, y) AS r FROM sc) WHERE r = 1)"""


def _nb_quality(spark, sf):
    units = _quality_units(spark, sf)
    feats = units.select("id", F.explode(F.array_distinct("ws")).alias("feature"))
    train, test = units.where("not held_out").select("id", "y"), units.where("held_out").select("id", "y")
    prior, weights = models.bernoulli_fit(train, feats, "id", "y")
    scores = models.bernoulli_scores(test, feats, prior, weights, "id", "y")
    return test.withColumnRenamed("y", "truth"), scores


@query(_NBQ + """SELECT truth, predicted, count(*) AS c FROM de GROUP BY ALL""")
def nb_bernoulli_quality(spark, sf):
    """Confusion of a Bernoulli naive Bayes on held-out records."""
    test, scores = _nb_quality(spark, sf)
    return models.confusion(test.join(models.decide(scores, "id", "y"), "id"), "truth", "predicted")


@query(_NBQ + """, p AS (SELECT id, truth, max(score) AS a, min(score) AS b FROM sc GROUP BY ALL), c AS (SELECT 1 / (1 + exp(greatest(b - a, -700))) AS conf, predicted = de.truth AS ok FROM p JOIN de USING (id)),
k AS (SELECT CASE WHEN conf < 0.5 THEN 0 WHEN conf < 0.7 THEN 1 WHEN conf < 0.9 THEN 2 ELSE 3 END AS bin, conf, ok FROM c)
SELECT bin, count(*) AS n, round(avg(conf), 6) AS mean_confidence, round(avg(ok::INT), 6) AS accuracy, round(CASE WHEN count(*) >= 5 THEN avg(ok::INT) ELSE avg(conf) END, 6) AS calibrated FROM k GROUP BY bin""")
def nb_calibration_bins(spark, sf):
    """Accuracy by bin of confidence (M6)."""
    test, scores = _nb_quality(spark, sf)
    d = models.decide(scores, "id", "y").join(test, "id").withColumn("conf", 1 / (1 + F.exp(F.greatest(-F.col("margin"), F.lit(-700.0)))))
    out = models.calibration(d, "conf", F.col("predicted") == F.col("truth"))
    return out.select("bin", "n", *[F.round(x, 6).alias(x) for x in ("mean_confidence", "accuracy", "calibrated")])


_LANG = f"""{TYPES}, wl AS (SELECT w, lang, count(*) AS c FROM tok GROUP BY ALL), rk AS (SELECT w, lang AS y, row_number() OVER (PARTITION BY w ORDER BY c DESC, lang) AS r FROM wl), u AS (SELECT w AS id, y FROM rk WHERE r = 1), {_SPLIT},
sx AS (SELECT id, y, held_out, k, right(id, k) AS suffix FROM ranked, (SELECT unnest([1, 2, 3, 4]) AS k) WHERE len(id) > k), cs AS (SELECT k, suffix, y, count(*) AS c FROM sx WHERE NOT held_out GROUP BY ALL),
lab AS (SELECT DISTINCT y FROM ranked), vk AS (SELECT k, count(DISTINCT suffix) AS v FROM cs GROUP BY k), nk AS (SELECT k, y, sum(c) AS n FROM cs GROUP BY ALL), known AS (SELECT DISTINCT k, suffix FROM cs)"""


def _lang_words(spark, sf):
    wl = tokens.tokens(load(spark, sf, "documents"), "lang").groupBy("w", "lang").agg(F.count("*").alias("c"))
    u = association.majority(wl, "w", "lang", F.col("lang")).select(F.col("w").alias("id"), F.col("lang").alias("y"))
    return models.split(u, F.col("id"), "y", SEED)


def _suffix_rows(units):
    return units.select("id", "y", "held_out", F.explode(text.suffixes(F.col("id"), 4)).alias("suffix")).withColumn("k", F.length("suffix"))


@query(f"""WITH {_LANG}, sc AS (SELECT sx.id, sx.y AS truth, lab.y, sum(ln((coalesce(cs.c, 0) + 0.5) / (nk.n + 0.5 * vk.v))) AS score FROM sx JOIN known USING (k, suffix) CROSS JOIN lab JOIN vk ON vk.k = sx.k JOIN nk ON nk.k = sx.k AND nk.y = lab.y
LEFT JOIN cs ON cs.k = sx.k AND cs.suffix = sx.suffix AND cs.y = lab.y WHERE sx.held_out GROUP BY ALL), de AS (SELECT id, truth, y AS predicted FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY round(score, 9) DESC, y) AS r FROM sc) WHERE r = 1)
SELECT truth, predicted, count(*) AS c FROM de GROUP BY ALL""")
def nb_suffix_lang(spark, sf):
    """Language of held-out words from their endings; words without a known ending abstain."""
    rows = _suffix_rows(_lang_words(spark, sf))
    count = rows.where("not held_out").groupBy("k", "suffix", "y").agg(F.count("*").alias("c"))
    per = count.groupBy("k", "y").agg(F.sum("c").alias("n")).join(count.groupBy("k").agg(F.count_distinct("suffix").alias("v")), "k")
    known = count.select("k", "suffix").distinct()
    grid = known.join(F.broadcast(per), "k").join(count, ["k", "suffix", "y"], "left")
    weights = grid.select("k", "suffix", F.col("y").alias("label"), F.ln((F.coalesce("c", F.lit(0)) + 0.5) / (F.col("n") + 0.5 * F.col("v"))).alias("lw"))
    sc = rows.where("held_out").join(weights, ["k", "suffix"]).groupBy("id", F.col("y").alias("truth"), "label").agg(F.round(F.sum("lw"), 9).alias("score"))
    best = models.decide(sc.select("id", "label", "score"), "id", "label")
    return models.confusion(sc.select("id", "truth").distinct().join(best, "id"), "truth", "predicted")


@query(f"""WITH {_LANG}, b AS (SELECT sx.id, sx.y AS truth, sx.k, cs.y, cs.c FROM sx JOIN cs USING (k, suffix) WHERE sx.held_out AND sx.k >= 2),
de AS (SELECT id, truth, y AS predicted FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY k DESC, c DESC, y) AS r FROM b) WHERE r = 1), n AS (SELECT count(*) AS n FROM ranked WHERE held_out)
SELECT any_value(n) AS n, count(*) AS covered, count(*) FILTER (truth = predicted) AS hits, round(count(*) / any_value(n), 6) AS coverage, round(count(*) FILTER (truth = predicted) / count(*), 6) AS accuracy FROM de, n""")
def longest_suffix_lang(spark, sf):
    """The same from the longest known ending alone, with coverage."""
    units = _lang_words(spark, sf)
    rows = _suffix_rows(units)
    count = rows.where("not held_out and k >= 2").groupBy("k", "suffix", F.col("y").alias("label")).agg(F.count("*").alias("c"))
    first = Window.partitionBy("k", "suffix").orderBy(F.desc("c"), "label")
    best = count.withColumn("r", F.row_number().over(first)).where("r = 1").select("k", "suffix", F.col("label").alias("predicted"))
    hit = rows.where("held_out").join(best, ["k", "suffix"]).withColumn("r", F.row_number().over(Window.partitionBy("id").orderBy(F.desc("k")))).where("r = 1")
    n = units.where("held_out").agg(F.count("*").alias("n"))
    out = hit.agg(F.count("*").alias("covered"), F.sum((F.col("y") == F.col("predicted")).cast("long")).alias("hits")).crossJoin(n)
    return out.select("n", "covered", "hits", F.round(F.col("covered") / F.col("n"), 6).alias("coverage"), F.round(F.col("hits") / F.col("covered"), 6).alias("accuracy"))


@query(f"""WITH {TOK}, bag AS (SELECT doc_id, lang, source, w, count(*) AS c FROM tok GROUP BY ALL), tr AS (SELECT lang, w, sum(c) AS c FROM bag WHERE source <> 'src0' GROUP BY ALL), t AS (SELECT lang, sum(c) AS t FROM tr GROUP BY lang), v AS (SELECT count(DISTINCT w) AS v FROM tr),
lw AS (SELECT t.lang, x.w, ln((coalesce(tr.c, 0) + 1) / (t.t + v.v)) AS lw FROM (SELECT DISTINCT w FROM tr) x CROSS JOIN t CROSS JOIN v LEFT JOIN tr ON tr.lang = t.lang AND tr.w = x.w),
sc AS (SELECT b.doc_id, b.lang AS truth, lw.lang AS y, round(sum(b.c * lw), 6) AS score FROM bag b JOIN lw USING (w) WHERE b.source = 'src0' GROUP BY ALL),
de AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, y) AS r FROM sc), m AS (SELECT truth, y AS predicted, count(*) AS c FROM de WHERE r = 1 GROUP BY ALL),
l AS (SELECT truth AS label, sum(c) AS n, coalesce(sum(c) FILTER (truth = predicted), 0) AS hits FROM m GROUP BY truth), g AS (SELECT predicted AS label, sum(c) AS guessed FROM m GROUP BY predicted)
SELECT label, CAST(n AS BIGINT) AS n, CAST(hits AS BIGINT) AS hits, round(coalesce(hits / nullif(guessed, 0), 0), 6) AS precision, round(hits / n, 6) AS recall, round(coalesce(2 * hits / nullif(coalesce(guessed, 0) + n, 0), 0), 6) AS f1 FROM l LEFT JOIN g USING (label)""")
def nb_multinomial_bag_lang(spark, sf):
    """Language of one source's records by a multinomial model of the others."""
    bag = tokens.tokens(load(spark, sf, "documents"), "lang", "source").groupBy("doc_id", "lang", "source", F.col("w").alias("feature")).agg(F.count("*").alias("c"))
    lw = models.multinomial_weights(bag.where("source <> 'src0'"), "lang").withColumnRenamed("lang", "y")
    sc = bag.where("source = 'src0'").join(lw, "feature").groupBy("doc_id", F.col("lang").alias("truth"), "y").agg(F.round(F.sum(F.col("c") * F.col("lw")), 6).alias("score"))
    best = models.decide(sc.select("doc_id", "y", "score"), "doc_id", "y")
    cells = models.confusion(sc.select("doc_id", "truth").distinct().join(best, "doc_id"), "truth", "predicted")
    return models.class_scores(cells, "truth", "predicted").select("label", "n", "hits", *[F.round(x, 6).alias(x) for x in ("precision", "recall", "f1")])


_VEC = """v0 AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings), v AS (SELECT vec_id, label, list_transform(e, lambda x: x / sqrt(list_inner_product(e, e))) AS e FROM v0)"""


@query(f"""WITH {_VEC}, x AS (SELECT label, vec_id, unnest(e) AS x, unnest(range(len(e))) AS j FROM v), m AS (SELECT label, j, avg(x) AS x FROM x GROUP BY ALL), c AS (SELECT label, list(x ORDER BY j) AS u FROM m GROUP BY label),
s AS (SELECT vec_id, v.label AS truth, c.label AS y, round(list_inner_product(e, u) / sqrt(list_inner_product(u, u)), 9) AS score FROM v, c), d AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY score DESC, y) AS r FROM s)
SELECT truth, y AS predicted, count(*) AS c FROM d WHERE r = 1 GROUP BY ALL""")
def centroid_cosine(spark, sf):
    """Nearest class centre by cosine."""
    v = models.unit_vectors(load(spark, sf, "embeddings"), "vec_id", "embedding", "label")
    sc = models.cosine_to(v, models.centroids(v, "label").withColumnRenamed("label", "y"), "vec_id", "y").withColumn("score", F.round("score", 9))
    return models.confusion(v.select("vec_id", F.col("label").alias("truth")).join(models.decide(sc, "vec_id", "y"), "vec_id"), "truth", "predicted")


_KNN = f"""{_VEC}, s AS (SELECT a.vec_id AS src, b.vec_id AS dst, list_inner_product(a.e, b.e) AS w FROM v a JOIN v b ON a.vec_id <> b.vec_id), k AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY src ORDER BY round(w, 12) DESC, dst) AS r FROM s WHERE w > 0) WHERE r <= 10)"""


@query(f"""WITH {_KNN} SELECT src, dst, round(w, 6) AS w FROM k""")
def knn_graph(spark, sf):
    """Each vector's ten nearest."""
    v = models.unit_vectors(load(spark, sf, "embeddings"), "vec_id", "embedding")
    return graphs.knn(v, "vec_id", 10).select("src", "dst", F.round("w", 6).alias("w"))


@query()
def label_propagation(spark, sf):
    """Labels of one vector in five spread over the graph; accuracy on the rest."""
    cut = _cut(spark)
    e = load(spark, sf, "embeddings")
    v = models.unit_vectors(e, "vec_id", "embedding")
    edges = graphs.symmetric(cut(graphs.knn(v, "vec_id", 10)))
    seeds = e.where(models.fold_of(F.col("vec_id"), SEED) == 0).select(F.col("vec_id").alias("id"), F.col("label").cast("int").alias("y"))
    f = graphs.propagate(edges, seeds, "y", cut=cut)
    best = models.decide(f.select("id", "y", F.round("f", 9).alias("score")), "id", "y")
    rest = e.select(F.col("vec_id").alias("id"), F.col("label").alias("truth")).join(seeds, "id", "left_anti")
    return models.confusion(rest.join(best, "id"), "truth", "predicted")


# ---- matching --------------------------------------------------------------------

_MP = """WITH s0 AS (SELECT user_id, CAST(ts AS DATE) AS d, list(event_type ORDER BY ts, event_id) AS ws FROM events GROUP BY ALL), s AS (SELECT user_id, ws FROM s0 WHERE len(ws) BETWEEN 3 AND 8),
t AS (SELECT user_id, ws, unnest(ws) AS w, unnest(range(1, len(ws) + 1)) AS i FROM s), c AS (SELECT DISTINCT len(ws) || '/' || i || '/' || array_to_string(ws[1:i-1], ' ') || '|' || array_to_string(ws[i+1:], ' ') AS ctx, w, user_id FROM t),
p AS (SELECT ctx, w, min(user_id) AS lo, max(user_id) AS hi FROM c GROUP BY ALL)"""


@query(_MP + """SELECT x.w AS a, y.w AS b, count(*) AS n_contexts FROM p x JOIN p y ON x.ctx = y.ctx AND x.w < y.w AND NOT (x.lo = y.lo AND x.hi = y.hi AND x.lo = x.hi) GROUP BY ALL""")
def minimal_pairs(spark, sf):
    """Event types that replace each other in otherwise equal days of different users."""
    e = load(spark, sf, "events")
    d = e.groupBy("user_id", F.to_date("ts").alias("d")).agg(F.array_sort(F.collect_list(F.struct("ts", "event_id", "event_type"))).alias("x"))
    s = d.select("user_id", F.transform("x", lambda z: z["event_type"]).alias("ws")).where(F.size("ws").between(3, 8))
    return matching.minimal_pairs(s, "ws", "user_id", parts=e.rdd.getNumPartitions())


@query("""WITH l AS (SELECT item_id AS a, unnest(list_distinct(string_split(lower(text), ' '))) AS w FROM benchmark), n AS (SELECT a, count(*) AS n FROM l GROUP BY a),
j AS (SELECT x.a AS a, y.a AS b, count(*) AS c FROM l x JOIN l y ON x.w = y.w AND x.a < y.a GROUP BY ALL)
SELECT j.a, j.b, round(c / (p.n + q.n - c), 6) AS jaccard FROM j JOIN n p ON p.a = j.a JOIN n q ON q.a = j.b WHERE c / (p.n + q.n - c) >= 0.08""")
def jaccard_pairs(spark, sf):
    """Benchmark items whose word sets agree in part."""
    sets = load(spark, sf, "benchmark").select("item_id", F.explode(F.array_distinct(F.split(F.lower("text"), " "))).alias("w"))
    return matching.jaccard_pairs(sets, "item_id", "w", 0.08).withColumn("jaccard", F.round("jaccard", 6))


@query(f"""WITH RECURSIVE {REC}, l AS (SELECT DISTINCT doc_id, unnest(ws) AS w FROM rec), n AS (SELECT doc_id, count(*) AS n FROM l GROUP BY 1),
j AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM l x JOIN l y ON x.w = y.w AND x.doc_id < y.doc_id GROUP BY ALL), e AS (SELECT j.a, j.b FROM j JOIN n p ON p.doc_id = j.a JOIN n q ON q.doc_id = j.b WHERE c / (p.n + q.n - c) >= 0.5),
e2 AS (SELECT a, b FROM e UNION SELECT b, a FROM e), r(id, root) AS (SELECT a, a FROM e2 UNION SELECT e2.b, r.root FROM r JOIN e2 ON e2.a = r.id)
SELECT id, min(root) AS comp FROM r GROUP BY id""")
def jaccard_families(spark, sf):
    """Families of records linked by word-set similarity of a half; equal word sets meet once."""
    ws = F.array_sort(F.array_distinct(text.words(F.col("text"))))
    rec = load(spark, sf, "documents").select("doc_id", ws.alias("ws")).where(F.size("ws") > 0).withColumn("k", F.sha2(F.array_join("ws", " "), 256))
    cut = _cut(spark)
    first = rec.groupBy("k").agg(F.min("doc_id").alias("a"))
    copies = rec.select("doc_id", "k").join(first, "k").where("doc_id <> a").select("a", F.col("doc_id").alias("b"))
    sets = cut(rec.join(first.select(F.col("a").alias("doc_id"), "k"), ["doc_id", "k"], "left_semi").select("doc_id", F.explode("ws").alias("w")))
    return graphs.components(matching.jaccard_pairs(sets, "doc_id", "w", 0.5).select("a", "b").unionByName(copies), cut)


@query(f"""WITH {TYPES}, p AS (SELECT DISTINCT unnest({WORDS.replace("text", "p_name")}) AS probe FROM part), f AS (SELECT w AS form FROM types),
d AS (SELECT probe, form, 1 - levenshtein({ascii_letters("probe")}, {ascii_letters("form")}) / greatest(len(probe), len(form)) AS sim FROM p, f WHERE len(probe) >= 3 AND len(form) BETWEEN 0.7 * len(probe) - 1e-9 AND len(probe) / 0.7 + 1e-9)
SELECT probe, form, round(sim, 6) AS sim FROM d WHERE sim >= 0.7 - 1e-12""")
def fuzzy_probe(spark, sf):
    """Words close to words of part names."""
    types = tokens.vocabulary(tokens.tokens(load(spark, sf, "documents")))
    probes = load(spark, sf, "part").select(F.explode(text.words(F.col("p_name"))).alias("probe")).where(F.length("probe") >= 3).distinct()
    return matching.fuzzy(probes, types.select(F.col("w").alias("form")), "probe", "form", 0.7).withColumn("sim", F.round("sim", 6))


@query(f"""WITH b AS (SELECT item_id, unnest({WORDS}) AS w FROM benchmark), x AS (SELECT w, count(*) AS n_left FROM b GROUP BY w), {TYPES}
SELECT coalesce(x.w, t.w) AS w, coalesce(n_left, 0) AS n_left, coalesce(freq, 0) AS n_right, CASE WHEN x.w IS NULL THEN 'right_only' WHEN t.w IS NULL THEN 'left_only' ELSE 'both' END AS status FROM x FULL JOIN types t ON x.w = t.w""".replace("WITH b AS", "WITH b AS"))
def witness_reconcile(spark, sf):
    """Words of two witnesses: both, left only, right only."""
    a = load(spark, sf, "benchmark").select(F.lit(1).alias("k"), F.explode(text.words(F.col("text"))).alias("w"))
    b = tokens.tokens(load(spark, sf, "documents")).select(F.lit(1).alias("k"), "w")
    return matching.reconcile(a, b, "k", "w").drop("k")


@query(f"""WITH {REC}, i AS (SELECT item_id, {WORDS} AS ws FROM benchmark), b AS (SELECT item_id, array_to_string(ws, ' ') AS t FROM i WHERE len(ws) >= 1), d AS (SELECT doc_id, ' ' || array_to_string(ws, ' ') || ' ' AS t FROM rec)
SELECT b.item_id, d.doc_id FROM b JOIN d ON contains(d.t, ' ' || b.t || ' ')""")
def containment_join(spark, sf):
    """Records that hold a known text word for word (J17): joined on its rarest five-word run, then verified."""
    return matching.contained(load(spark, sf, "documents"), load(spark, sf, "benchmark"))


@query("""SELECT e.id, c.canon FROM (SELECT doc_id AS id, source, md5(regexp_replace(lower(text), '[^a-z]+', '', 'g')) AS k FROM documents) e JOIN (SELECT source, md5(regexp_replace(lower(text), '[^a-z]+', '', 'g')) AS k, min(doc_id) AS canon FROM documents GROUP BY ALL) c USING (source, k) WHERE e.id <> c.canon""")
def variant_merge(spark, sf):
    """Later readings of a record of the same source that agree in all letters, with the first."""
    d = load(spark, sf, "documents").select(F.col("doc_id").alias("id"), "source", F.md5(F.regexp_replace(F.lower("text"), "[^a-z]+", "").cast("binary")).alias("k"))
    canon = d.groupBy("source", "k").agg(F.min("id").alias("canon"), F.count("*").alias("n")).where("n > 1")
    return d.join(canon, ["source", "k"]).where("id <> canon").select("id", "canon")


_TRI = f"""WITH {TYPES}, u AS (SELECT w AS id, 'x' AS y FROM types), {_SPLIT}, g AS (SELECT id, held_out, unnest(list_transform(range(1, len(id) + 2), lambda i: ('^^' || id || '$')[i:i+1])) AS ctx, unnest(list_transform(range(1, len(id) + 2), lambda i: ('^^' || id || '$')[i+2])) AS ch FROM ranked),
c3 AS (SELECT ctx, ch, count(*) AS c FROM g WHERE NOT held_out GROUP BY ALL), c2 AS (SELECT ctx, sum(c) AS n FROM c3 GROUP BY ctx), v AS (SELECT count(DISTINCT ch) AS v FROM c3),
b AS (SELECT id, -log2((coalesce(c3.c, 0) + 0.5) / (coalesce(c2.n, 0) + 0.5 * v)) AS bits FROM g CROSS JOIN v LEFT JOIN c3 ON c3.ctx = g.ctx AND c3.ch = g.ch LEFT JOIN c2 ON c2.ctx = g.ctx WHERE held_out)"""


@query(_TRI + """SELECT count(DISTINCT id) AS n_words, count(*) AS n_symbols, round(sum(bits) / count(DISTINCT id), 6) AS bits_per_word FROM b""")
def char_trigram_bits(spark, sf):
    """Bits a held-out word costs under a character trigram model."""
    types = tokens.vocabulary(tokens.tokens(load(spark, sf, "documents"))).select(F.col("w").alias("id"), F.lit("x").alias("y"))
    s = models.split(types, F.col("id"), "y", SEED).withColumn("s", F.concat(F.lit("^^"), F.col("id"), F.lit("$")))
    g = s.select("id", "held_out", F.explode(F.transform(F.sequence(F.lit(1), F.length("id") + 1), lambda i: F.struct(F.substr("s", i, F.lit(2)).alias("ctx"), F.substr("s", i + 2, F.lit(1)).alias("ch")))).alias("x")).select("id", "held_out", "x.ctx", "x.ch")
    c3 = g.where("not held_out").groupBy("ctx", "ch").agg(F.count("*").alias("c"))
    c2, v = c3.groupBy("ctx").agg(F.sum("c").alias("n")), c3.agg(F.count_distinct("ch").alias("v"))
    b = g.where("held_out").join(c3, ["ctx", "ch"], "left").join(c2, "ctx", "left").crossJoin(F.broadcast(v))
    b = b.select("id", (-F.log2((F.coalesce("c", F.lit(0)) + 0.5) / (F.coalesce("n", F.lit(0)) + 0.5 * F.col("v")))).alias("bits"))
    per = b.groupBy("id").agg(F.sum("bits").alias("bits"), F.count("*").alias("m"))
    return per.agg(F.count("*").alias("n_words"), F.sum("m").alias("n_symbols"), F.round(F.sum("bits") / F.count("*"), 6).alias("bits_per_word"))


_NEXT = """WITH e AS (SELECT user_id, event_id, event_type AS w, lag(event_type) OVER o AS p1, lag(event_type, 2) OVER o AS p2 FROM events WINDOW o AS (PARTITION BY user_id ORDER BY ts, event_id)),
h AS (SELECT *, substr(md5(concat_ws(':', '42', user_id::VARCHAR)), 1, 1) < '4' AS held FROM e), c2 AS (SELECT p1, p2, w, count(*) AS c FROM h WHERE NOT held AND p2 IS NOT NULL GROUP BY ALL), c1 AS (SELECT p1, w, count(*) AS c FROM h WHERE NOT held AND p1 IS NOT NULL GROUP BY ALL), c0 AS (SELECT w, count(*) AS c FROM h WHERE NOT held GROUP BY ALL),
q AS (SELECT user_id, event_id, w, p1, p2 FROM h WHERE held), k AS (SELECT event_id, q.w AS truth, c2.w, 0 AS tier, c FROM q JOIN c2 USING (p1, p2) UNION ALL SELECT event_id, q.w, c1.w, 1, c FROM q JOIN c1 USING (p1) UNION ALL SELECT event_id, q.w, c0.w, 2, c FROM q, c0),
f AS (SELECT *, row_number() OVER (PARTITION BY event_id, w ORDER BY tier) AS d FROM k), r AS (SELECT *, row_number() OVER (PARTITION BY event_id ORDER BY tier, c DESC, w) AS r FROM f WHERE d = 1)"""


@query(_NEXT + """SELECT count(DISTINCT event_id) AS n, count(*) FILTER (r = 1 AND w = truth) AS top1, count(*) FILTER (r <= 3 AND w = truth) AS top3 FROM r""")
def restoration_top5(spark, sf):
    """A held-out user's event guessed from two, one or no events before it."""
    o = Window.partitionBy("user_id").orderBy("ts", "event_id")
    e = load(spark, sf, "events").select("user_id", "event_id", F.col("event_type").alias("w"), F.lag("event_type").over(o).alias("p1"), F.lag("event_type", 2).over(o).alias("p2"))
    h = e.withColumn("held", F.substring(nulls.hashed(SEED, F.col("user_id")), 1, 1) < "4")
    train, q = h.where("not held"), h.where("held").select("event_id", F.col("w").alias("truth"), "p1", "p2")
    count = lambda df, *by: df.groupBy(*by, "w").agg(F.count("*").alias("c"))
    tier = lambda df, i: df.select("event_id", "truth", "w", F.lit(i).alias("tier"), "c")
    # The context tables are types squared at most: a few rows.
    k = tier(q.join(F.broadcast(count(train.where("p2 is not null"), "p1", "p2")), ["p1", "p2"]), 0)
    k = k.unionByName(tier(q.join(F.broadcast(count(train.where("p1 is not null"), "p1")), "p1"), 1)).unionByName(tier(q.crossJoin(F.broadcast(count(train))), 2))
    f = k.withColumn("d", F.row_number().over(Window.partitionBy("event_id", "w").orderBy("tier"))).where("d = 1")
    r = f.withColumn("r", F.row_number().over(Window.partitionBy("event_id").orderBy("tier", F.desc("c"), "w")))
    hit = lambda k: F.sum(((F.col("r") <= k) & (F.col("w") == F.col("truth"))).cast("long"))
    return r.agg(F.count_distinct("event_id").alias("n"), hit(1).alias("top1"), hit(3).alias("top3"))


@query()
def nw_align(spark, sf):
    """Lines of neighbouring benchmark items aligned by soft word overlap."""
    b = load(spark, sf, "benchmark").select("item_id", F.transform(F.split("text", r"[.\n]+"), lambda s: text.words(s)).alias("a"))
    n = b.select((F.col("item_id") - 1).alias("item_id"), F.col("a").alias("b"))
    return matching.align(b.join(n, "item_id").select(F.col("item_id").cast("string").alias("pair"), "a", "b"), keep=0.05)


@query()
def ratcliff_names(spark, sf):
    """Ratcliff-Obershelp ratio of each part name and its type, and the share of the shorter that is matched."""
    p = load(spark, sf, "part").select("p_partkey", F.lower("p_name").alias("a"), F.lower("p_type").alias("b"))
    return p.select("p_partkey", F.round(text.ratcliff("a", "b"), 6).alias("ratio"), F.round(text.ratcliff_contained("a", "b"), 6).alias("contained"))


@query(f"""WITH {TYPES}, c AS (SELECT w, unnest(string_split(w, '')) AS ch, unnest(range(len(w))) AS i FROM types), o AS (SELECT count(*) AS stat FROM types WHERE right(w, 1) IN ('a', 'e', 'i', 'o', 'u')),
l AS (SELECT rep, w, ch, row_number() OVER (PARTITION BY rep, w ORDER BY md5(concat_ws(':', '42', rep::VARCHAR, w, i::VARCHAR)), i) AS k FROM c, (SELECT unnest(range(1, 6)) AS rep)),
s AS (SELECT rep, count(*) FILTER (ch IN ('a', 'e', 'i', 'o', 'u')) AS stat FROM l WHERE k = 1 GROUP BY rep)
SELECT o.stat, round((count(*) FILTER (s.stat >= o.stat) + 1) / 6, 6) AS p FROM o, s GROUP BY o.stat""")
def letter_scramble(spark, sf, r=5):
    """Do words end in a vowel more often than their letters in random order."""
    types = tokens.vocabulary(tokens.tokens(load(spark, sf, "documents"))).select("w")
    # The first letter under a hash order is the letter of least hash: no sort of letters is needed.
    letters = F.filter(F.split("w", ""), lambda c: c != "")
    # A small vocabulary is dealt over all tasks first: each word is hashed r times a letter.
    dealt = types.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "w")
    one = dealt.withColumn("rep", F.explode(F.sequence(F.lit(1), F.lit(r)))).withColumn("cs", letters)
    pick = F.array_min(F.transform("cs", lambda c, i: F.concat(F.md5(F.concat_ws(":", F.lit("42"), F.col("rep").cast("string"), F.col("w"), i.cast("string")).cast("binary")), c)))
    vowel = lambda c: c.isin("a", "e", "i", "o", "u").cast("long")
    sim = one.groupBy("rep").agg(F.sum(vowel(F.substr(pick, F.lit(33)))).alias("stat")).withColumn("one", F.lit(1))
    obs = types.agg(F.sum(vowel(F.right("w", F.lit(1)))).alias("stat")).withColumn("one", F.lit(1))
    return nulls.add_one(obs, sim, ["one"], r=r).select("stat", F.round("p", 6).alias("p"))


@query(_PW + f""", m AS (SELECT rep, max(stat) AS m FROM s GROUP BY rep) SELECT o.event_type, o.stat, round((count(*) FILTER (m.m >= o.stat) + 1) / ({R} + 1), 6) AS p_fwer FROM o, m GROUP BY ALL""")
def max_stat_fwer(spark, sf, r=R):
    """Family-wise p of each event type's opening count against the largest of each replicate."""
    e = load(spark, sf, "events").withColumn("place", F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")) - 1).select("user_id", "event_type", "event_id", "place")
    stat = F.sum((F.col("place") == 0).cast("long")).alias("stat")
    top = nulls.openings(e, r, SEED, "user_id", "event_id", "event_type").groupBy("rep").agg(F.max("stat").alias("m"))
    obs = e.groupBy("event_type").agg(stat)
    both = obs.crossJoin(F.broadcast(top))  # one row a replicate
    return both.groupBy("event_type", "stat").agg(F.round((F.sum((F.col("m") >= F.col("stat")).cast("long")) + 1) / (r + 1), 6).alias("p_fwer"))


@query()
def markov_null(spark, sf):
    """Opening counts of event types in synthetic histories from a bigram model."""
    e = load(spark, sf, "events")
    pairs = sequences.adjacent(e, "user_id", ["ts", "event_id"], "event_type").groupBy("a", "b").agg(F.count("*").alias("c")).toPandas()  # types squared at most
    histories = e.groupBy(F.col("user_id").alias("seq")).agg(F.count("*").alias("n"))
    syn = induction.markov_sequences(histories, pairs, R, SEED)
    return syn.groupBy("rep", F.col("w").alias("event_type")).agg(F.count("*").alias("n"), F.sum((F.col("i") == 0).cast("long")).alias("n_initial"))


@query()
def mdl_suffixes(spark, sf):
    """The first eight endings chosen by description length, and those refused on the way (M15); tested against a plain version."""
    out = induction.mdl_suffixes(tokens.vocabulary(tokens.tokens(load(spark, sf, "documents"))), _cut(spark), most=8)
    return out.withColumns({c: F.round(c, 3) for c in ("approx_bits", "gain_bits", "total_bits")})


@query("""WITH e AS (SELECT user_id, event_type = 'purchase' AS y, percent_rank() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS r FROM events), b AS (SELECT user_id, y, CAST(floor(r * 50) AS BIGINT) AS b FROM e),
c AS (SELECT user_id, y, b, count(*) AS c FROM b GROUP BY ALL), t AS (SELECT y, b, sum(c) AS t FROM c GROUP BY ALL), q AS (SELECT DISTINCT user_id, b AS x FROM c),
d AS (SELECT q.user_id, q.x, t.y, sum((t.t - coalesce(c.c, 0)) * exp(-0.5 * ((q.x - t.b) / 7.5) * ((q.x - t.b) / 7.5))) AS d FROM q CROSS JOIN t LEFT JOIN c ON c.user_id = q.user_id AND c.y = t.y AND c.b = t.b GROUP BY ALL),
s AS (SELECT user_id, x, round(max(d) FILTER (y) / max(d) FILTER (NOT y), 9) AS s FROM d GROUP BY ALL), p AS (SELECT s.s, sum(c.c) FILTER (c.y) AS pos, sum(c.c) FILTER (NOT c.y) AS neg FROM c JOIN s ON s.user_id = c.user_id AND s.x = c.b GROUP BY s.s),
g AS (SELECT s, coalesce(pos, 0) AS pos, coalesce(neg, 0) AS neg, coalesce(sum(coalesce(neg, 0)) OVER (ORDER BY s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below FROM p)
SELECT CAST(sum(pos) AS BIGINT) AS n_pos, CAST(sum(neg) AS BIGINT) AS n_neg, round(sum(pos * (below + neg / 2)) / (sum(pos) * sum(neg)), 6) AS auc FROM g""")
def loso_kde_auc(spark, sf):
    """Purchases ranked by a kernel density of their place that leaves the user's own history out."""
    r = F.percent_rank().over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    b = load(spark, sf, "events").select("user_id", (F.col("event_type") == "purchase").alias("y"), r.alias("r")).select("user_id", "y", F.floor(F.col("r") * 50).cast("int").alias("b"))
    c = b.where("y is not null").groupBy("user_id", "y", "b").agg(F.count("*").alias("c"))
    t = c.groupBy("y", "b").agg(F.sum("c").alias("c"))  # at most 102 rows
    # A user's counts are one row, at most 102 of them, and need no join with the totals.
    cells = F.collect_list(F.struct(F.col("y").cast("int").alias("y"), "b", "c"))
    own = c.where("user_id is not null").groupBy("user_id").agg(cells.alias("own")).drop("user_id").crossJoin(F.broadcast(t.agg(cells.alias("all"))))
    d = own.mapInArrow(models.left_out(50, 7.5), "pos long, neg long, d1 double, d0 double")
    p = d.withColumn("s", F.round(F.col("d1") / F.col("d0"), 9)).groupBy("s").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))
    # Negatives below a score: within a bucket of scores, and in the buckets before.
    p = p.where("s is not null").withColumn("b", F.floor(F.log2(F.greatest("s", F.lit(1e-300))) * 64))
    before = lambda by: F.coalesce(F.sum("neg").over(by.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sums = p.groupBy("b").agg(F.sum("neg").alias("neg")).select("b", before(Window.orderBy("b")).alias("base"))
    g = p.join(sums, "b").select("pos", "neg", (F.col("base") + before(Window.partitionBy("b").orderBy("s"))).alias("below"))
    return g.agg(F.sum("pos").alias("n_pos"), F.sum("neg").alias("n_neg"), F.round(F.sum(F.col("pos") * (F.col("below") + F.col("neg") / 2)) / (F.sum("pos") * F.sum("neg")), 6).alias("auc"))


@query(f"""WITH {TYPES}, v AS (SELECT rep, count(*) FILTER (substr(w, 1 + CAST(floor(CAST('0x' || substr(md5(concat_ws(':', '42', rep::VARCHAR, w)), 1, 12) AS BIGINT) / 281474976710656.0 * len(w)) AS INTEGER), 1) IN ('a', 'e', 'i', 'o', 'u')) AS stat
FROM types, (SELECT unnest(range(1, {R + 1})) AS rep) GROUP BY rep), o AS (SELECT count(*) FILTER (right(w, 1) IN ('a', 'e', 'i', 'o', 'u')) AS stat FROM types)
SELECT o.stat, round((count(*) FILTER (v.stat >= o.stat) + 1) / ({R} + 1), 6) AS p FROM o, v GROUP BY o.stat""")
def letter_scramble_r200(spark, sf, r=R):
    """The same test with R replicates: the last letter of a random order is any letter alike, so one draw a word and replicate serves."""
    types = tokens.vocabulary(tokens.tokens(load(spark, sf, "documents"))).select("w")
    dealt = types.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "w")
    at = F.floor(nulls.uniform(SEED, F.col("rep"), F.col("w")) * F.length("w")).cast("int") + 1
    vowel = lambda c: c.isin("a", "e", "i", "o", "u").cast("long")
    sim = nulls.repeated(dealt, r).groupBy("rep").agg(F.sum(vowel(F.substr("w", at, F.lit(1)))).alias("stat")).withColumn("one", F.lit(1))
    obs = types.agg(F.sum(vowel(F.right("w", F.lit(1)))).alias("stat")).withColumn("one", F.lit(1))
    return nulls.add_one(obs, sim, ["one"], r=r).select("stat", F.round("p", 6).alias("p"))
