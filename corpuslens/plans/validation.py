"""Cross-validated classifiers, ablation, batched label propagation and exclusive assignment over the tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text
from ..operators import association, graphs, matching, models, tokens, validation
from ..sources.tables import load
from .inference import SEED, _cut
from .registry import TYPES, query

FOLDS, ENDS = 5, (1, 2, 3, 4)


def _units(block: str) -> str:
    """Words of three letters or more with the language that has most of their tokens, and a fold by `block`."""
    return f"""{TYPES}, wl AS (SELECT w, lang, count(*) AS c FROM tok WHERE len(w) >= 3 GROUP BY ALL), u AS (SELECT w AS unit, lang AS label, CAST('0x' || substr(md5('42:' || {block}), 1, 8) AS BIGINT) % {FOLDS} AS fold
FROM (SELECT *, row_number() OVER (PARTITION BY w ORDER BY c DESC, lang) AS r FROM wl) WHERE r = 1)"""


def _cv(block: str, name: str = "") -> str:
    """CTEs u, sc: scores by ending lengths under the other folds' models, with sum over lengths in s."""
    return f"""{_units(block)}, ft AS (SELECT unit, label, fold, k, right(unit, k) AS x FROM u, (SELECT unnest([1, 2, 3, 4]) AS k) WHERE len(unit) > k), fo AS (SELECT unnest(range({FOLDS})) AS fold),
n AS (SELECT u.label, fo.fold, count(*) FILTER (u.fold <> fo.fold) AS n FROM u, fo GROUP BY ALL), h AS (SELECT k, x, label, fo.fold, count(*) FILTER (ft.fold <> fo.fold) AS n1 FROM ft, fo GROUP BY ALL),
g AS (SELECT v.k, v.x, n.label, n.fold, n.n, coalesce(n1, 0) AS n1 FROM (SELECT DISTINCT k, x FROM ft) v CROSS JOIN n LEFT JOIN h ON h.k = v.k AND h.x = v.x AND h.label = n.label AND h.fold = n.fold),
wt AS (SELECT k, x, label, fold, ln((n - n1 + 1) / (n + 2)) AS l0, ln((n1 + 1) / (n - n1 + 1)) AS d FROM g), b AS (SELECT label, fold, k, sum(l0) AS b FROM wt GROUP BY ALL),
d AS (SELECT ft.unit, wt.label, ft.k, sum(d) AS d FROM ft JOIN wt ON wt.k = ft.k AND wt.x = ft.x AND wt.fold = ft.fold GROUP BY ALL),
pt AS (SELECT u.unit, u.label AS truth, u.fold, b.label, b.k, b.b + coalesce(d.d, 0) AS part, ln(n.n + 1) AS prior FROM u JOIN b ON b.fold = u.fold JOIN n ON n.label = b.label AND n.fold = b.fold LEFT JOIN d ON d.unit = u.unit AND d.label = b.label AND d.k = b.k)"""


_DECIDE = """sc AS (SELECT unit, truth, fold, label, round(max(prior) + sum(part), 9) AS s FROM pt GROUP BY ALL),
de AS (SELECT unit, truth, fold, label, s, row_number() OVER (PARTITION BY unit ORDER BY s DESC, label) AS r, 1 / sum(exp(greatest(s - m, -700))) OVER (PARTITION BY unit) AS conf FROM (SELECT *, max(s) OVER (PARTITION BY unit) AS m FROM sc))"""


def _words(spark, sf, block):
    wl = tokens.tokens(load(spark, sf, "documents"), "lang").where(F.length("w") >= 3).groupBy("w", "lang").agg(F.count("*").alias("c"))
    u = association.majority(wl, "w", "lang", F.col("lang")).select(F.col("w").alias("unit"), F.col("lang").alias("label"))
    return validation.folded(u, block, SEED, FOLDS)


def _scores(spark, sf, block):
    units = _cut(spark)(_words(spark, sf, block))
    ends = units.select("unit", F.explode(text.suffixes(F.col("unit"), 4)).alias("feature")).withColumn("grp", F.length("feature"))
    return validation.group_scores(units, ends, FOLDS, list(ENDS))


def _all():
    return F.aggregate("parts", F.col("prior"), lambda s, x: s + x)


@query(f"""WITH {_cv("unit")}, {_DECIDE} SELECT CAST(fold AS INTEGER) AS fold, count(*) AS n, count(*) FILTER (label = truth) AS hits, round(count(*) FILTER (label = truth) / count(*), 6) AS accuracy FROM de WHERE r = 1 GROUP BY fold""")
def cv_folds(spark, sf):
    """Five-fold accuracy of a word's language from its endings; each fold's model is the total less the fold (M1, M7)."""
    d = validation.chosen(_scores(spark, sf, F.col("unit")), _all(), "unit", "truth", "fold")
    return _accuracy(d)


def _accuracy(d):
    hit = F.sum((F.col("label") == F.col("truth")).cast("long"))
    return d.groupBy("fold").agg(F.count("*").alias("n"), hit.alias("hits"), F.round(hit / F.count("*"), 6).alias("accuracy"))


@query(f"""WITH {_cv("left(w, 4)")}, {_DECIDE} SELECT CAST(fold AS INTEGER) AS fold, count(*) AS n, count(*) FILTER (label = truth) AS hits, round(count(*) FILTER (label = truth) / count(*), 6) AS accuracy FROM de WHERE r = 1 GROUP BY fold""")
def cv_family_folds(spark, sf):
    """The same with families, words that begin with the same four letters, held out whole (M7)."""
    return _accuracy(validation.chosen(_scores(spark, sf, F.left("unit", F.lit(4))), _all(), "unit", "truth", "fold"))


@query(f"""WITH {_cv("unit")}, {_DECIDE}, k AS (SELECT CASE WHEN conf < 0.5 THEN 0 WHEN conf < 0.7 THEN 1 WHEN conf < 0.9 THEN 2 ELSE 3 END AS bin, conf, (label = truth)::INT AS ok FROM de WHERE r = 1)
SELECT bin, count(*) AS n, round(avg(conf), 6) AS mean_confidence, round(avg(ok), 6) AS accuracy, round(CASE WHEN count(*) >= 5 THEN avg(ok) ELSE avg(conf) END, 6) AS calibrated FROM k GROUP BY bin""")
def cv_calibration(spark, sf):
    """Accuracy by bin of confidence over all five held-out folds; bins of fewer than five keep their confidence (M6)."""
    d = validation.chosen(_scores(spark, sf, F.col("unit")), _all(), "unit", "truth", "fold")
    out = models.calibration(d, "conf", F.col("label") == F.col("truth"))
    return out.select("bin", "n", *[F.round(x, 6).alias(x) for x in ("mean_confidence", "accuracy", "calibrated")])


#: All sets of ending lengths but the empty one.
SUBSETS = tuple(tuple(k for i, k in enumerate(ENDS) if mask >> i & 1) for mask in range(1, 1 << len(ENDS)))
_SETS = ", ".join("'" + "".join(map(str, x)) + "'" for x in SUBSETS)


@query(f"""WITH {_cv("unit")}, sb AS (SELECT unnest([{_SETS}]) AS subset), sc AS (SELECT subset, unit, truth, label, round(max(prior) + sum(part), 9) AS s FROM pt JOIN sb ON contains(subset, k::VARCHAR) GROUP BY ALL),
de AS (SELECT *, row_number() OVER (PARTITION BY subset, unit ORDER BY s DESC, label) AS r FROM sc)
SELECT subset, count(*) AS n, count(*) FILTER (label = truth) AS hits FROM de WHERE r = 1 GROUP BY subset""")
def ablation_subsets(spark, sf):
    """Held-out hits with every set of feature groups, here lengths of endings, from one scoring pass (M8)."""
    scores = _scores(spark, sf, F.col("unit"))
    best = lambda x: F.max(F.struct(F.round(F.col("prior") + sum(F.get("parts", F.lit(ENDS.index(k))) for k in x), 9).alias("s"), F.col("label").alias("l")))
    # Ties go to the smaller label: labels are counted down from the last of few.
    names = [r["label"] for r in scores.select("label").distinct().orderBy("label").collect()]
    rank = F.create_map(*[x for i, name in enumerate(names) for x in (F.lit(name), F.lit(-i))])
    scores = scores.withColumn("label", rank[F.col("label")]).withColumn("truth", rank[F.col("truth")])
    per = scores.groupBy("unit", "truth").agg(*[best(x).alias("x" + "".join(map(str, x))) for x in SUBSETS])
    sums = per.agg(F.count("*").alias("n"), *[F.sum((F.col("x" + "".join(map(str, x)) + ".l") == F.col("truth")).cast("long")).alias("x" + "".join(map(str, x))) for x in SUBSETS])
    rows = F.array(*[F.struct(F.lit("".join(map(str, x))).alias("subset"), F.col("x" + "".join(map(str, x))).alias("hits")) for x in SUBSETS])
    return sums.select("n", F.explode(rows).alias("r")).select("r.subset", "n", "r.hits")


@query()
def label_propagation_folds(spark, sf):
    """Labels of four folds in five spread over the graph, all folds in one state, and the fifth's confusion (G3); tested against dense matrices."""
    cut = _cut(spark)
    e = load(spark, sf, "embeddings").where("label is not null")
    v = models.unit_vectors(e, "vec_id", "embedding")
    edges = graphs.symmetric(cut(graphs.knn(v, "vec_id", 10)))
    labels = validation.folded(e.select(F.col("vec_id").alias("id"), F.col("label").cast("int").alias("label")).distinct(), F.col("id"), SEED, FOLDS)
    names = [r["label"] for r in labels.select("label").distinct().orderBy("label").collect()]  # a few
    f = graphs.propagate_folds(edges, labels, names, FOLDS, cut=cut)
    own = F.transform(F.slice("f", F.col("fold") * len(names) + 1, F.lit(len(names))), lambda x: F.round(x, 9))
    best = labels.join(f, "id").withColumn("own", own).where("array_max(own) > 0")
    guess = F.get(F.array(*[F.lit(x) for x in names]), (F.array_position("own", F.array_max("own")) - 1).cast("int"))
    return best.select("fold", F.col("label").alias("truth"), guess.alias("predicted")).groupBy("fold", "truth", "predicted").agg(F.count("*").alias("c"))


@query("""WITH RECURSIVE t AS (SELECT user_id, datediff('day', DATE '1970-01-01', CAST(ts AS DATE)) AS d, list_distinct(list(event_type)) AS ws FROM events WHERE user_id IS NOT NULL GROUP BY ALL), o AS (SELECT * FROM t WHERE d % 2 = 0), n AS (SELECT * FROM t WHERE d % 2 = 1),
s AS (SELECT o.user_id, o.d AS a, n.d AS b, len(list_intersect(o.ws, n.ws)) / len(list_distinct(list_concat(o.ws, n.ws))) AS j FROM o JOIN n ON o.user_id = n.user_id AND abs(o.d - n.d) <= 3),
e AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY j DESC, a, b) AS k FROM s WHERE j >= 0.25),
g(u, k, x, y, a, b, j) AS (SELECT DISTINCT user_id, CAST(0 AS BIGINT), CAST([] AS BIGINT[]), CAST([] AS BIGINT[]), CAST(NULL AS BIGINT), CAST(NULL AS BIGINT), CAST(NULL AS DOUBLE) FROM e
UNION ALL SELECT u, e.k, CASE WHEN list_contains(x, e.a) OR list_contains(y, e.b) THEN x ELSE list_append(x, e.a) END, CASE WHEN list_contains(x, e.a) OR list_contains(y, e.b) THEN y ELSE list_append(y, e.b) END,
CASE WHEN list_contains(x, e.a) OR list_contains(y, e.b) THEN NULL ELSE e.a END, e.b, e.j FROM g JOIN e ON e.user_id = g.u AND e.k = g.k + 1)
SELECT u AS user_id, a, b, round(j, 6) AS j FROM g WHERE a IS NOT NULL""")
def exclusive_days(spark, sf):
    """A user's even and odd days assigned to each other once, the most similar sets of event types first (G6, J19): J of 0.25 or more within three days."""
    day = F.datediff(F.to_date("ts"), F.lit("1970-01-01").cast("date")).cast("long")
    t = load(spark, sf, "events").where("user_id is not null").groupBy("user_id", day.alias("d")).agg(F.collect_set("event_type").alias("ws"))  # a few types
    a = t.where("d % 2 = 0").select("user_id", F.col("d").alias("a"), F.col("ws").alias("x"))
    # Of the interval's places a row meets the free rows by equality.
    a = a.withColumn("b", F.explode(F.sequence(F.col("a") - 3, F.col("a") + 3, F.lit(2).cast("long"))))
    b = t.where("d % 2 = 1").select("user_id", F.col("d").alias("b"), F.col("ws").alias("y"))
    j = F.size(F.array_intersect("x", "y")) / F.size(F.array_union("x", "y"))
    s = a.join(b, ["user_id", "b"]).select(F.struct("user_id", "a").alias("l"), F.struct("user_id", "b").alias("r"), j.alias("j")).where("j >= 0.25")
    out = matching.exclusive(s, "l", "r", "j", _cut(spark))
    return out.select("l.user_id", "l.a", "r.b", F.round("j", 6).alias("j"))
