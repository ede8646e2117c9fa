"""Joins, set operations, ordered tests and placebo bands over the tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import text
from ..operators import matching, nulls, tokens
from ..sources.tables import load
from .registry import REC, TOK, TYPES, WORDS, query


@query("""SELECT 'lineitem_orders' AS check_name, count(*) AS n FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders) UNION ALL
SELECT 'orders_customer', count(*) FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer) UNION ALL
SELECT 'labels_documents', count(*) FROM labels WHERE doc_id NOT IN (SELECT doc_id FROM documents) UNION ALL
SELECT 'documents_unique', count(*) - count(DISTINCT doc_id) FROM documents""")
def integrity_checks(spark, sf):
    """Rows that lack their control row, and ids that repeat (J2, inline assertions)."""
    def lost(name, a, ak, b, bk):
        left = load(spark, sf, a).select(F.col(ak).alias("k"))
        return left.join(load(spark, sf, b).select(F.col(bk).alias("k")), "k", "left_anti").agg(F.count("*").alias("n")).select(F.lit(name).alias("check_name"), "n")

    out = lost("lineitem_orders", "lineitem", "l_orderkey", "orders", "o_orderkey").unionByName(lost("orders_customer", "orders", "o_custkey", "customer", "c_custkey"))
    out = out.unionByName(lost("labels_documents", "labels", "doc_id", "documents", "doc_id"))
    ids = load(spark, sf, "documents").groupBy("doc_id").agg(F.count("*").alias("c")).agg(F.coalesce(F.sum(F.col("c") - 1), F.lit(0)).alias("n"))
    return out.unionByName(ids.select(F.lit("documents_unique").alias("check_name"), "n"))


@query("""WITH d AS (SELECT DISTINCT user_id, CAST(ts AS DATE) AS d, event_type FROM events)
SELECT x.event_type AS a, y.event_type AS b, count(*) AS n FROM d x JOIN d y ON x.user_id = y.user_id AND x.d = y.d AND x.event_type < y.event_type GROUP BY ALL""")
def cooccurrence_pairs(spark, sf):
    """Unordered pairs of event types within a user's day (J10): pairs are made inside the day's set."""
    s = load(spark, sf, "events").groupBy("user_id", F.to_date("ts").alias("d")).agg(F.array_sort(F.collect_set("event_type")).alias("s"))
    pairs = s.select(F.explode(F.flatten(F.transform("s", lambda x, i: F.transform(F.slice("s", i + 2, F.size("s")), lambda y: F.struct(x.alias("a"), y.alias("b")))))).alias("p"))
    return pairs.groupBy("p.a", "p.b").agg(F.count("*").alias("n"))


@query(f"""WITH t AS (SELECT conv_id, turn, role, {WORDS} AS ws FROM conversations), x AS (SELECT conv_id, turn, role, unnest(ws) AS w FROM t)
SELECT b.role AS near_role, x.w, count(*) AS n FROM x JOIN t b ON b.conv_id = x.conv_id AND b.turn BETWEEN x.turn - 2 AND x.turn + 2 AND b.turn <> x.turn GROUP BY ALL HAVING count(*) >= 20""")
def neighbour_context(spark, sf):
    """Roles of the turns at most two away from a word's turn (J13): a range frame, not a join."""
    w = Window.partitionBy("conv_id").orderBy("turn").rangeBetween(-2, 2)
    t = load(spark, sf, "conversations").select("conv_id", "turn", text.words(F.col("text")).alias("ws"), F.collect_list(F.struct("turn", "role")).over(w).alias("near"))
    t = t.withColumn("near", F.filter("near", lambda s: s["turn"] != F.col("turn")))
    x = t.select(F.explode("ws").alias("w"), "near").select("w", F.explode("near").alias("s"))
    return x.groupBy(F.col("s.role").alias("near_role"), "w").agg(F.count("*").alias("n")).where("n >= 20")


@query(f"""WITH b AS (SELECT DISTINCT unnest({WORDS}) AS form FROM benchmark), {TYPES}
SELECT form, count(*) AS n_cognates, min(w) AS first FROM b JOIN types ON left(form, 4) = left(w, 4) AND form <> w WHERE len(form) >= 4 AND len(w) >= 4 GROUP BY form""")
def cognate_prefixes(spark, sf):
    """Words that share their first four letters with a word of another text."""
    b = load(spark, sf, "benchmark").select(F.explode(text.words(F.col("text"))).alias("form")).distinct().where(F.length("form") >= 4).withColumn("p", F.left("form", F.lit(4)))
    v = tokens.vocabulary(tokens.tokens(load(spark, sf, "documents"))).where(F.length("w") >= 4).select("w", F.left("w", F.lit(4)).alias("p"))
    return b.join(v, "p").where("form <> w").groupBy("form").agg(F.count("*").alias("n_cognates"), F.min("w").alias("first"))


@query("""WITH e AS (SELECT user_id, ts AS a, lead(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS b, event_id FROM events WHERE event_type = 'purchase'), v AS (SELECT user_id, ts, event_id FROM events WHERE event_type = 'view')
SELECT e.event_id, count(v.event_id) AS n_between FROM e LEFT JOIN v ON v.user_id = e.user_id AND v.ts >= e.a AND v.ts < e.b GROUP BY e.event_id""")
def interval_assignment(spark, sf):
    """Views that fall between a purchase and the user's next one (J19): one ordered pass, no range join."""
    e = load(spark, sf, "events").where(F.col("event_type").isin("purchase", "view"))
    # At one instant purchases come first, so views of that instant count for the last of them.
    order = Window.partitionBy("user_id").orderBy("ts", F.when(F.col("event_type") == "purchase", 0).otherwise(1), "event_id")
    buy = F.when(F.col("event_type") == "purchase", F.col("event_id"))
    on = order.rowsBetween(1, Window.unboundedFollowing)
    x = e.select("event_type", "event_id", F.last(buy, ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, 0)).alias("p"), F.count(buy).over(on).alias("later"))
    hit = F.sum(((F.col("event_type") == "view") & (F.col("later") > 0)).cast("long"))
    return x.where("p is not null").groupBy(F.col("p").alias("event_id")).agg(hit.alias("n_between"))


@query("""WITH m AS (SELECT user_id, value >= coalesce(lag(value) OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id), value) AS up, event_type FROM events)
SELECT user_id, event_type, count(*) AS n, bool_and(up) AS monotone FROM m GROUP BY ALL""")
def monotone_runs(spark, sf):
    """Do values only rise in time."""
    w = Window.partitionBy("user_id", "event_type").orderBy("ts", "event_id")
    m = load(spark, sf, "events").withColumn("up", F.col("value") >= F.coalesce(F.lag("value").over(w), F.col("value")))
    return m.groupBy("user_id", "event_type").agg(F.count("*").alias("n"), F.bool_and("up").alias("monotone"))


@query("""SELECT o_custkey, o_orderkey, o_totalprice, CAST(r AS INTEGER) AS r FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS r FROM orders) WHERE r <= 5""")
def top5_per_group(spark, sf):
    """Each customer's five dearest orders."""
    w = Window.partitionBy("o_custkey").orderBy(F.desc("o_totalprice"), "o_orderkey")
    return load(spark, sf, "orders").withColumn("r", F.row_number().over(w)).where("r <= 5").select("o_custkey", "o_orderkey", "o_totalprice", "r")


@query(f"""WITH {TYPES}, b AS (SELECT DISTINCT unnest({WORDS}) AS w FROM benchmark), c AS (SELECT DISTINCT unnest({WORDS}) AS w FROM conversations), d AS (SELECT w FROM types)
SELECT 'benchmark_only' AS part, count(*) AS n FROM (SELECT w FROM b EXCEPT SELECT w FROM d) UNION ALL SELECT 'both_extra', count(*) FROM (SELECT w FROM b INTERSECT SELECT w FROM c) UNION ALL SELECT 'all', count(*) FROM (SELECT w FROM b UNION SELECT w FROM c UNION SELECT w FROM d)""")
def vocabulary_sets(spark, sf):
    """Differences, intersections and unions of vocabularies (set operations)."""
    of = lambda t: load(spark, sf, t).select(F.explode(text.words(F.col("text"))).alias("w")).distinct()
    b, c, d = of("benchmark"), of("conversations"), of("documents")
    n = lambda df, name: df.agg(F.count("*").alias("n")).select(F.lit(name).alias("part"), "n")
    return n(b.exceptAll(b.intersect(d)), "benchmark_only").unionByName(n(b.intersect(c), "both_extra")).unionByName(n(b.union(c).union(d).distinct(), "all"))


@query(f"""WITH {TOK}, p AS (SELECT w, count(*) AS n, count(*) FILTER (i = 0) / count(*) AS share FROM tok WHERE n >= 2 GROUP BY w), t AS (SELECT * FROM p WHERE w IN ('the', 'de', 'der', 'el')),
k AS (SELECT t.w, t.n, t.share, p.share AS s FROM t JOIN p ON p.n >= 8 AND p.n BETWEEN t.n * 0.5 AND t.n * 2 AND p.w NOT IN ('the', 'de', 'der', 'el'))
SELECT w, n AS n_occ, round(share, 6) AS initial_share, count(*) AS n_placebos, round((count(*) FILTER (s >= share) + 1) / (count(*) + 1), 6) AS p FROM k GROUP BY ALL""")
def placebo_band(spark, sf):
    """Initial shares of chosen words against all words of like frequency."""
    chosen = ("the", "de", "der", "el")
    p = tokens.positions(tokens.tokens(load(spark, sf, "documents"))).select("w", F.col("n_occ").alias("n"), (F.col("n_initial") / F.col("n_occ")).alias("share"))
    t = p.where(F.col("w").isin(*chosen)).select("w", "n", "share")
    rest = p.where(~F.col("w").isin(*chosen) & (F.col("n") >= 8)).select(F.col("n").alias("m"), F.col("share").alias("s"))
    k = rest.join(F.broadcast(t), (F.col("m") >= F.col("n") * 0.5) & (F.col("m") <= F.col("n") * 2))  # four words
    hit = F.sum((F.col("s") >= F.col("share")).cast("long"))
    return k.groupBy("w", F.col("n").alias("n_occ"), F.col("share")).agg(F.count("*").alias("n_placebos"), ((hit + 1) / (F.count("*") + 1)).alias("p")).select("w", "n_occ", F.round("share", 6).alias("initial_share"), "n_placebos", F.round("p", 6).alias("p"))


_MASK = "list_transform(ws, lambda x: CASE WHEN x IN ('view', 'click') THEN 'look' ELSE x END)"


@query(f"""WITH s0 AS (SELECT user_id, CAST(ts AS DATE) AS d, list(event_type ORDER BY ts, event_id) AS ws FROM events GROUP BY ALL), s AS (SELECT user_id, ws, {_MASK} AS m FROM s0 WHERE len(ws) BETWEEN 3 AND 8),
t AS (SELECT user_id, m, unnest(ws) AS w, unnest(range(1, len(ws) + 1)) AS i FROM s), c AS (SELECT DISTINCT len(m) || '/' || i || '/' || array_to_string(m[1:i-1], ' ') || '|' || array_to_string(m[i+1:], ' ') AS ctx, w, user_id FROM t),
p AS (SELECT ctx, w, min(user_id) AS lo, max(user_id) AS hi FROM c GROUP BY ALL)
SELECT x.w AS a, y.w AS b, count(*) AS n_contexts FROM p x JOIN p y ON x.ctx = y.ctx AND x.w < y.w AND NOT (x.lo = y.lo AND x.hi = y.hi AND x.lo = x.hi) GROUP BY ALL""")
def skeleton_pairs(spark, sf):
    """Minimal pairs whose contexts agree up to a class of symbols."""
    e = load(spark, sf, "events")
    d = e.groupBy("user_id", F.to_date("ts").alias("d")).agg(F.array_sort(F.collect_list(F.struct("ts", "event_id", "event_type"))).alias("x"))
    s = d.select("user_id", F.transform("x", lambda z: z["event_type"]).alias("ws")).where(F.size("ws").between(3, 8))
    return matching.minimal_pairs(s, "ws", "user_id", F.transform("ws", lambda x: F.when(x.isin("view", "click"), "look").otherwise(x)), parts=e.rdd.getNumPartitions())


@query(f"""WITH {REC}, g AS (SELECT doc_id, CASE WHEN len(ws) = 0 THEN 'empty' WHEN len(ws) > 1 THEN 'multi' WHEN len(ws[1]) >= 12 THEN 'long-unseg' ELSE 'single' END AS seg,
CASE WHEN len(ws) >= 8 AND len(list_filter(ws, lambda x: len(x) = 1)) * 10 >= len(ws) * 8 THEN 'abecedarium?' ELSE 'text' END AS kind FROM rec)
SELECT seg, kind, count(*) AS n FROM g GROUP BY ALL""")
def record_classes(spark, sf):
    """Records by segmentation and kind."""
    r = load(spark, sf, "documents").select(text.words(F.col("text")).alias("ws"))
    return r.select(text.segmentation(F.col("ws")).alias("seg"), text.text_kind(F.col("ws")).alias("kind")).groupBy("seg", "kind").agg(F.count("*").alias("n"))


@query("""WITH o AS (SELECT o_orderpriority AS x, CAST(floor(date_diff('day', TIMESTAMP '1992-01-01', o_orderdate) + CAST(concat('0x', substr(md5(concat_ws(':', '42', '1', o_orderkey::VARCHAR)), 1, 12)) AS BIGINT)::DOUBLE / 281474976710656.0 * 365) AS BIGINT) // 730 AS b FROM orders)
SELECT x, b, count(*) AS n FROM o GROUP BY ALL""")
def imputed_periods(spark, sf):
    """Orders by period after dates are drawn within a year of their own."""
    day = F.datediff(F.col("o_orderdate"), F.lit("1992-01-01").cast("date"))
    drawn = F.floor(day + nulls.uniform(42, 1, F.col("o_orderkey")) * 365)
    return load(spark, sf, "orders").select(F.col("o_orderpriority").alias("x"), F.floor(drawn / 730).alias("b")).groupBy("x", "b").agg(F.count("*").alias("n"))


@query(f"""WITH {TOK}, c AS (SELECT source, w, count(*) AS c FROM tok GROUP BY ALL), k AS (SELECT w FROM c GROUP BY w HAVING sum(c) >= 200), r AS (SELECT c.source, c.w, c.c, sum(c.c) OVER (PARTITION BY c.source) AS t FROM c),
s AS (SELECT w, max(c / t) - min(c / t) AS spread, count(*) AS n_sources FROM r JOIN k USING (w) GROUP BY w)
SELECT w, n_sources, round(spread, 8) AS spread FROM s""")
def source_rate_spread(spark, sf):
    """How far a frequent word's rate differs between sources that have it."""
    c = tokens.tokens(load(spark, sf, "documents"), "source").groupBy("source", "w").agg(F.count("*").alias("c"))
    t = c.groupBy("source").agg(F.sum("c").alias("t"))
    k = c.groupBy("w").agg(F.sum("c").alias("f")).where("f >= 200").select("w")
    r = c.join(k, "w", "left_semi").join(F.broadcast(t), "source")  # a row a source
    return r.groupBy("w").agg(F.count("*").alias("n_sources"), F.round(F.max(F.col("c") / F.col("t")) - F.min(F.col("c") / F.col("t")), 8).alias("spread"))


@query(f"""WITH {REC}, u0 AS (SELECT doc_id AS id, min(quality) AS y, any_value(ws) AS ws FROM labels JOIN rec USING (doc_id) GROUP BY doc_id), f0 AS (SELECT DISTINCT id, y, unnest(ws) AS feature FROM u0),
n AS (SELECT y, count(*) AS n FROM u0 GROUP BY y), c AS (SELECT feature, y, count(*) AS c FROM f0 GROUP BY ALL), w AS (SELECT feature, sum(c) AS f, max(CASE WHEN y = 1 THEN c END) AS c1, max(CASE WHEN y = 0 THEN c END) AS c0 FROM c GROUP BY feature)
SELECT feature, CAST(f AS BIGINT) AS n, round(ln((coalesce(c1, 0) + 1) / ((SELECT n FROM n WHERE y = 1) + 2)) - ln((coalesce(c0, 0) + 1) / ((SELECT n FROM n WHERE y = 0) + 2)), 6) AS weight FROM w WHERE f >= 10""")
def feature_weights(spark, sf):
    """Log odds that a word's presence lends to a label (M1, M8)."""
    lab = load(spark, sf, "labels").groupBy("doc_id").agg(F.min("quality").alias("y"))
    u = load(spark, sf, "documents").join(lab, "doc_id").select("doc_id", "y", F.explode(F.array_distinct(text.words(F.col("text")))).alias("feature"))
    n = lab.join(load(spark, sf, "documents").select("doc_id"), "doc_id", "left_semi").agg(*[F.sum((F.col("y") == i).cast("long")).alias(f"n{i}") for i in (0, 1)])
    w = u.groupBy("feature").agg(F.count("*").alias("n"), *[F.sum((F.col("y") == i).cast("long")).alias(f"c{i}") for i in (0, 1)]).where("n >= 10").crossJoin(F.broadcast(n))
    weight = F.ln((F.col("c1") + 1) / (F.col("n1") + 2)) - F.ln((F.col("c0") + 1) / (F.col("n0") + 2))
    return w.select("feature", "n", F.round(weight, 6).alias("weight"))
