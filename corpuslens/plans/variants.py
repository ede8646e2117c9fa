"""Greedy reading variants, context tiers, transfer between sources, and nulls that keep a table's mask."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import text
from ..operators import graphs, matching, models, nulls, tokens
from ..sources.tables import load
from .inference import R, SEED, _cut
from .registry import REC, TOK, WORDS, query

_HELD = "substr(md5(concat_ws(':', '42', {u}::VARCHAR)), 1, 1) < '4'"


@query(f"""WITH RECURSIVE {REC}, d AS (SELECT doc_id AS id, source, ws FROM rec WHERE len(ws) > 0),
p AS (SELECT x.id AS a, y.id AS b FROM d x JOIN d y ON x.source = y.source AND len(x.ws) = len(y.ws) AND x.id < y.id WHERE len(list_filter(range(1, len(x.ws) + 1), lambda i: x.ws[i] = y.ws[i])) * 10 >= len(x.ws) * 8),
nb AS (SELECT id, row_number() OVER (ORDER BY id) AS k, prev FROM (SELECT id, list(a ORDER BY a) FILTER (a IS NOT NULL) AS prev FROM (SELECT a AS id FROM p UNION SELECT b FROM p) LEFT JOIN p ON b = id GROUP BY id)),
g(k, canon) AS (SELECT 0::BIGINT, []::BIGINT[] UNION ALL SELECT nb.k, CASE WHEN list_has_any(canon, coalesce(prev, [])) THEN canon ELSE list_append(canon, nb.id) END FROM g JOIN nb ON nb.k = g.k + 1),
c AS (SELECT unnest(canon) AS id FROM (SELECT canon FROM g ORDER BY k DESC LIMIT 1))
SELECT b AS id, min(a) AS canon FROM p WHERE a IN (SELECT id FROM c) AND b NOT IN (SELECT id FROM c) GROUP BY b""")
def variant_readings(spark, sf):
    """Readings of one source with equal word counts that agree in 80 % of places; the first of each is canonical."""
    d = load(spark, sf, "documents").select(F.col("doc_id").alias("id"), "source", text.words(F.col("text")).alias("ws")).where(F.size("ws") > 0)
    return graphs.first_wins(matching.agreeing(d, "id", "source", "ws", 8, 10, _cut(spark)), _cut(spark))


@query(rf"""WITH l AS (SELECT source, unnest(regexp_split_to_array(text, '[.\n]+')) AS text FROM documents), s AS (SELECT source, {WORDS} AS ws FROM l), k AS (SELECT * FROM s WHERE len(ws) >= 2),
t AS (SELECT source, ws, unnest(ws) AS w, unnest(range(1, len(ws) + 1)) AS i FROM k), c AS (SELECT DISTINCT len(ws) || '/' || i || '/' || array_to_string(ws[1:i-1], ' ') || '|' || array_to_string(ws[i+1:], ' ') AS ctx, w, source FROM t),
p AS (SELECT ctx, w, min(source) AS lo, max(source) AS hi FROM c GROUP BY ALL)
SELECT x.w AS a, y.w AS b, count(*) AS n_contexts FROM p x JOIN p y ON x.ctx = y.ctx AND x.w < y.w AND NOT (x.lo = y.lo AND x.hi = y.hi AND x.lo = x.hi) GROUP BY ALL""")
def cross_region_pairs(spark, sf):
    """Words that replace each other in otherwise equal sentences of different sources (J8, J9 across regions).

    Sentences of any length; one of a single word has no other words that could be equal.
    """
    docs = load(spark, sf, "documents")
    lines = docs.select("source", F.explode(F.split("text", r"[.\n]+")).alias("s"))
    # No filter, as that would split every line a second time.
    s = lines.select("source", text.words(F.col("s")).alias("ws")).select("source", F.when(F.size("ws") >= 2, F.col("ws")).alias("ws"))
    return matching.minimal_pairs(s, "ws", "source", parts=8 * docs.rdd.getNumPartitions())


@query(f"""WITH {TOK}, h AS (SELECT w, {_HELD.format(u="doc_id")} AS held FROM tok), tr AS (SELECT w, count(*) AS c FROM h WHERE NOT held GROUP BY w), te AS (SELECT w, count(*) AS c FROM h WHERE held GROUP BY w),
n AS (SELECT sum(c) AS n, count(*) AS v, sum(c * len(w)) AS letters FROM tr), ch AS (SELECT ch, sum(c) AS c FROM (SELECT unnest(string_split(w, '')) AS ch, c FROM tr) GROUP BY ch), z AS (SELECT n, v, letters + n + (SELECT count(*) FROM ch) + 1 AS d FROM n),
o AS (SELECT w, c FROM te WHERE w NOT IN (SELECT w FROM tr)), oc AS (SELECT o.w, o.c, sum(-log2((coalesce(ch.c, 0) + 1) / d)) - log2((any_value(n) + 1) / any_value(d)) AS bits FROM (SELECT w, c, unnest(string_split(w, '')) AS x FROM o) o LEFT JOIN ch ON ch.ch = x CROSS JOIN z GROUP BY ALL),
b AS (SELECT te.c, -log2((tr.c + 1) / (n + v + 1)) AS bits, 0 AS new FROM te JOIN tr USING (w) CROSS JOIN z UNION ALL SELECT oc.c, -log2(1 / (n + v + 1)) + bits, 1 FROM oc CROSS JOIN z)
SELECT CAST(sum(c) AS BIGINT) AS n_tokens, count(*) AS n_types, CAST(sum(new) AS BIGINT) AS n_new, CAST(coalesce(sum(c) FILTER (new = 1), 0) AS BIGINT) AS n_new_tokens, round(sum(c * bits) / sum(c), 6) AS bits_per_token FROM b""")
def unigram_backoff_bits(spark, sf):
    """Bits a token of held-out records costs under word counts with letters as back-off."""
    held = F.substring(nulls.hashed(SEED, F.col("doc_id")), 1, 1) < "4"
    t = tokens.tokens(load(spark, sf, "documents"), "doc_id").select("w", held.alias("held"))
    per = t.groupBy("w").agg(F.sum((~F.col("held")).cast("long")).alias("tr"), F.sum(F.col("held").cast("long")).alias("te"))
    letters = lambda c: F.explode(F.filter(F.split("w", ""), lambda x: x != "")).alias(c)
    known = per.where("tr > 0")
    ch = known.select(letters("x"), "tr").groupBy("x").agg(F.sum("tr").alias("c"))
    n = known.agg(F.sum("tr").alias("n"), F.count("*").alias("v"))
    z = n.crossJoin(ch.agg(F.sum("c").alias("all"), F.count("*").alias("a"))).select("n", "v", (F.col("all") + F.col("n") + F.col("a") + 1).alias("d"))
    z = F.broadcast(z)  # one row
    new = per.where("tr = 0 and te > 0").select("w", "te", letters("x")).join(ch, "x", "left").crossJoin(z)
    spelt = new.groupBy("w", "te", "n", "v", "d").agg(F.sum(-F.log2((F.coalesce("c", F.lit(0)) + 1) / F.col("d"))).alias("b"))
    spelt = spelt.select("te", (F.col("b") - F.log2((F.col("n") + 1) / F.col("d")) - F.log2(1 / (F.col("n") + F.col("v") + 1))).alias("bits"), F.lit(1).alias("new"))
    seen = known.where("te > 0").crossJoin(z).select("te", (-F.log2((F.col("tr") + 1) / (F.col("n") + F.col("v") + 1))).alias("bits"), F.lit(0).alias("new"))
    b = seen.unionByName(spelt)
    return b.agg(
        F.sum("te").alias("n_tokens"), F.count("*").alias("n_types"), F.sum("new").alias("n_new"), F.sum(F.col("te") * F.col("new")).alias("n_new_tokens"),
        F.round(F.sum(F.col("te") * F.col("bits")) / F.sum("te"), 6).alias("bits_per_token"),
    )


#: Event types that stay in a context's skeleton; all others are one sign there.
_OPS = ["purchase", "error"]
_CTX = "len({m}) || '/' || i || '/' || array_to_string({m}[1:i], ' ') || '|' || array_to_string({m}[i+2:], ' ')"


@query(f"""WITH q AS (SELECT user_id, CAST(ts AS DATE) AS d, list(event_type ORDER BY ts, event_id) AS ws FROM events GROUP BY ALL), s AS (SELECT *, list_transform(ws, lambda x: CASE WHEN x IN ('purchase', 'error') THEN x ELSE '*' END) AS m FROM q WHERE len(ws) BETWEEN 3 AND 8),
e AS (SELECT user_id, d, ws, m, len(ws) AS n, unnest(ws) AS w, unnest(range(len(ws))) AS i FROM s),
t AS (SELECT user_id || '/' || d || '/' || i AS id, {_HELD.format(u="user_id")} AS held, w, {_CTX.format(m="ws")} AS c0, {_CTX.format(m="m")} AS c1, CASE WHEN i = 0 THEN 'init' WHEN i = n - 1 THEN 'fin' ELSE 'mid' END AS c2, '' AS c3 FROM e),
l AS (SELECT id, held, w, unnest([0, 1, 2, 3]) AS tier, unnest([c0, c1, c2, c3]) AS ctx FROM t),
k AS (SELECT tier, ctx, w, row_number() OVER (PARTITION BY tier, ctx ORDER BY count(*) DESC, w) AS r FROM l WHERE NOT held GROUP BY tier, ctx, w),
c AS (SELECT l.id, l.w AS truth, l.tier, k.w, k.r FROM l JOIN k USING (tier, ctx) WHERE held AND k.r <= 5),
x AS (SELECT id, truth, w, min(tier * 10 + r) AS o, min(tier * 10 + r) FILTER (tier >= 2) AS ob FROM c GROUP BY ALL),
y AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY o) AS r, CASE WHEN ob IS NOT NULL THEN row_number() OVER (PARTITION BY id ORDER BY ob NULLS LAST) END AS rb, min(o) OVER (PARTITION BY id) // 10 AS used FROM x),
h AS (SELECT id, truth, any_value(used) AS used, count(*) FILTER (w = truth AND r = 1) AS t1, count(*) FILTER (w = truth AND r <= 3) AS t3, count(*) FILTER (w = truth AND rb = 1) AS b1, count(*) FILTER (w = truth AND rb <= 3) AS b3 FROM y GROUP BY ALL)
SELECT stratum, count(*) AS n, count(*) FILTER (used = 0) AS by_exact, count(*) FILTER (used = 1) AS by_skeleton, CAST(sum(t1) AS BIGINT) AS top1, CAST(sum(t3) AS BIGINT) AS top3, CAST(sum(b1) AS BIGINT) AS base1, CAST(sum(b3) AS BIGINT) AS base3
FROM (SELECT *, unnest(['all', CASE WHEN truth IN ('purchase', 'error') THEN 'operators' ELSE 'open' END]) AS stratum FROM h) GROUP BY stratum""")
def restoration_tiers(spark, sf):
    """A masked event guessed from its whole context, its skeleton, its slot and all events, in this order, by stratum."""
    q = load(spark, sf, "events").groupBy("user_id", F.to_date("ts").alias("d")).agg(F.array_sort(F.collect_list(F.struct("ts", "event_id", "event_type"))).alias("x"))
    s = q.select("user_id", "d", F.transform("x", lambda z: z["event_type"]).alias("ws")).where(F.size("ws").between(3, 8))
    s = s.withColumn("m", F.transform("ws", lambda x: F.when(x.isin(_OPS), x).otherwise("*"))).withColumn("n", F.size("ws"))
    e = s.select("user_id", "d", "ws", "m", "n", F.posexplode("ws").alias("i", "w"))
    around = lambda c: F.concat_ws("/", "n", "i", F.array_join(F.slice(c, F.lit(1), F.col("i")), " "), F.array_join(F.slice(c, F.col("i") + 2, F.col("n")), " "))
    held = F.substring(nulls.hashed(SEED, F.col("user_id")), 1, 1) < "4"
    # The whole context settles the others, so events of one context and type are one row with their number.
    e = e.select(held.alias("held"), "w", around("ws").alias("c0"), around("m").alias("c1"), text.slot_of(F.col("i"), F.col("n")).alias("c2"))
    per = e.groupBy("held", "c0", "c1", "c2", "w").agg(F.count("*").alias("z")).withColumn("id", F.concat_ws("|", "c0", "w"))
    t = per.select("id", "held", "w", "z", F.posexplode(F.array("c0", "c1", "c2", F.lit(""))).alias("tier", "ctx"))
    train = t.where("not held").groupBy("tier", "ctx", "w").agg(F.sum("z").alias("c"))
    k = train.withColumn("r", F.row_number().over(Window.partitionBy("tier", "ctx").orderBy(F.desc("c"), "w"))).where("r <= 5").drop("c")
    c = t.where("held").withColumnRenamed("w", "truth").join(k, ["tier", "ctx"])
    place = F.col("tier") * 10 + F.col("r")
    x = c.groupBy("id", "truth", "z", "w").agg(F.min(place).alias("o"), F.min(F.when(F.col("tier") >= 2, place)).alias("ob"))
    # Few candidates an event (five a tier at most): their order is read off the collected row.
    y = x.groupBy("id", "truth", "z").agg(F.sort_array(F.collect_list(F.struct("o", "w"))).alias("m"), F.sort_array(F.collect_list(F.when(F.col("ob").isNotNull(), F.struct("ob", "w")))).alias("b"))
    hit = lambda a, k: F.when(F.array_contains(F.transform(F.slice(a, 1, k), lambda z: z["w"]), F.col("truth")), F.col("z")).otherwise(0)
    h = y.select("truth", "z", F.floor(F.element_at("m", 1)["o"] / 10).alias("used"), hit("m", 1).alias("t1"), hit("m", 3).alias("t3"), hit("b", 1).alias("b1"), hit("b", 3).alias("b3"))
    strata = F.explode(F.array(F.lit("all"), F.when(F.col("truth").isin(_OPS), "operators").otherwise("open")))
    out = h.withColumn("stratum", strata).groupBy("stratum")
    by = lambda v: F.sum(F.when(F.col("used") == v, F.col("z")).otherwise(0))
    return out.agg(F.sum("z").alias("n"), by(0).alias("by_exact"), by(1).alias("by_skeleton"), F.sum("t1").alias("top1"), F.sum("t3").alias("top3"), F.sum("b1").alias("base1"), F.sum("b3").alias("base3"))


@query(f"""WITH {TOK}, c AS (SELECT CAST(regexp_extract(source, '[0-9]+$') AS BIGINT) % 2 = 1 AS test, w, lang, count(*) AS c FROM tok GROUP BY ALL), m AS (SELECT test, w, lang AS y FROM (SELECT *, row_number() OVER (PARTITION BY test, w ORDER BY c DESC, lang) AS r FROM c) WHERE r = 1),
k AS (SELECT y FROM m GROUP BY y HAVING count(DISTINCT test) = 2), b AS (SELECT w FROM m GROUP BY w HAVING count(*) = 2), u AS (SELECT test, w, y FROM m WHERE y IN (SELECT y FROM k) AND w NOT IN (SELECT w FROM b)),
f AS (SELECT test, w, y, right(w, j) AS feature FROM u, (SELECT unnest([1, 2, 3]) AS j) WHERE len(w) >= j), n AS (SELECT y, count(*) AS n FROM u WHERE NOT test GROUP BY y), h AS (SELECT y, feature, count(*) AS n1 FROM f WHERE NOT test GROUP BY ALL),
g AS (SELECT n.y, v.feature, n, coalesce(n1, 0) AS n1 FROM (SELECT DISTINCT feature FROM h) v CROSS JOIN n LEFT JOIN h ON h.y = n.y AND h.feature = v.feature), wt AS (SELECT y, feature, ln((n1 + 1) / (n + 2)) AS l1, ln((n - n1 + 1) / (n + 2)) AS l0 FROM g),
pr AS (SELECT n.y, ln(n + 1) + sum(l0) AS b FROM n JOIN wt USING (y) GROUP BY n.y, n), d AS (SELECT w, wt.y, sum(l1 - l0) AS d FROM f JOIN wt USING (feature) WHERE test GROUP BY ALL),
sc AS (SELECT u.w, u.y AS truth, pr.y, round(b + coalesce(d, 0), 9) AS score FROM u CROSS JOIN pr LEFT JOIN d ON d.w = u.w AND d.y = pr.y WHERE test), de AS (SELECT truth, y AS guess FROM (SELECT *, row_number() OVER (PARTITION BY w ORDER BY score DESC, y) AS r FROM sc) WHERE r = 1),
pc AS (SELECT k.y, count(*) FILTER (truth = k.y) AS n, count(*) FILTER (truth = k.y AND guess = k.y) AS hits, count(*) FILTER (guess = k.y) AS guessed FROM k, de GROUP BY k.y)
SELECT (SELECT count(*) FROM u WHERE NOT test) AS n_train, CAST(sum(n) AS BIGINT) AS n_test, round((SELECT count(*) FROM b) / (SELECT count(*) FROM m WHERE test), 6) AS leak_share, round(sum(hits) / sum(n), 6) AS accuracy, round(avg(hits / n), 6) AS balanced, round(avg(2 * hits / (guessed + n)), 6) AS macro_f1, round(max(n) / sum(n), 6) AS majority FROM pc WHERE n > 0""")
def exclusive_transfer(spark, sf):
    """A word's language learnt from endings in one half of the sources and tried on words that only the other half has."""
    test = (F.regexp_extract("source", "[0-9]+$", 0).cast("long") % 2 == 1).alias("test")
    c = tokens.tokens(load(spark, sf, "documents"), "source", "lang").select(test, "w", "lang").groupBy("test", "w", "lang").agg(F.count("*").alias("c"))
    m = c.groupBy("test", "w").agg(F.min(F.struct((-F.col("c")).alias("c"), "lang")).alias("x")).select("test", "w", F.col("x.lang").alias("y"))
    sides = m.groupBy("w").agg(F.count("*").alias("sides"), F.min("test").alias("test"), F.min("y").alias("y"))
    both = m.groupBy("y").agg(F.count_distinct("test").alias("k")).where("k = 2").select("y")
    u = sides.where("sides = 1").join(F.broadcast(both), "y").select("test", F.col("w").alias("id"), "y")  # a few labels
    feats = u.select("id", F.explode(F.transform(F.sequence(F.lit(1), F.least(F.length("id"), F.lit(3))), lambda k: F.right("id", k))).alias("feature"))
    train, tried = u.where("not test").select("id", "y"), u.where("test").select("id", "y")
    prior, weights = models.bernoulli_fit(train, feats, "id", "y")
    scores = models.bernoulli_scores(tried, feats, prior, weights, "id", "y").withColumn("score", F.round("score", 9))
    cells = models.confusion(tried.withColumnRenamed("y", "truth").join(models.decide(scores, "id", "y"), "id"), "truth", "predicted")
    out = models.overall(models.class_scores(cells, "truth", "predicted"))
    leak = sides.agg((F.sum((F.col("sides") == 2).cast("long")) / F.sum(((F.col("sides") == 2) | F.col("test")).cast("long"))).alias("leak_share"), F.sum((~F.col("test") & (F.col("sides") == 1)).cast("long")).alias("_all"))
    n = train.agg(F.count("*").alias("n_train"))
    return out.crossJoin(leak).crossJoin(n).select("n_train", F.col("n").alias("n_test"), *[F.round(x, 6).alias(x) for x in ("leak_share", "accuracy", "balanced", "macro_f1", "majority")])


@query(f"""WITH t AS (SELECT conv_id, turn, {WORDS} AS ws FROM conversations), u AS (SELECT conv_id, turn, conv_id * 1000 + turn AS id, list_sort(list_distinct(list_transform(ws[1:2], lambda x: x[1]))) AS v FROM t WHERE len(ws) > 0), z AS (SELECT *, len(v) AS m FROM u),
sh AS (SELECT rep, conv_id, turn, m, v, row_number() OVER (PARTITION BY rep, turn, m ORDER BY id) AS k, row_number() OVER (PARTITION BY rep, turn, m ORDER BY md5(concat_ws(':', '42', rep::VARCHAR, id::VARCHAR)), id) AS h FROM z, (SELECT unnest(range(1, {R + 1})) AS rep)),
pm AS (SELECT a.rep, a.conv_id, a.turn, b.v FROM sh a JOIN sh b ON a.rep = b.rep AND a.turn = b.turn AND a.m = b.m AND a.k = b.h), al AS (SELECT 0 AS rep, conv_id, turn, v FROM z UNION ALL SELECT * FROM pm),
sc AS (SELECT x.rep, x.conv_id, count(*) FILTER (list_has_any(x.v, y.v)) AS stat FROM al x JOIN al y ON x.rep = y.rep AND x.conv_id = y.conv_id AND x.turn < y.turn GROUP BY ALL),
s AS (SELECT * FROM sc WHERE rep > 0), mx AS (SELECT rep, max(stat) AS m FROM s GROUP BY rep), own AS (SELECT conv_id, o.stat, count(*) FILTER (s.stat >= o.stat) AS hit FROM (SELECT * FROM sc WHERE rep = 0) o JOIN s USING (conv_id) GROUP BY ALL),
q AS (SELECT o.stat, (SELECT count(*) FROM s WHERE s.stat >= o.stat) AS pool, (SELECT count(*) FROM mx WHERE mx.m >= o.stat) AS top FROM (SELECT DISTINCT stat FROM own) o)
SELECT conv_id, stat, round((hit + 1) / ({R} + 1), 6) AS p, round((pool + 1) / ((SELECT count(*) FROM s) + 1), 6) AS p_pooled, round((top + 1) / ({R} + 1), 6) AS p_fwer FROM own JOIN q USING (stat)""")
def mask_preserving_null(spark, sf, r=R):
    """Turns of a conversation that share initial letters, against letters exchanged among conversations that have the turn and as many letters: own, pooled and family-wise p."""
    ws = load(spark, sf, "conversations").select("conv_id", "turn", text.words(F.col("text")).alias("ws")).where(F.size("ws") > 0)
    v = F.array_sort(F.array_distinct(F.transform(F.slice("ws", 1, 2), lambda x: F.left(x, F.lit(1)))))
    z = ws.select("conv_id", "turn", (F.col("conv_id") * 1000 + F.col("turn")).alias("id"), v.alias("v")).withColumn("m", F.size("v"))
    turns = lambda df, *by: df.groupBy(*by, "conv_id").agg(F.collect_list("v").alias("vs"))  # noqa: E731  the turns of one conversation
    alike = lambda vs, a, i: F.size(F.filter(vs, lambda b, j: (j > i) & F.arrays_overlap(a, b)))
    score = F.aggregate(F.transform("vs", lambda a, i: alike(F.col("vs"), a, i)), F.lit(0), lambda x, y: x + y).cast("long").alias("stat")
    stat = lambda df, *by: turns(df, *by).where(F.size("vs") > 1).select(*by, "conv_id", score)
    cut = _cut(spark)
    obs, sim = cut(stat(z)), cut(stat(nulls.permute(z, r, SEED, "v", F.col("id"), ("turn", "m")), "rep"))
    own = nulls.add_one(obs, sim, ["conv_id"], r=r)
    # Scores are few whole numbers: the pool and the maxima are counted by score.
    many = sim.groupBy("stat").agg(F.count("*").alias("c"))
    tops = sim.groupBy("rep").agg(F.max("stat").alias("stat")).groupBy("stat").agg(F.count("*").alias("t"))
    at = many.join(tops, "stat", "left").select(F.col("stat").alias("s"), "c", F.coalesce("t", F.lit(0)).alias("t"))
    seen = obs.select("stat").distinct().crossJoin(F.broadcast(at))  # one row a score, at most turns squared
    tail = lambda x: F.sum(F.when(F.col("s") >= F.col("stat"), F.col(x)).otherwise(0))
    q = seen.groupBy("stat").agg(((tail("c") + 1) / (F.sum("c") + 1)).alias("p_pooled"), ((tail("t") + 1) / (r + 1)).alias("p_fwer"))
    return own.join(q, "stat").select("conv_id", "stat", *[F.round(x, 6).alias(x) for x in ("p", "p_pooled", "p_fwer")])


@query("""WITH l AS (SELECT doc_id, min(quality) AS quality, min(toxic) AS toxic FROM labels GROUP BY doc_id), s AS (SELECT doc_id, source FROM documents ORDER BY md5('43:' || doc_id::VARCHAR), doc_id LIMIT 50)
SELECT doc_id, source, quality, toxic, quality IS NOT NULL AS carried FROM s LEFT JOIN l USING (doc_id)""")
def annotated_sample(spark, sf):
    """A reproducible sample of 50 records that keeps earlier annotations by key."""
    s = tokens.top(load(spark, sf, "documents"), 50, F.md5(F.concat(F.lit("43:"), F.col("doc_id").cast("string")).cast("binary")), "doc_id").select("doc_id", "source")
    notes = load(spark, sf, "labels").groupBy("doc_id").agg(F.min("quality").alias("quality"), F.min("toxic").alias("toxic"))
    return s.join(notes, "doc_id", "left").withColumn("carried", F.col("quality").isNotNull())
