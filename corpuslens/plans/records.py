"""Views, keys, comparison forms, file sources and layout folds over the tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import records, text
from ..operators import tokens
from ..sources import files
from ..sources.tables import load
from .inference import _cut
from .registry import REC, TOK, TYPES, query

#: Sources whose records another source has too.
SKIPPED = ("src18", "src19")
#: Rows of copies that are sent to all tasks at most.
SENT = 500_000
OPERATORS = {"the": "DET", "le": "DET", "la": "DET", "der": "DET", "and": "CONJ", "und": "CONJ", "et": "CONJ", "of": "PREP", "de": "PREP", "von": "PREP"}
GENRES = (("dedic", ("donc", "auch")), ("speaking", ("she", "ist")), ("epitaph", ("the", "der")))
ENDINGS = ("tion", "ing", "er", "ed", "ung", "en", "eau", "ment", "ción", "ar")
_LIST = "[" + ", ".join(f"'{e}'" for e in ENDINGS) + "]"
#: stem and longest ending of a word, in SQL.
_CUT = "CASE " + " ".join(f"WHEN w LIKE '%{e}' AND len(w) >= {len(e) + 3} THEN '{e}'" for e in sorted(ENDINGS, key=lambda x: (-len(x), x))) + " END"


@query(f"""WITH {REC}, f AS (SELECT text, min(doc_id) AS first FROM documents GROUP BY text),
v AS (SELECT d.doc_id, d.source, len(r.ws) AS n, d.source NOT IN ('src18', 'src19') AND d.doc_id = f.first AND NOT (len(r.ws) >= 8 AND 10 * len(list_filter(r.ws, lambda x: len(x) = 1)) >= 8 * len(r.ws)) AS keep
      FROM documents d JOIN rec r USING (doc_id) JOIN f ON d.text IS NOT DISTINCT FROM f.text)
SELECT source, count(*) AS n_records, count(*) FILTER (keep) AS n_view, CAST(coalesce(sum(n) FILTER (keep), 0) AS BIGINT) AS n_tokens FROM v GROUP BY source""")
def canonical_view(spark, sf):
    """Records that analyses read (P1, P8): running text, no variant of an earlier record, no source that another repeats."""
    d = load(spark, sf, "documents").select("doc_id", "source", text.words(F.col("text")).alias("ws"), F.xxhash64("text").alias("h"), F.sha2("text", 256).alias("s"))
    d = d.select("doc_id", "source", F.size("ws").alias("n"), text.text_kind(F.col("ws")).alias("kind"), "s")
    first = d.groupBy("s").agg(F.min("doc_id").alias("first"))
    v = d.join(first, d["s"].eqNullSafe(first["s"])).withColumn("keep", ~F.col("source").isin(*SKIPPED) & (F.col("doc_id") == F.col("first")) & (F.col("kind") == "text"))
    return v.groupBy("source").agg(F.count("*").alias("n_records"), F.sum(F.col("keep").cast("long")).alias("n_view"), F.sum(F.when(F.col("keep"), F.col("n")).otherwise(0)).cast("long").alias("n_tokens"))


@query("""WITH bad AS (SELECT DISTINCT doc_id FROM labels WHERE toxic = 1),
t AS (SELECT source, unnest(regexp_extract_all(text, '[^\\s]+')) AS w FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM bad)),
c AS (SELECT source, w, count(*) AS n FROM t WHERE len(w) >= 2 AND NOT regexp_matches(w, '[-?<>\\[\\]]') GROUP BY ALL)
SELECT source, CAST(sum(n) AS BIGINT) AS n_tokens, count(*) AS n_types FROM c GROUP BY source""")
def clean_reading_types(spark, sf):
    """Tokens and types of clean readings (P5, P6): unflagged records, tokens without unclean marks, two characters or more."""
    bad = load(spark, sf, "labels").where("toxic = 1").select("doc_id").distinct()
    d = load(spark, sf, "documents").join(bad, "doc_id", "left_anti")
    t = d.select("source", F.explode(F.regexp_extract_all("text", F.lit(r"[^\s]+"), F.lit(0))).alias("w")).where(records.is_clean(F.col("w")))
    return t.groupBy("source", "w").agg(F.count("*").alias("n")).groupBy("source").agg(F.sum("n").alias("n_tokens"), F.count("*").alias("n_types"))


@query("""WITH o AS (SELECT o_custkey, CASE WHEN o_orderstatus <> 'P' THEN year(o_orderdate) END AS y FROM orders), t AS (SELECT o_custkey, min(y) AS y_from FROM o WHERE y IS NOT NULL GROUP BY o_custkey)
SELECT coalesce(o.y, t.y_from) AS y_from, o.y IS NULL AND t.y_from IS NOT NULL AS filled, count(*) AS n FROM o LEFT JOIN t USING (o_custkey) WHERE coalesce(o.y, t.y_from) IS NOT NULL GROUP BY ALL""")
def dated_view(spark, sf):
    """Dated records only, undated ones dated by a table where it has their key."""
    o = load(spark, sf, "orders").select("o_custkey", F.when(F.col("o_orderstatus") != "P", F.year("o_orderdate")).alias("y"))
    t = o.where("y is not null").groupBy("o_custkey").agg(F.min("y").alias("t"))
    out = o.join(t, "o_custkey", "left").select(F.coalesce("y", "t").alias("y_from"), (F.col("y").isNull() & F.col("t").isNotNull()).alias("filled"))
    return out.where("y_from is not null").groupBy("y_from", "filled").agg(F.count("*").alias("n"))


@query("""WITH u AS (SELECT user_id, CAST(ts AS DATE) AS d, list(DISTINCT event_type) AS s FROM events GROUP BY ALL)
SELECT list_has_any(s, ['error', 'logout']) AS any_a, list_has_any(s, ['purchase']) AS any_b, list_has_all(s, ['error', 'purchase']) AS both, count(*) AS n FROM u GROUP BY ALL""")
def set_membership(spark, sf):
    """Records by whether they have any or both of two word sets (P10)."""
    u = load(spark, sf, "events").groupBy("user_id", F.to_date("ts").alias("d")).agg(F.collect_set("event_type").alias("s"))
    any_of = lambda *xs: F.arrays_overlap("s", F.array(*map(F.lit, xs)))
    u = u.select(any_of("error", "logout").alias("any_a"), any_of("purchase").alias("any_b"), (any_of("error") & any_of("purchase")).alias("both"))
    return u.groupBy("any_a", "any_b", "both").agg(F.count("*").alias("n"))


@query(f"""WITH {TOK}, g(w, grp) AS (VALUES {", ".join(f"('{w}', '{g}')" for w, g in OPERATORS.items())})
SELECT lang, grp, count(*) AS n_tokens, count(DISTINCT doc_id) AS n_records FROM tok JOIN g USING (w) GROUP BY ALL""")
def operator_groups(spark, sf):
    """Tokens that a registry of operator words has, by group (J6); the registry is a literal of the plan."""
    registry = spark.createDataFrame(list(OPERATORS.items()), "w string, grp string")
    t = tokens.tokens(load(spark, sf, "documents"), "lang").join(F.broadcast(registry), "w")
    per = t.groupBy("lang", "grp", "doc_id").agg(F.count("*").alias("c"))
    return per.groupBy("lang", "grp").agg(F.sum("c").alias("n_tokens"), F.count("*").alias("n_records"))


@query(f"""WITH {TOK}, f AS (SELECT text, min(doc_id) AS first, count(*) AS c FROM documents GROUP BY text),
a AS (SELECT d.doc_id, CASE WHEN source = 'src0' THEN 'ART:0' WHEN c > 1 THEN 'COPY:' || first ELSE source || ':' || doc_id END AS art FROM documents d JOIN f ON d.text IS NOT DISTINCT FROM f.text)
SELECT w, count(*) AS n_occ, count(DISTINCT source) AS n_sources, count(DISTINCT art) AS n_artefacts FROM tok JOIN a USING (doc_id) GROUP BY w HAVING count(*) >= 200""")
def clean_word_stats(spark, sf):
    """Forms with their occurrences, sources and artefacts.

    A record that is an artefact by itself adds one to each of its words; only
    those of shared artefacts are counted by name. So rows of a word and source
    combine before the shuffle, whatever the number of records.
    """
    cut, small = _cut(spark), lambda df: F.broadcast(df) if df.count() <= SENT else df
    d = load(spark, sf, "documents").select("doc_id", "source", "text", F.unhex(F.md5(F.col("text").cast("binary"))).alias("s"))
    f = cut(d.groupBy("s").agg(F.min("doc_id").alias("first"), F.count("*").alias("c")).where("s is not null and c > 1").select("s", "first"))
    twice = cut(d.groupBy("source", "doc_id").agg(F.count("*").alias("c")).where("c > 1").select("source", "doc_id", F.lit(True).alias("twice")))
    d = d.join(small(f), "s", "left").join(small(twice), ["source", "doc_id"], "left")
    alias = F.when(F.col("first").isNotNull(), F.concat(F.lit("COPY:"), F.col("first").cast("string")))
    named = F.col("first").isNotNull() | F.col("twice").isNotNull() | F.col("source").isin("src0", "COPY", "ART")
    art = F.when(named, records.artifact_of(F.col("source"), F.col("doc_id"), alias, {"src0": "ART:0"}))
    ws = d.select("source", art.alias("art"), text.words(F.col("text")).alias("ws"))
    # Outer, as otherwise a filter on the words' number splits every text a second time.
    way = lambda c, own, words: F.struct(F.lit(c).alias("c"), own.alias("own"), words.alias("ws"))
    alone = F.col("art").isNull()
    ways = F.array(way(1, F.lit(0), F.col("ws")), way(0, (alone & F.col("source").isNotNull()).cast("int"), F.when(alone, F.array_distinct("ws"))))
    t = ws.select("source", "art", F.explode(ways).alias("x")).select("source", "art", "x.c", "x.own", F.explode_outer("x.ws").alias("w")).where("w is not null")
    per = cut(t.groupBy("w", "source", "art").agg(F.sum("c").alias("c"), F.sum("own").alias("own")))
    n = small(cut(per.groupBy("w").agg(F.sum("c").alias("n_occ"), F.sum("own").alias("own")).where("n_occ >= 200")))
    per = per.join(n.select("w"), "w", "left_semi")  # most words are rare and go here
    kinds = lambda c: per.where(F.col(c).isNotNull()).groupBy("w", c).agg(F.lit(1).alias("one")).groupBy("w").agg(F.count("*").alias(f"n_{c}"))
    out = n.join(kinds("source"), "w", "left").join(kinds("art"), "w", "left")
    count = lambda c: F.coalesce(c, F.lit(0))
    return out.select("w", "n_occ", count("n_source").alias("n_sources"), (F.col("own") + count("n_art")).alias("n_artefacts"))


@query("""WITH r AS (SELECT regexp_extract(url || ' ', '^https?://[^/]+/([a-z]+)/', 1) AS code FROM pages)
SELECT CASE WHEN code IN ('en', 'fr', 'de') THEN code END AS region, count(*) AS n FROM r GROUP BY ALL""")
def page_regions(spark, sf):
    """Region codes in sigla, where they are known ones."""
    code = records.region_of(F.col("url"), ("en", "fr", "de"), r"^https?://[^/]+/([a-z]+)/")
    return load(spark, sf, "pages").groupBy(code.alias("region")).agg(F.count("*").alias("n"))


def _sql_replace(x: str, pairs: tuple) -> str:
    for a, b in pairs:
        x = f"replace({x}, '{a}', '{b}')"
    return x


@query(f"""WITH {TYPES}, n AS (SELECT regexp_replace(strip_accents({_sql_replace("lower(w)", records.SCRIPT_PAIRS)}), '[^a-z]', '', 'g') AS norm, w, freq FROM types)
SELECT norm, count(*) AS n_forms, min(w) AS first, CAST(sum(freq) AS BIGINT) AS freq FROM n GROUP BY norm HAVING count(*) > 1""")
def norm_collisions(spark, sf):
    """Comparison forms that several words share."""
    v = tokens.vocabulary(tokens.tokens(load(spark, sf, "documents"))).withColumn("norm", records.norm_any(F.col("w")))
    return v.groupBy("norm").agg(F.count("*").alias("n_forms"), F.min("w").alias("first"), F.sum("freq").alias("freq")).where("n_forms > 1")


@query(f"""WITH {TYPES} SELECT w, regexp_replace({_sql_replace("lower(trim(w))", records.INDEX_PAIRS)}, '[^a-z]', '', 'g') AS norm, {_sql_replace("w", (("th", "ϑ"), ("ch", "χ"), ("ph", "φ")))} AS printed FROM types""")
def index_forms(spark, sf):
    """Words as an index compares and an edition prints them."""
    v = tokens.vocabulary(tokens.tokens(load(spark, sf, "documents")))
    return v.select("w", records.norm_word(F.col("w")).alias("norm"), records.to_theta(F.col("w")).alias("printed"))


_ROMAN = f"""WITH t AS (SELECT p_partkey, substr('IiV1UXlHB', 1 + CAST(p_partkey % 9 AS INT), 1) || substr('iI1', 1 + CAST(p_partkey // 9 % 3 AS INT), CAST(p_partkey % 4 AS INT)) AS tok FROM part), f AS (SELECT tok, {_sql_replace("tok", records.ROMAN_PAIRS)} AS col FROM t)
SELECT CASE WHEN col IN ({", ".join(f"'{c}'" for c in records.COLUMNS)}) THEN col END AS col, count(*) AS n, min(tok) AS first FROM f GROUP BY ALL"""


@query(_ROMAN)
def roman_columns(spark, sf):
    """Misread column numbers put right."""
    k = F.col("p_partkey")
    tok = F.concat(F.substr(F.lit("IiV1UXlHB"), (k % 9 + 1).cast("int"), F.lit(1)), F.substr(F.lit("iI1"), (F.floor(k / 9) % 3 + 1).cast("int"), (k % 4).cast("int")))
    t = load(spark, sf, "part").select(tok.alias("tok")).withColumn("col", records.fix_roman(F.col("tok")))
    return t.groupBy("col").agg(F.count("*").alias("n"), F.min("tok").alias("first"))


@query("""WITH r AS (SELECT event_type AS a, hour(ts) AS h FROM events)
SELECT CASE WHEN h % 3 = 0 THEN a ELSE CASE WHEN h % 3 = 1 THEN a || ':' || 'p[' ELSE a || chr(160) || a END END AS reading, count(*) AS n FROM r GROUP BY ALL""")
def displayed_readings(spark, sf):
    """Wiki values as they are displayed (F28): targets, second alternatives, controls and blanks."""
    a, h = F.col("event_type"), F.hour("ts")
    value = F.when(h % 3 == 0, F.concat(F.lit("target!"), a, F.lit("!other"))).when(h % 3 == 1, F.concat(a, F.lit(" :unknown!p[ !"))).otherwise(F.concat(a, F.lit(" space x!"), a))
    return load(spark, sf, "events").groupBy(records.clean_reading(value).alias("reading")).agg(F.count("*").alias("n"))


_CLASSES = (("DET", ("the", "la", "le"), ()), ("NEG", ("no", "not"), ("nicht",)), ("SH", ("this",), ("sh", "sch")))


@query(f"""WITH {TOK} SELECT CASE WHEN w IN ('the', 'la', 'le') THEN 'DET' WHEN w IN ('no', 'not') OR starts_with(w, 'nicht') THEN 'NEG' WHEN w = 'this' OR starts_with(w, 'sh') OR starts_with(w, 'sch') THEN 'SH' ELSE 'X' END AS class,
CASE WHEN i = 0 THEN 'init' WHEN i = n - 1 THEN 'fin' ELSE 'mid' END AS slot, count(*) AS n FROM tok GROUP BY ALL""")
def word_class_slots(spark, sf):
    """Word classes by a table of whole words and beginnings, by place in the record."""
    t = tokens.tokens(load(spark, sf, "documents"))
    return t.groupBy(records.ladder(F.col("w"), _CLASSES).alias("class"), text.slot_of(F.col("i"), F.col("n")).alias("slot")).agg(F.count("*").alias("n"))


@query(f"""WITH {REC}, g AS (SELECT doc_id, list_distinct(ws) AS ws, CASE WHEN source = 'src1' THEN 'ritual' WHEN list_has_any(ws, ['donc', 'auch']) THEN 'dedic' WHEN list_has_any(ws, ['she', 'ist']) THEN 'speaking' WHEN list_has_any(ws, ['the', 'der']) THEN 'epitaph' ELSE 'other' END AS genre FROM rec),
h AS (SELECT g.genre, coalesce(regexp_matches(d.text, '[0-9]'), false) AS has_num, len(g.ws) AS n FROM g JOIN documents d USING (doc_id))
SELECT genre, has_num, count(*) AS n_records, CAST(sum(n) AS BIGINT) AS n_occ, round(sum(n) / (SELECT sum(n) FROM h), 6) AS share FROM h GROUP BY ALL""")
def genre_baseline(spark, sf):
    """Genres by word sets in priority order, and how many words stand in records with numerals."""
    d = load(spark, sf, "documents").select("source", F.coalesce(F.rlike("text", F.lit("[0-9]")), F.lit(False)).alias("has_num"), F.array_distinct(text.words(F.col("text"))).alias("ws"))
    h = d.select(records.genre_of(F.col("ws"), GENRES, F.col("source") == "src1").alias("genre"), "has_num", F.size("ws").alias("n"))
    out = h.groupBy("genre", "has_num").agg(F.count("*").alias("n_records"), F.sum("n").alias("n_occ"))
    total = out.agg(F.sum("n_occ").alias("t"))  # one row
    return out.crossJoin(F.broadcast(total)).select("genre", "has_num", "n_records", "n_occ", F.round(F.col("n_occ") / F.col("t"), 6).alias("share"))


@query("""WITH p AS (SELECT p_type, list_transform(regexp_extract_all('''' || p_name || ''', ''' || p_type || '''', '''([^'']+)''', 1), lambda x: lower(x)) AS g, list_distinct(regexp_extract_all(lower(p_name), '[a-z]{3,}')) AS k FROM part)
SELECT p_type AS form, g[1] AS gloss, count(*) AS n, count(*) FILTER (len(list_filter(k, lambda x: contains(g[1], x) OR contains(g[2], x))) > 0) AS n_hit, count(*) FILTER (len(list_filter(k, lambda x: contains(g[2], x))) > 0) AS n_hit_second FROM p GROUP BY ALL""")
def quoted_glosses(spark, sf):
    """Glosses between quotes, and whether one has a word of the concept."""
    src = F.concat(F.lit("'"), F.col("p_name"), F.lit("', '"), F.col("p_type"), F.lit("'"))
    p = load(spark, sf, "part").select("p_type", "p_name", records.quoted(src).alias("g"))
    count = lambda c: F.sum(c.cast("long"))
    return p.groupBy(F.col("p_type").alias("form"), F.get("g", F.lit(0)).alias("gloss")).agg(
        F.count("*").alias("n"), count(records.gloss_hit(F.col("p_name"), F.col("g"))).alias("n_hit"), count(records.gloss_hit(F.col("p_name"), F.slice("g", 2, 1))).alias("n_hit_second"))


@query(f"""WITH {TYPES}, c AS (SELECT w, freq, {_CUT} AS suffix FROM types), s AS (SELECT suffix, left(w, len(w) - len(suffix)) AS stem, freq FROM c WHERE suffix IS NOT NULL)
SELECT suffix, count(*) AS n_covered, count(*) FILTER (stem IN (SELECT w FROM types)) AS n_decomposable, CAST(sum(freq) AS BIGINT) AS freq FROM s GROUP BY suffix""")
def decomposable_words(spark, sf):
    """Words that end in the longest of a set of endings, and those whose stem is a word too."""
    v = tokens.vocabulary(tokens.tokens(load(spark, sf, "documents")))
    s = v.withColumn("x", records.split_suffix(F.col("w"), ENDINGS)).where("x is not null").select("x.suffix", "x.stem", "freq")
    stems = v.select(F.col("w").alias("stem"), F.lit(1).alias("known"))
    out = s.join(stems, "stem", "left").groupBy("suffix").agg(F.count("*").alias("n_covered"), F.count("known").alias("n_decomposable"), F.sum("freq").alias("freq"))
    return out


_CUSTOMER = "c_custkey long, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string"


@query("SELECT c_mktsegment, count(*) AS n, round(sum(c_acctbal), 2) AS total, min(c_name) AS first FROM customer GROUP BY c_mktsegment")
def csv_round_trip(spark, sf):
    """A CSV sink of fixed columns and a scan of it."""
    at = files.scratch(spark, "customer.csv")
    files.write_csv(load(spark, sf, "customer"), at, [c.split()[0] for c in _CUSTOMER.split(", ")])
    return files.read_csv(spark, at, _CUSTOMER).groupBy("c_mktsegment").agg(F.count("*").alias("n"), F.round(F.sum("c_acctbal"), 2).alias("total"), F.min("c_name").alias("first"))


@query("""WITH o AS (SELECT o_custkey, o_orderkey, CASE WHEN o_orderkey % 3 <> 0 THEN o_orderpriority ELSE '' END AS et, o_orderstatus = 'F' AS closed, CASE WHEN o_orderkey % 2 = 0 THEN o_orderstatus ELSE ' ' END AS note FROM orders)
SELECT o_custkey, coalesce(arg_min(et, o_orderkey) FILTER (et <> ''), '') AS et, bool_or(closed) AS closed, coalesce(string_agg(note, ' ' ORDER BY o_orderkey) FILTER (trim(note) <> ''), '') AS notes FROM o GROUP BY o_custkey""")
def keyed_fold(spark, sf):
    """A scan with another delimiter, folded to a row a key: first non-empty, OR, notes joined."""
    o = load(spark, sf, "orders").select(
        "o_custkey", "o_orderkey", F.when(F.col("o_orderkey") % 3 != 0, F.col("o_orderpriority")).otherwise("").alias("et"), (F.col("o_orderstatus") == "F").alias("closed"),
        F.when(F.col("o_orderkey") % 2 == 0, F.col("o_orderstatus")).otherwise(" ").alias("note"),
    )
    at = files.scratch(spark, "burman.csv")
    files.write_csv(o, at, o.columns, sep=";")
    back = files.read_csv(spark, at, "o_custkey long, o_orderkey long, et string, closed boolean, note string", sep=";")
    return files.fold_keyed(back, "o_custkey", "o_orderkey", ("et",), ("closed",), ("note",)).select("o_custkey", F.coalesce("et", F.lit("")).alias("et"), "closed", F.col("note").alias("notes"))


@query("SELECT CAST(n_regionkey AS VARCHAR) AS file_key, count(*) AS n, min(n_name) AS first FROM nation GROUP BY n_regionkey")
def folder_scan(spark, sf):
    """A scan of a folder of CSV files, errata files left out, needed cells checked (S3)."""
    at = files.scratch(spark, "supplements")
    n = load(spark, sf, "nation")
    n.withColumn("part", F.concat(F.lit("supp_"), F.col("n_regionkey").cast("string"))).write.partitionBy("part").csv(at, header=True)
    n.limit(3).write.csv(f"{at}/part=errata_x", header=True)
    df = files.scan_folder(spark, f"{at}/*/*.csv", "n_nationkey int, n_name string, n_regionkey int", ("n_nationkey", "n_name"))
    df = df.withColumn("folder", F.element_at(F.split("_metadata.file_path", "/"), -2)).where(~F.contains("folder", F.lit("errata_")))
    return df.groupBy(F.regexp_extract("folder", r"supp_(\d+)", 1).alias("file_key")).agg(F.count("*").alias("n"), F.min("n_name").alias("first"))


@query("""WITH u AS (SELECT 'DOC' AS src, CAST(doc_id AS VARCHAR) AS eid, text AS raw, lang FROM documents UNION ALL SELECT 'CONV', conv_id || '.' || turn, text, NULL FROM conversations UNION ALL SELECT 'BENCH', CAST(item_id AS VARCHAR), text, NULL FROM benchmark)
SELECT src, count(*) AS n, count(DISTINCT eid) AS n_ids, count(lang) AS n_lang, CAST(sum(len(raw)) AS BIGINT) AS chars FROM u GROUP BY src""")
def source_union(spark, sf):
    """Records of three sources in one schema, each by its own projection."""
    c = lambda x: F.col(x).cast("string")
    u = files.union_sources({
        "DOC": load(spark, sf, "documents").select(c("doc_id").alias("eid"), F.col("text").alias("raw"), "lang"),
        "CONV": load(spark, sf, "conversations").select(F.concat_ws(".", c("conv_id"), c("turn")).alias("eid"), F.col("text").alias("raw")),
        "BENCH": load(spark, sf, "benchmark").select(c("item_id").alias("eid"), F.col("text").alias("raw")),
    })
    return u.groupBy("src").agg(F.count("*").alias("n"), F.count_distinct("eid").alias("n_ids"), F.count("lang").alias("n_lang"), F.sum(F.length("raw")).alias("chars"))


@query("SELECT event_type, count(*) AS n, CAST(sum(CAST(json_extract_string(props, '$.k') AS BIGINT)) AS BIGINT) AS k FROM events GROUP BY event_type")
def json_round_trip(spark, sf):
    """A JSON-lines sink with sorted keys and a scan of it with a schema."""
    at = files.scratch(spark, "events.jsonl")
    files.write_json(load(spark, sf, "events").select("event_type", "props", "event_id"), at)
    back = files.read_json(spark, at, "event_id long, event_type string, props string").withColumn("k", F.from_json("props", "k long")["k"])
    return back.groupBy("event_type").agg(F.count("*").alias("n"), F.sum("k").alias("k"))


@query("SELECT r_regionkey + 1 AS line_no, r_regionkey || ' ' || r_name AS line FROM region")
def text_log(spark, sf):
    """A text log written in order and read back."""
    at = files.scratch(spark, "run.log")
    files.write_log(load(spark, sf, "region").select(F.col("r_regionkey").alias("i"), F.concat_ws(" ", F.col("r_regionkey").cast("string"), "r_name").alias("line")), at)
    lines = spark.read.text(at).withColumn("line_no", F.substring_index("value", " ", 1).cast("int") + 1)
    return lines.select("line_no", F.col("value").alias("line"))


@query("SELECT n_name AS title, 'region ' || n_regionkey AS place, n_nationkey AS num FROM nation")
def xml_scan(spark, sf):
    """Fields of small XML files in a folder tree."""
    at = files.scratch(spark, "epidoc")
    body = F.format_string("<TEI><title type=\"main\">%s</title>\n<place>region <b>%d</b></place><num>%d</num></TEI>", "n_name", "n_regionkey", "n_nationkey")
    load(spark, sf, "nation").select(body.alias("value")).write.option("maxRecordsPerFile", 1).text(f"{at}/a/b")
    x = files.scan_xml(spark, at)
    return x.select(files.xml_field(F.col("text"), "title").alias("title"), files.xml_field(F.col("text"), "place").alias("place"), files.xml_field(F.col("text"), "num").try_cast("int").alias("num"))


@query("SELECT s_suppkey, s_name AS name, 'nation ' || s_nationkey || ' more' AS place, 4 AS n_fields FROM supplier")
def template_lines(spark, sf):
    """A wiki template's parameters, with values that go on in the next line."""
    t = F.format_string("{{inscription\n| name = %s\n|place=nation %d\n more\n| empty =\n|note=a=b\n| name = again}}", "s_name", "s_nationkey")
    s = load(spark, sf, "supplier").select("s_suppkey", files.template_fields(t).alias("m"))
    return s.select("s_suppkey", F.col("m")["name"].alias("name"), F.col("m")["place"].alias("place"), F.size("m").alias("n_fields"))


@query("SELECT n_regionkey AS page, n_nationkey AS num, n_name AS name FROM nation")
def table_rows(spark, sf):
    """Cells of HTML tables."""
    row = F.format_string("<tr class=\"x\"><td>%d</td>\n<th><a href=\"#\">%s</a> </th></tr>", "n_nationkey", "n_name")
    pages = load(spark, sf, "nation").groupBy("n_regionkey").agg(F.concat(F.lit("<table>"), F.array_join(F.collect_list(row), ""), F.lit("</table>")).alias("html"))
    cells = pages.select(F.col("n_regionkey").alias("page"), F.explode(files.table_cells(F.col("html"))).alias("c"))
    return cells.select("page", F.get("c", F.lit(0)).cast("int").alias("num"), F.get("c", F.lit(1)).alias("name"))


@query("""WITH e AS (SELECT user_id, event_id, value, value - lag(value) OVER (PARTITION BY user_id ORDER BY value, event_id) > 3.5 AS cut FROM events WHERE value IS NOT NULL),
b AS (SELECT *, sum(coalesce(cut, false)::INT) OVER (PARTITION BY user_id ORDER BY value, event_id) AS band FROM e), s AS (SELECT user_id, band, count(*) AS c FROM b GROUP BY ALL)
SELECT user_id, count(*) AS n_bands, max(c) AS largest FROM s GROUP BY user_id""")
def layout_bands(spark, sf):
    """Words of a page gathered into lines where neighbours' heights differ by 3.5 or less."""
    by = Window.partitionBy("user_id").orderBy("value", "event_id")
    e = load(spark, sf, "events").where("value is not null").withColumn("cut", F.coalesce(F.col("value") - F.lag("value").over(by) > 3.5, F.lit(False)))
    b = e.withColumn("band", F.sum(F.col("cut").cast("int")).over(by))
    return b.groupBy("user_id", "band").agg(F.count("*").alias("c")).groupBy("user_id").agg(F.count("*").alias("n_bands"), F.max("c").alias("largest"))


@query("""WITH l AS (SELECT o_custkey AS page, o_orderkey AS i, o_orderstatus = 'F' AS head, o_orderpriority AS p, o_totalprice AS x FROM orders),
f AS (SELECT page, i, head, last_value(CASE WHEN head THEN p END IGNORE NULLS) OVER (PARTITION BY page ORDER BY i) AS col FROM l)
SELECT col, count(*) AS n, min(i) AS first, CAST(sum(i) AS BIGINT) AS total FROM f WHERE NOT head GROUP BY col""")
def apparatus_lines(spark, sf):
    """Apparatus lines `N lemma ] note` under the last column header before them."""
    text_ = F.when(F.col("o_orderstatus") == "F", F.concat(F.lit("# "), "o_orderpriority")).otherwise(F.format_string(" %d some lemma ] note %s", "o_orderkey", "o_orderstatus"))
    l = load(spark, sf, "orders").select(F.col("o_custkey").alias("page"), F.col("o_orderkey").alias("i"), text_.alias("line"))
    by = Window.partitionBy("page").orderBy("i")
    head = F.when(F.startswith("line", F.lit("# ")), F.substr("line", F.lit(3)))
    f = l.withColumn("col", F.last(head, ignorenulls=True).over(by)).withColumn("x", records.apparatus(F.col("line"))).where("x is not null and x.lemma = 'some lemma'")
    return f.groupBy("col").agg(F.count("*").alias("n"), F.min("x.n").cast("long").alias("first"), F.sum(F.col("x.n").cast("long")).alias("total"))


@query("""WITH c AS (SELECT unnest(['I', 'II', 'IX']) AS col, unnest(range(3)) AS j), e AS (SELECT p_partkey, col, unnest([p_size + j, p_size * 2]) AS line, p_brand FROM part, c)
SELECT p_brand AS head, col, count(*) AS n, CAST(sum(line) AS BIGINT) AS lines FROM e GROUP BY ALL""")
def index_entries(spark, sf):
    """References of index entries: each line number with its column."""
    s = F.col("p_size")
    parts = [x for j, col in enumerate(("I", "II", "IX")) for x in (F.lit(f" {col} "), (s + j).cast("string"), F.lit(", "), (s * 2).cast("string"), F.lit(";"))]
    e = load(spark, sf, "part").select(F.explode(records.index_entry(F.concat("p_brand", *parts))).alias("x")).select("x.*")
    return e.groupBy("head", "col").agg(F.count("*").alias("n"), F.sum(F.col("line").cast("long")).alias("lines"))


@query("""WITH l AS (SELECT doc_id, source, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS i FROM documents), k AS (SELECT source, i // 40 AS page, regexp_extract(line, '^(\\S+)', 1) AS key, line FROM l),
r AS (SELECT source, key, count(*) AS n, max(page) AS last_page, max(len(line)) AS longest FROM k WHERE key <> '' GROUP BY ALL HAVING count(*) >= 20)
SELECT r.*, (SELECT min(k.line) FROM k WHERE k.source = r.source AND k.key = r.key AND len(k.line) = r.longest) AS line FROM r""")
def longest_lines(spark, sf):
    """Page lines by their key, the longest reading of each, ties to the smaller."""
    l = load(spark, sf, "documents").select("source", F.posexplode(F.split("text", "\n")).alias("i", "line"))
    k = l.select("source", F.floor(F.col("i") / 40).cast("long").alias("page"), F.regexp_extract("line", r"^(\S+)", 1).alias("key"), "line").where("key <> ''")
    out = k.groupBy("source", "key").agg(F.count("*").alias("n"), F.max("page").alias("last_page"), F.min(F.struct((-F.length("line")).alias("m"), "line")).alias("best"))
    return out.where("n >= 20").select("source", "key", "n", "last_page", (-F.col("best.m")).cast("long").alias("longest"), F.col("best.line").alias("line"))


@query()
def healed_rows(spark, sf):
    """Numbered rows with torn numbers rejoined (S16): an ordered fold over a page's short array; tested on known rows."""
    e = load(spark, sf, "events").where("user_id is not null")
    n = F.pmod(F.col("event_id"), F.lit(1000)).cast("int")
    torn = (F.col("event_id") % 7 == 0) & (n >= 100)
    row = F.struct(F.when(torn, F.floor(n / 10).cast("int")).otherwise(n).alias("num"), F.when(torn, (n % 10).cast("int")).otherwise(1).alias("line"), F.when(torn, "2 text").otherwise("text").alias("text"))
    pages = e.groupBy("user_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("event_id", row.alias("r")))), lambda s: s["r"]).alias("rows"))
    return pages.select("user_id", F.size("rows").alias("n_rows"), records.healed(F.col("rows")).alias("h")).select("user_id", "n_rows", F.size("h").alias("n_kept"), F.size(F.filter("h", lambda r: r["line"] == 2)).alias("n_healed"))


@query(r"""WITH s AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS t, unnest(range(len(string_split(text, chr(10))))) AS i FROM documents), k AS (SELECT doc_id, i, t, len(regexp_extract(t, '^(\S+)', 1)) AS id FROM s),
f AS (SELECT *, row_number() OVER (PARTITION BY doc_id, id ORDER BY i) AS r FROM k WHERE id BETWEEN 2 AND 9)
SELECT id, count(*) AS n, CAST(sum(len(t)) AS BIGINT) AS chars FROM f WHERE r = 1 GROUP BY id""")
def first_segments(spark, sf):
    """Segments of a text, the first of each id in a range."""
    s = load(spark, sf, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("i", "t")).withColumn("id", F.length(F.regexp_extract("t", r"^(\S+)", 1)))
    f = s.where("id between 2 and 9").groupBy("doc_id", "id").agg(F.min(F.struct("i", "t")).alias("f"))
    return f.groupBy(F.col("id").cast("long").alias("id")).agg(F.count("*").alias("n"), F.sum(F.length("f.t")).alias("chars"))


@query(r"""SELECT regexp_extract(url, '\.example\.com/([a-z]{2})/', 1) AS lang, contains(url, '?') AS has_query, count(*) AS n, CAST(sum(len(regexp_extract_all(html, '<p>'))) AS BIGINT) AS n_par,
CAST(sum(coalesce(TRY_CAST(regexp_extract(url, 'page=([0-9]+)', 1) AS INT), 0)) AS BIGINT) AS pages FROM pages GROUP BY ALL""")
def page_facts(spark, sf):
    """Facts by pattern: an id, a number, a presence, a count."""
    p = load(spark, sf, "pages").groupBy(F.regexp_extract("url", r"\.example\.com/([a-z]{2})/", 1).alias("lang"), F.contains("url", F.lit("?")).alias("has_query"))
    number = F.coalesce(F.regexp_extract("url", "page=([0-9]+)", 1).try_cast("int"), F.lit(0))
    return p.agg(F.count("*").alias("n"), F.sum(F.coalesce(F.regexp_count("html", F.lit("<p>")), F.lit(0))).cast("long").alias("n_par"), F.sum(number).alias("pages"))


@query("""WITH r AS (SELECT user_id || ':' || event_type AS key, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS k FROM events), i AS (SELECT key || CASE WHEN k > 1 THEN '#' || k ELSE '' END AS rid, k FROM r)
SELECT count(*) AS n_rows, count(DISTINCT rid) AS n_ids, count(*) FILTER (k > 1) AS n_suffixed, max(rid) AS last FROM i""")
def record_ids(spark, sf):
    """Unique record ids: a number behind keys that repeat."""
    by = Window.partitionBy("user_id", "event_type").orderBy("ts", "event_id")
    r = load(spark, sf, "events").select(F.concat_ws(":", F.col("user_id").cast("string"), "event_type").alias("key"), F.row_number().over(by).alias("k"))
    r = r.select("k", F.concat("key", F.when(F.col("k") > 1, F.concat(F.lit("#"), F.col("k").cast("string"))).otherwise("")).alias("rid"))
    per = r.groupBy("rid").agg(F.count("*").alias("c"), F.sum((F.col("k") > 1).cast("long")).alias("s"))
    return per.agg(F.sum("c").alias("n_rows"), F.count("*").alias("n_ids"), F.sum("s").alias("n_suffixed"), F.max("rid").alias("last"))


@query("""WITH p AS (SELECT user_id, CAST(ts AS DATE) AS page, event_id, event_type = 'purchase' AS known FROM events), r AS (SELECT *, min(event_id) FILTER (known) OVER (PARTITION BY user_id, page) AS a, max(event_id) FILTER (known) OVER (PARTITION BY user_id, page) AS b FROM p)
SELECT user_id, page, a, b, count(*) FILTER (NOT known AND event_id BETWEEN a AND b) AS n_inside, count(*) FILTER (NOT known) AS n_unknown FROM r WHERE a IS NOT NULL GROUP BY ALL""")
def page_ranges(spark, sf):
    """The range of a page's known numbers, and the unknown rows inside it."""
    by = Window.partitionBy("user_id", "page")
    p = load(spark, sf, "events").select("user_id", F.to_date("ts").alias("page"), "event_id", (F.col("event_type") == "purchase").alias("known"))
    known = F.when(F.col("known"), F.col("event_id"))
    p = p.withColumn("a", F.min(known).over(by)).withColumn("b", F.max(known).over(by)).where("a is not null")
    count = lambda c: F.sum(c.cast("long"))
    return p.groupBy("user_id", "page", "a", "b").agg(count(~F.col("known") & F.col("event_id").between(F.col("a"), F.col("b"))).alias("n_inside"), count(~F.col("known")).alias("n_unknown"))


@query("""WITH s AS (SELECT l_linenumber AS col, l_partkey, epoch(l_shipdate - TIMESTAMP '1992-01-01') // 86400 - l_partkey AS off, l_partkey AS line FROM lineitem), m AS (SELECT col, quantile_cont(off, 0.5) AS offset_median, max(line) AS last FROM s GROUP BY col)
SELECT m.col, round(offset_median, 3) AS offset_median, last, count(*) FILTER (abs(off - offset_median) <= 100) AS n_promoted FROM s JOIN m ON s.col = m.col GROUP BY ALL""")
def column_offsets(spark, sf):
    """A column's median offset and last line, and the rows that the offset model places."""
    off = F.date_diff(F.to_date("l_shipdate"), F.lit("1992-01-01").cast("date")) - F.col("l_partkey")
    s = load(spark, sf, "lineitem").select(F.col("l_linenumber").alias("col"), off.alias("off"), F.col("l_partkey").alias("line"))
    m = s.groupBy("col").agg(F.percentile("off", F.lit(0.5)).alias("offset_median"), F.max("line").alias("last"))  # a few columns
    out = s.join(F.broadcast(m), "col").groupBy("col", "offset_median", "last").agg(F.sum((F.abs(F.col("off") - F.col("offset_median")) <= 100).cast("long")).alias("n_promoted"))
    return out.withColumn("offset_median", F.round("offset_median", 3))


@query(f"""WITH {TOK}, t AS (SELECT w, regexp_replace(w, '[^\\p{{L}}]+', '', 'g') AS squashed, regexp_replace(replace(replace(replace(replace(replace(w, 'a', ''), 'e', ''), 'i', ''), 'o', ''), 'u', ''), '$', '') AS bare, count(*) AS freq FROM tok GROUP BY w)
SELECT a.bare AS skeleton, count(*) AS n_pairs, min(a.w) AS first FROM t a JOIN t b ON a.bare = b.bare AND a.w < b.w GROUP BY a.bare""")
def soft_pairs(spark, sf):
    """Words that are equal without vowels (F10, F19): pairs are counted from the size of a skeleton's set."""
    v = tokens.vocabulary(tokens.tokens(load(spark, sf, "documents"))).select(text.letters_only(F.col("w")).alias("w"))
    g = v.groupBy(F.translate("w", "aeiou", "").alias("skeleton")).agg(F.count("*").alias("c"), F.min("w").alias("first")).where("c > 1")
    return g.select("skeleton", F.expr("c * (c - 1) div 2").alias("n_pairs"), "first")


@query(f"""WITH {TOK}, l AS (SELECT source, left(w, 2) AS cls, count(*) AS c FROM tok GROUP BY ALL), t AS (SELECT cls, sum(c) AS t FROM l GROUP BY cls)
SELECT CASE WHEN t < 2000 THEN 'OTHER' ELSE cls END AS cls, count(DISTINCT source) AS n_sources, CAST(sum(c) AS BIGINT) AS n FROM l JOIN t USING (cls) GROUP BY 1""")
def folded_classes(spark, sf):
    """Classes of fewer than 2000 tokens folded into one."""
    l = tokens.tokens(load(spark, sf, "documents"), "source").groupBy("source", F.left("w", F.lit(2)).alias("cls")).agg(F.count("*").alias("c"))
    small = l.groupBy("cls").agg(F.sum("c").alias("t")).select("cls", (F.col("t") < 2000).alias("rare"))
    f = l.join(small, "cls").groupBy(F.when(F.col("rare"), "OTHER").otherwise(F.col("cls")).alias("cls"), "source").agg(F.sum("c").alias("c"))
    return f.groupBy("cls").agg(F.count("*").alias("n_sources"), F.sum("c").alias("n"))


@query(f"""WITH {TYPES}, a AS (SELECT w, freq, {_sql_replace("w", text.ASCII_PAIRS).replace("'''", "''''")} AS a FROM types) SELECT a AS ascii, count(*) AS n_forms, CAST(sum(freq) AS BIGINT) AS n FROM a GROUP BY a HAVING sum(freq) >= 100""")
def ascii_forms(spark, sf):
    """Forms by their ASCII transliteration."""
    v = tokens.vocabulary(tokens.tokens(load(spark, sf, "documents")))
    return v.groupBy(text.to_ascii(F.col("w")).alias("ascii")).agg(F.count("*").alias("n_forms"), F.sum("freq").alias("n")).where("n >= 100")


_STEM_SQL = ", ".join(f"CASE WHEN w LIKE '%{e}' AND len(w) >= {len(e) + 3} THEN left(w, len(w) - {len(e)}) END" for e in text.CASE_ENDINGS)


@query(f"""WITH {TYPES}, s AS (SELECT w, len(list_distinct([w, {_STEM_SQL}])) AS n FROM types) SELECT n AS n_stems, count(*) AS n_words, min(w) AS first FROM s GROUP BY n""")
def stem_counts(spark, sf):
    """How many stems the case endings leave of each word."""
    v = tokens.vocabulary(tokens.tokens(load(spark, sf, "documents"))).select("w", F.size(text.all_stems(F.col("w"))).alias("n_stems"))
    return v.groupBy("n_stems").agg(F.count("*").alias("n_words"), F.min("w").alias("first"))


@query(f"""WITH {TYPES}, f AS (SELECT w, freq, translate(lower(w), 'cqśšσςê', 'kksssse') AS m FROM types) SELECT m AS minimal, count(*) AS n_strict, CAST(sum(freq) AS BIGINT) AS freq FROM f GROUP BY m HAVING count(*) > 1""")
def folded_words(spark, sf):
    """Words that differ as read but not when letters of one sound are merged."""
    v = tokens.vocabulary(tokens.tokens(load(spark, sf, "documents"))).select(text.fold(F.col("w")).alias("strict"), text.fold(F.col("w"), "minimal").alias("minimal"), "freq")
    s = v.groupBy("minimal", "strict").agg(F.sum("freq").alias("freq"))
    return s.groupBy("minimal").agg(F.count("*").alias("n_strict"), F.sum("freq").alias("freq")).where("n_strict > 1")


@query(f"""WITH {TOK}, c AS (SELECT lang, CASE {" ".join(f"WHEN w = '{w}' THEN 'OP:{g}'" for w, g in OPERATORS.items())} WHEN w LIKE '%al' AND len(w) > 4 OR w LIKE '%as' AND len(w) > 4 OR w LIKE '%us' AND len(w) > 4 THEN 'GEN?' ELSE 'X' END AS slot, CASE WHEN i = 0 THEN 'init' WHEN i = n - 1 THEN 'fin' ELSE 'mid' END AS place FROM tok)
SELECT lang, slot, place, count(*) AS n FROM c GROUP BY ALL""")
def token_slots(spark, sf):
    """Slot classes of tokens by place."""
    t = tokens.tokens(load(spark, sf, "documents"), "lang")
    return t.groupBy("lang", text.slot_class(F.col("w"), F.lit("W"), OPERATORS).alias("slot"), text.slot_of(F.col("i"), F.col("n")).alias("place")).agg(F.count("*").alias("n"))


@query("""WITH p AS (SELECT p_partkey % 4 AS m, p_size % 7 + 1 AS a, greatest(p_size % 7 + 1 - p_partkey % 3, 1) AS b, p_partkey % 2 = 0 AS two FROM part)
SELECT CASE m WHEN 1 THEN a * 100 WHEN 2 THEN (a - 1) * 100 + 25 WHEN 3 THEN a * 100 - 25 ELSE a * 100 END AS y_from,
CASE WHEN two THEN (b - 1) * 100 + 1 ELSE CASE m WHEN 1 THEN a * 100 - 24 WHEN 2 THEN (a - 1) * 100 + 1 WHEN 3 THEN (a - 1) * 100 + 26 ELSE (a - 1) * 100 + 1 END END AS y_to, count(*) AS n FROM p GROUP BY ALL""")
def century_spans(spark, sf):
    """Latin century phrases as years."""
    roman = F.array(*map(F.lit, ("I", "II", "III", "IV", "V", "VI", "VII")))
    k, a = F.col("p_partkey"), F.col("p_size") % 7 + 1
    b = F.greatest(a - k % 3, F.lit(1)).cast("int")
    mod = F.element_at(F.array(F.lit(""), F.lit("ineunti "), F.lit("exeunti "), F.lit("medio ")), (k % 4 + 1).cast("int"))
    phrase = F.concat(mod, F.element_at(roman, a), F.when(k % 2 == 0, F.concat(F.lit(" - "), F.element_at(roman, b))).otherwise(""), F.lit(" saec. a. Chr."))
    y = load(spark, sf, "part").select(text.century_years(phrase).alias("y"))
    return y.groupBy(F.col("y.y_from").cast("long").alias("y_from"), F.col("y.y_to").cast("long").alias("y_to")).agg(F.count("*").alias("n"))


@query("""SELECT CASE p_partkey % 6 WHEN 0 THEN 'NAME-M' WHEN 1 THEN 'NAME-F' WHEN 2 THEN 'THEO' WHEN 3 THEN 'KIN' WHEN 4 THEN 'VERB' ELSE 'OTHER' END AS cls, count(*) AS n FROM part GROUP BY ALL""")
def gloss_classes(spark, sf):
    """Classes of glosses by patterns in order."""
    k, name = F.col("p_partkey") % 6, F.col("p_type")
    g = F.when(k == 0, F.concat(F.lit("mr-"), name, F.lit(" and mrs-x the god"))).when(k == 1, F.concat(F.lit("ms-x and mr-"), name)).when(k == 2, F.concat(F.lit("a deity or son of "), name)).when(k == 3, F.concat(F.lit("son of one who gave "), name))
    return load(spark, sf, "part").groupBy(text.gloss_class(g.when(k == 4, F.concat(name, F.lit(" was here"))).otherwise(F.lit("a thing"))).alias("cls")).agg(F.count("*").alias("n"))


@query("""SELECT s_suppkey, upper(regexp_replace(s_name, '[^A-Za-z]', '-', 'g')) || ' [---] AB ś' AS clean FROM supplier""")
def cleaned_ocr_lines(spark, sf):
    """OCR lines in the conventions of marked text."""
    line = F.concat(F.lit("{latin} "), "s_name", F.lit("~ab  ( T)"))
    return load(spark, sf, "supplier").select("s_suppkey", records.pre_clean(line, "•[]<>() -").alias("clean"))


@query("""SELECT event_type || ' z ' || event_type AS line, count(*) AS n FROM events GROUP BY ALL""")
def glued_remnants(spark, sf):
    """One-letter remnants of torn words joined where the join is a known form."""
    kinds = ("click", "error", "purchase", "signup", "view", "login", "logout", "search")
    known = F.create_map(*[x for w in kinds for x in (F.lit(w), F.lit(True))])
    e = F.col("event_type")
    parts = F.array(F.left(e, F.length(e) - 1), F.right(e, F.lit(1)), F.lit("z"), e)
    return load(spark, sf, "events").groupBy(F.array_join(records.glue(parts, known), " ").alias("line")).agg(F.count("*").alias("n"))


@query(f"""WITH {TOK}, p AS (SELECT source, w, lead(w) OVER (PARTITION BY doc_id ORDER BY i) AS b FROM tok)
SELECT source, b AS kin, count(*) AS n, count(DISTINCT w) AS n_forms FROM p WHERE b IN ('the', 'de', 'la', 'der') AND regexp_matches(w, '(al|as|us|s)$') AND len(w) >= 5 GROUP BY ALL""")
def filiation_patterns(spark, sf):
    """A genitive-like word before one of the kin words, here frequent articles (A33): pairs from a record's array."""
    ws = load(spark, sf, "documents").select("source", text.words(F.col("text")).alias("ws")).where(F.size("ws") > 1)
    pairs = F.arrays_zip(F.slice("ws", F.lit(1), F.size("ws") - 1).alias("w"), F.slice("ws", F.lit(2), F.size("ws") - 1).alias("b"))
    p = ws.select("source", F.explode(pairs).alias("p")).select("source", "p.w", "p.b").where(F.col("b").isin("the", "de", "la", "der") & F.rlike("w", F.lit("(al|as|us|s)$")) & (F.length("w") >= 5))
    per = p.groupBy("source", "b", "w").agg(F.count("*").alias("c"))
    return per.groupBy("source", F.col("b").alias("kin")).agg(F.sum("c").alias("n"), F.count("*").alias("n_forms"))
