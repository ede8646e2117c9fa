"""The registered queries of the text operators, and SQL for those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontaminate, html, jaccard, linededup, lsm, merkle, packing, pieces, quality, suffixes, topk, warc, whitening
from .common import Store


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two distinct sampled segmentations of every text, with inclusion scores and the decoding's verdict."""
    out = pieces.sample(_table(spark, sf_dir, "documents"), k=2)
    return out.select("doc_id", "sample", F.size("ids").alias("n_pieces"), F.round("log_prob", 3).alias("log_prob"), F.round("log_inclusion", 3).alias("log_inclusion"), "exact", F.xxhash64("ids").alias("ids_hash"))


def op2_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each 20th vector's 20 highest inner products over all other vectors."""
    v = topk.quantised(_table(spark, sf_dir, "embeddings"), "vec_id", "embedding")
    out = topk.exact_topk(v, v.where("id % 20 = 0"), 20)
    return out


OP2_SQL = """
WITH v AS (SELECT vec_id AS id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings),
s AS (SELECT q.id AS query_id, c.id AS vec_id, CAST(list_inner_product(CAST(q.v AS DOUBLE[]), CAST(c.v AS DOUBLE[])) AS BIGINT) AS score
      FROM v q JOIN v c ON q.id <> c.id WHERE q.id % 20 = 0)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= 20
"""


def op3_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each document keeps without 400-byte strings that occur elsewhere."""
    out = suffixes.dedup(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"), "n_repeated")


def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each document keeps without 20-word windows that start earlier."""
    out = lsm.dedup(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))


OP4_SQL = r"""
WITH w AS (SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
s AS (SELECT doc_id, unnest(range(1, greatest(len(w) - 18, 1))) AS i, w FROM w),
k AS (SELECT doc_id, i, array_to_string(w[i:i+19], ' ') AS t FROM s),
g AS (SELECT doc_id, i, row_number() OVER (PARTITION BY t ORDER BY doc_id, i) AS r FROM k),
gone AS (SELECT DISTINCT doc_id, i + unnest(range(0, 20)) AS i FROM g WHERE r > 1),
x AS (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS i FROM w),
a AS (SELECT x.doc_id, count(*) AS n_words, count(gone.i) AS n_removed, coalesce(string_agg(word, ' ' ORDER BY x.i) FILTER (gone.i IS NULL), '') AS kept
      FROM x LEFT JOIN gone ON x.doc_id = gone.doc_id AND x.i = gone.i GROUP BY x.doc_id)
SELECT doc_id, coalesce(n_words, 0) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM documents LEFT JOIN a USING (doc_id)
"""


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Writes the pages as archives with revisit records and reads them back."""
    pages = _table(spark, sf_dir, "pages")
    at = Store(spark).path("warc")
    warc.write(pages, warc.resolve(warc.headers(pages)), at)
    return warc.read(spark, at).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


OP5_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages), d AS (SELECT *, sha1(html) AS sha FROM p),
b AS (SELECT page_id, strlen(html) AS payload_bytes, max(page_id) OVER (PARTITION BY html) AS last,
      array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST(((CAST('0x' || substr(sha, (i // 4) * 5 + 1, 5) AS BIGINT) >> (15 - 5 * (i % 4))) & 31) + 1 AS INTEGER), 1)), '') AS payload_digest FROM d)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id < last THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN page_id < last THEN last END AS refers_to FROM b
"""


def op6_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of every page."""
    return html.extract(_table(spark, sf_dir, "pages"))


def op7_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document's component of near duplicates."""
    return jaccard.linked(_table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "n_shingles", "component_id")


OP7_SQL = """
WITH RECURSIVE dw AS (SELECT doc_id, {words} AS w FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(list_transform(range(1, greatest(len(w) - 2, CASE WHEN len(w) > 0 THEN 2 ELSE 1 END)), lambda i: array_to_string(w[i:i+3], ' '))) AS s FROM dw),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id), j AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM s x JOIN s y ON x.s = y.s AND x.doc_id <> y.doc_id GROUP BY ALL),
e AS (SELECT j.a, j.b FROM j JOIN n p ON p.doc_id = j.a JOIN n q ON q.doc_id = j.b WHERE 100 * c >= 85 * (p.n + q.n - c)),
r(id, root) AS (SELECT doc_id, doc_id FROM documents UNION SELECT e.b, r.root FROM r JOIN e ON e.a = r.id)
SELECT r.id AS doc_id, coalesce(any_value(n.n), 0) AS n_shingles, min(root) AS component_id FROM r LEFT JOIN n ON n.doc_id = r.id GROUP BY r.id
"""


def op8_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of documents and the benchmark items that they contain."""
    return decontaminate.contained(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


_DUCK_WORDS = r"list_filter(regexp_split_to_array(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda w: w <> '')"

OP7_SQL = OP7_SQL.replace("{words}", _DUCK_WORDS)

OP8_SQL = f"""
WITH dw AS (SELECT doc_id, {_DUCK_WORDS} AS w FROM documents), iw AS (SELECT item_id, {_DUCK_WORDS} AS w FROM benchmark),
ds AS (SELECT DISTINCT doc_id, unnest(list_transform(range(1, greatest(len(w) - 3, CASE WHEN len(w) > 0 THEN 2 ELSE 1 END)), lambda i: array_to_string(w[i:i+4], ' '))) AS s FROM dw),
its AS (SELECT DISTINCT item_id, unnest(list_transform(range(1, greatest(len(w) - 3, CASE WHEN len(w) > 0 THEN 2 ELSE 1 END)), lambda i: array_to_string(w[i:i+4], ' '))) AS s FROM iw),
q AS (SELECT item_id, count(*) AS n_item FROM its GROUP BY item_id),
c AS (SELECT doc_id, item_id, count(*) AS n_common FROM ds JOIN its USING (s) GROUP BY doc_id, item_id)
SELECT doc_id, item_id, n_item, n_common, round(n_common / n_item, 6) AS containment FROM c JOIN q USING (item_id) WHERE n_common * 100 >= n_item * 80
"""


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each document keeps when later copies of repeated line runs go."""
    out = linededup.dedup(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    copy = [F.col(f"copy.{x}").cast("long").alias(name) for x, name in (("lines", "copy_lines"), ("at", "copy_at"), ("first_doc_id", "copy_doc_id"), ("first_line", "copy_line"))]
    return out.select("doc_id", "n_lines", "n_deleted", "n_runs", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"), *copy)


OP9_SQL = r"""
WITH RECURSIVE l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS i FROM documents WHERE doc_id IS NOT NULL),
p AS (SELECT *, lead(line) OVER (PARTITION BY doc_id ORDER BY i) AS line2, lead(i) OVER (PARTITION BY doc_id ORDER BY i) AS i2 FROM l),
w AS (SELECT doc_id, i, min(struct_pack(d := doc_id, i := i)) OVER (PARTITION BY line, line2) AS first FROM p
      WHERE i2 IS NOT NULL AND (regexp_matches(line, '[^ 	-
]') OR regexp_matches(line2, '[^ 	-
]'))),
g AS (SELECT doc_id, i, min(struct_pack(d := doc_id, i := i)) OVER (PARTITION BY line) AS first FROM l WHERE len(regexp_extract_all(line, '[^ 	-
]+')) >= 50),
cl(m, doc_id, i, first) AS (SELECT CAST(2 AS BIGINT), doc_id, CAST(i AS BIGINT), first FROM w
      UNION ALL SELECT 2 * m, doc_id, i, min(struct_pack(d := doc_id, i := i)) OVER (PARTITION BY first, nxt)
      FROM (SELECT *, first_value(first) OVER (PARTITION BY doc_id ORDER BY i RANGE BETWEEN m FOLLOWING AND m FOLLOWING) AS nxt FROM cl) WHERE nxt IS NOT NULL),
cp AS (SELECT doc_id, m, i, first FROM cl WHERE struct_pack(d := doc_id, i := i) > first UNION ALL SELECT doc_id, 1, i, first FROM g WHERE struct_pack(d := doc_id, i := i) > first),
lc AS (SELECT * FROM cp QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY m DESC, i) = 1),
gone AS (SELECT doc_id, i FROM w WHERE struct_pack(d := doc_id, i := i) > first UNION SELECT doc_id, i + 1 FROM w WHERE struct_pack(d := doc_id, i := i) > first
         UNION SELECT doc_id, i FROM g WHERE struct_pack(d := doc_id, i := i) > first),
f AS (SELECT l.*, gone.i IS NOT NULL AS dead FROM l LEFT JOIN gone USING (doc_id, i)),
r AS (SELECT *, dead AND NOT coalesce(lag(dead) OVER (PARTITION BY doc_id ORDER BY i), false) AS opens FROM f)
SELECT doc_id, count(*) AS n_lines, CAST(sum(dead::INT) AS BIGINT) AS n_deleted, CAST(sum(opens::INT) AS BIGINT) AS n_runs,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY r.i) FILTER (NOT dead), '')) AS kept_sha256,
       any_value(lc.m) AS copy_lines, any_value(lc.i) AS copy_at, any_value(lc.first.d) AS copy_doc_id, any_value(lc.first.i) AS copy_line
FROM r LEFT JOIN lc USING (doc_id) GROUP BY doc_id
"""


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A quality score of every document, learnt from the labels outside the held-out part."""
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    trees = quality.fit(docs, _table(spark, sf_dir, "labels"))
    out = quality.score(docs, trees)
    return out.select("doc_id", (quality.split_of(F.col("doc_id")) == 2).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


def op11_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document's leaf, proof and roots; a fifth of the leaves is recomputed from lower-cased texts and folded."""
    docs = _table(spark, sf_dir, "documents")
    lower = F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    tampered = F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, merkle.leaf_of(*map(F.col, ("doc_id", "source", "lang", "n_chars")), lower))
    out = merkle.manifest(docs, also={"tampered": tampered})
    out = out.withColumn("folded_root", merkle.folded(F.coalesce("tampered", "leaf"), F.col("path")))
    return out.select("doc_id", "leaf", "subroot", "root", F.sha2(merkle.siblings(F.col("path")), 256).alias("proof_sha256"), "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))


OP11_SQL = """
WITH RECURSIVE crc(i, c, k) AS (SELECT CAST(range AS UBIGINT), CAST(range AS UBIGINT), 0 FROM range(256)
  UNION ALL SELECT i, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384::UBIGINT) ELSE c >> 1 END, k + 1 FROM crc WHERE k < 8),
byte AS MATERIALIZED (SELECT list(c ORDER BY i) AS t FROM crc WHERE k = 8),
d AS (SELECT *, row_number() OVER () AS id, translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS low, doc_id::VARCHAR AS x FROM documents),
sums(id, x, i, c) AS (SELECT id, x, 0, 4294967295::UBIGINT FROM d UNION ALL
  SELECT id, x, i + 1, xor(t[CAST(xor(c, ascii(x[i + 1])::UBIGINT) & 255 AS BIGINT) + 1], c >> 8) FROM sums, byte WHERE i < len(x)),
hit AS (SELECT id FROM sums WHERE i = len(x) AND xor(c, 4294967295::UBIGINT) % 5 = 0),
h AS (SELECT id, doc_id, coalesce('s' || source, '') AS g, {head} AS head, coalesce(strlen(text) || ':' || text, '-') AS text, coalesce(strlen(low) || ':' || low, '-') AS low FROM d),
l AS (SELECT h.id, doc_id, g, sha256(head || text) AS leaf, sha256(head || CASE WHEN hit.id IS NULL THEN text ELSE low END) AS bad FROM h LEFT JOIN hit ON h.id = hit.id),
n AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY doc_id NULLS FIRST, leaf, id) - 1 AS pos, count(*) OVER (PARTITION BY g) AS n FROM l),
up(g, lvl, pos, n, h) AS (SELECT g, 0, pos, n, leaf FROM n UNION ALL SELECT g, lvl + 1, pos // 16, (n + 15) // 16, sha256(string_agg(h, '' ORDER BY pos)) FROM up WHERE n > 1 GROUP BY g, lvl, pos // 16, n),
sub AS (SELECT g, lvl AS height, h AS subroot, row_number() OVER (ORDER BY g) - 1 AS pos, count(*) OVER () AS n FROM up WHERE n = 1),
top(lvl, pos, n, h) AS (SELECT 0, pos, n, subroot FROM sub UNION ALL SELECT lvl + 1, pos // 16, (n + 15) // 16, sha256(string_agg(h, '' ORDER BY pos)) FROM top WHERE n > 1 GROUP BY lvl, pos // 16, n),
a AS (SELECT n.id, lvl, up.pos AS p, up.pos = n.pos // (16 ** lvl)::BIGINT AS own, h FROM n JOIN up ON up.g = n.g AND up.n > 1 AND up.pos // 16 = n.pos // (16 ** (lvl + 1))::BIGINT
  UNION ALL SELECT n.id, height + top.lvl, top.pos, top.pos = sub.pos // (16 ** top.lvl)::BIGINT, h FROM n JOIN sub ON sub.g = n.g JOIN top ON top.n > 1 AND top.pos // 16 = sub.pos // (16 ** (top.lvl + 1))::BIGINT),
steps AS (SELECT id, lvl, string_agg(h, '' ORDER BY p) FILTER (NOT own) AS rest, coalesce(string_agg(h, '' ORDER BY p) FILTER (p < o), '') AS l, coalesce(string_agg(h, '' ORDER BY p) FILTER (p > o), '') AS r
  FROM (SELECT *, max(p) FILTER (own) OVER (PARTITION BY id, lvl) AS o FROM a) GROUP BY id, lvl),
f(id, lvl, h) AS (SELECT id, 0, bad FROM n UNION ALL SELECT f.id, f.lvl + 1, sha256(l || h || r) FROM f JOIN steps s ON s.id = f.id AND s.lvl = f.lvl),
e AS (SELECT id, max_by(h, lvl) AS folded FROM f GROUP BY id), p AS (SELECT id, string_agg(rest, '' ORDER BY lvl) AS rest FROM steps GROUP BY id),
root AS (SELECT h AS root FROM top WHERE n = 1)
SELECT doc_id, leaf, subroot, root, sha256(coalesce(rest, '')) AS proof_sha256, folded AS folded_root, folded = root AS verified
FROM n JOIN sub ON sub.g = n.g JOIN e ON e.id = n.id LEFT JOIN p ON p.id = n.id, root
""".replace("{head}", " || ".join(f"coalesce(strlen({c}::VARCHAR) || ':' || {c}::VARCHAR, '-')" for c in ("doc_id", "source", "lang", "n_chars")))


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every vector on the 32 first principal components, scaled to unit variance."""
    out = whitening.whiten(_table(spark, sf_dir, "embeddings"), "vec_id", "embedding", components=32, scale=64, shift=1_000_000)
    # An exact deviation is a decimal; where a long can't hold it, it is null here.
    return out.select("vec_id", "component", "n", F.col("deviation").try_cast("long").alias("deviation"), "whitened", "explained", "identity_error")


def op13_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's tokens in pieces, packed into sequences of 1024."""
    return packing.pack(_table(spark, sf_dir, "documents"), packing.tokenizer_of(spark))


QUERIES = {
    "op1_sentencepiece": op1_sentencepiece, "op2_exact_topk": op2_exact_topk, "op3_suffix_dedup": op3_suffix_dedup, "op4_substring_dedup": op4_substring_dedup, "op5_warc": op5_warc, "op6_html": op6_html, "op7_jaccard_join": op7_jaccard_join, "op8_decontaminate": op8_decontaminate,
    "op9_line_dedup": op9_line_dedup, "op10_quality": op10_quality, "op11_merkle": op11_merkle, "op12_whitening": op12_whitening, "op13_packing": op13_packing,
}
SQL = {"op2_exact_topk": OP2_SQL, "op4_substring_dedup": OP4_SQL, "op5_warc": OP5_SQL, "op7_jaccard_join": OP7_SQL, "op8_decontaminate": OP8_SQL, "op9_line_dedup": OP9_SQL, "op11_merkle": OP11_SQL}
