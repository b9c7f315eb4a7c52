"""The operators of this package as queries over the driver's tables, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strophe.llm import alignment, decontaminate, embeddings, licenses, minhash, packing, pages, quality, runs, store, substring, tokencounts, tokenfiles, urls

RULES: list[urls.Rule] = [
    ("block", "com", "/en/"),
    ("allow", "example.com", "/en/7"),
    ("allow", "net", "/de/"),
    ("block", "example.net", "/de/8"),
    ("block", "org", "/es/"),
]
REJECT_BELOW = 0.7


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    store.small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.leaks(spark, _read(spark, sf_dir, "documents"), _read(spark, sf_dir, "benchmark"))


def op2_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(spark, _read(spark, sf_dir, "documents"), tokenizer_path())


def op3_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embeddings.near_vectors(spark, _read(spark, sf_dir, "embeddings"), 0.93)


def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = substring.drop_repeats(spark, _read(spark, sf_dir, "documents").select("doc_id", "text"), 35, joined=True)
    return cut.select("doc_id", "n_words", "n_removed", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


def op5_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    marks = minhash.near_duplicates(spark, _read(spark, sf_dir, "documents"), 4, 80)
    return marks.select("doc_id", "n_shingles", "component_id", "kept")


def op6_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan_licenses(_read(spark, sf_dir, "documents"))


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokencounts.token_counts(_read(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"))


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = _read(spark, sf_dir, "documents").select("doc_id", "text")
    model = quality.fit_quality(spark, documents, _read(spark, sf_dir, "labels"))
    held_out = (F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2).alias("held_out")
    return quality.score_quality(documents, model).select("doc_id", held_out, "score", (F.col("score") >= REJECT_BELOW).cast("int").alias("predicted"))


def op9_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judge_urls(spark, _read(spark, sf_dir, "pages"), RULES).select("page_id", "host", "path", "rule", "verdict")


def op10_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pages.main_text(spark, _read(spark, sf_dir, "pages")).withColumn("n_chars", F.char_length("text").cast("long"))


def op11_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    aligned = alignment.align_documents(spark, _read(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"), tokenizer_path("piece_bpe_32k.model"), digest=True)
    return aligned.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", F.col("groups").alias("groups_sha256"))


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runs.run_digest(runs.collapse_runs(runs.plant_periods(_read(spark, sf_dir, "documents"))))


def op13_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{store.Workspace(spark, 'tokens').root}/simple8b"
    tokenfiles.write_documents(_read(spark, sf_dir, "documents"), path, tokenizer_path("byte_bpe_50k.json"))
    return tokenfiles.read_documents(spark, path, ids=False)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    ops = (op1_decontaminate, op2_pack, op3_embedding_dedup, op4_substring_dedup, op5_minhash_dedup, op6_license_scan, op7_token_counts, op8_quality, op9_url_filter, op10_main_text, op11_token_alignment, op12_periodic_runs, op13_token_files)
    return {f.__name__: f for f in ops}


_REACH = """
, reach(node, other) AS (SELECT src, dst FROM links UNION SELECT r.node, l.dst FROM reach r JOIN links l ON l.src = r.other)
, least AS (SELECT node, least(node, min(other)) AS component_id FROM reach GROUP BY node)
"""

OP3_SQL = f"""
WITH RECURSIVE v AS (
  SELECT vec_id, label, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0
), links(src, dst) AS (
  SELECT a.vec_id, b.vec_id FROM v a JOIN v b ON a.label = b.label AND len(a.e) = len(b.e) AND a.vec_id <> b.vec_id
  WHERE list_cosine_similarity(a.e, b.e) >= 0.93
){_REACH}
SELECT e.vec_id, coalesce(n.n, 0) AS n_links, coalesce(c.component_id, e.vec_id) AS component_id, e.vec_id = coalesce(c.component_id, e.vec_id) AS kept
FROM embeddings e LEFT JOIN (SELECT src, count(*) AS n FROM links GROUP BY src) n ON n.src = e.vec_id LEFT JOIN least c ON c.node = e.vec_id
"""

OP4_SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
p AS (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS i FROM d),
g AS (SELECT doc_id, i, w[i] AS word, CASE WHEN i + 34 <= len(w) THEN md5(array_to_string(w[i:i + 34], ' ')) END AS gram FROM p),
t AS (SELECT gram FROM g WHERE gram IS NOT NULL GROUP BY gram HAVING count(*) > 1),
m AS (SELECT g.doc_id, g.i, g.word, max(CASE WHEN t.gram IS NULL THEN 0 ELSE 1 END) OVER (PARTITION BY g.doc_id ORDER BY g.i ROWS BETWEEN 34 PRECEDING AND CURRENT ROW) AS gone
      FROM g LEFT JOIN t ON g.gram = t.gram),
k AS (SELECT doc_id, sum(gone) AS n_removed, coalesce(string_agg(word, ' ' ORDER BY i) FILTER (WHERE gone = 0), '') AS kept FROM m GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(k.n_removed, 0) AS BIGINT) AS n_removed, sha256(coalesce(k.kept, '')) AS kept_sha256
FROM d LEFT JOIN k ON d.doc_id = k.doc_id
"""

OP5_SQL = rf"""
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), s AS (
  SELECT DISTINCT doc_id, md5(array_to_string(w[i:i + 3], ' ')) AS g
  FROM (SELECT doc_id, w, unnest(range(1, greatest(1, len(w) - 3) + 1)) AS i FROM d WHERE len(w) > 0)
), n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
c AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS both FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2),
links(src, dst) AS (
  SELECT c.x, c.y FROM c JOIN n a ON a.doc_id = c.x JOIN n b ON b.doc_id = c.y WHERE 100 * c.both >= 80 * (a.n + b.n - c.both)
){_REACH}
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, coalesce(l.component_id, d.doc_id) AS component_id, d.doc_id = coalesce(l.component_id, d.doc_id) AS kept
FROM d LEFT JOIN n ON n.doc_id = d.doc_id LEFT JOIN least l ON l.node = d.doc_id
"""


def _op9_sql() -> str:
    host = r"lower(regexp_extract({u}, '(?s)^.*?://([^/?#]*)', 1))"
    path = r"regexp_extract({u}, '(?s)^.*?://[^/?#]*([^?#]*)', 1)"
    node = r"regexp_replace({u}, '(?s)#.*$', '')"
    rules = ", ".join(f"('{v}', '{h}', '{p}')" for v, h, p in RULES)
    return f"""
WITH RECURSIVE rules(verdict, host, path) AS (VALUES {rules}),
tags AS (SELECT url, unnest(regexp_extract_all(html, '(?i)<(?:link|meta)\\b[^>]*>')) AS tag FROM pages WHERE url IS NOT NULL),
hrefs AS (
  SELECT url, regexp_extract(tag, '(?i)\\bhref\\s*=\\s*["'']?([^"''\\s>]+)', 1) AS href FROM tags WHERE regexp_matches(tag, '(?i)^<link\\b') AND regexp_matches(tag, '(?i)\\brel\\s*=\\s*["'']?[^"''>]*\\bcanonical\\b')
  UNION ALL
  SELECT url, regexp_extract(tag, '(?i)\\burl\\s*=\\s*["'']?([^"''\\s>]+)', 1) FROM tags WHERE regexp_matches(tag, '(?i)^<meta\\b') AND regexp_matches(tag, '(?i)\\bhttp-equiv\\s*=\\s*["'']?refresh\\b')
),
edges AS (SELECT {node.format(u='url')} AS a, {node.format(u='href')} AS b FROM hrefs WHERE regexp_matches(href, '^[A-Za-z][A-Za-z0-9+.-]*://')),
links(src, dst) AS (SELECT a, b FROM edges WHERE a <> b UNION SELECT b, a FROM edges WHERE a <> b),
reach(node, other) AS (SELECT src, dst FROM links UNION SELECT r.node, l.dst FROM reach r JOIN links l ON l.src = r.other),
judged AS (
  SELECT r.node, max(CASE WHEN u.verdict = 'allow' THEN 2 WHEN u.verdict = 'block' THEN 1 ELSE 0 END) AS says FROM reach r LEFT JOIN LATERAL (
    SELECT x.verdict FROM rules x WHERE ({host.format(u='r.other')} = x.host OR ends_with({host.format(u='r.other')}, '.' || x.host)) AND starts_with({path.format(u='r.other')}, x.path)
    ORDER BY length(x.host || x.path) DESC LIMIT 1) u ON TRUE
  GROUP BY r.node
),
own AS (SELECT row_number() OVER () AS k, page_id, url, coalesce({host.format(u='url')}, '') AS host, coalesce({path.format(u='url')}, '') AS path FROM pages),
fits AS (SELECT o.k, arg_max(r.host || r.path, length(r.host || r.path)) AS rule, arg_max(r.verdict, length(r.host || r.path)) AS verdict FROM own o JOIN rules r
  ON (o.host = r.host OR ends_with(o.host, '.' || r.host)) AND starts_with(o.path, r.path) GROUP BY o.k)
SELECT o.page_id, o.host, o.path, f.rule, coalesce(f.verdict, CASE j.says WHEN 2 THEN 'allow' WHEN 1 THEN 'block' END, 'allow') AS verdict
FROM own o LEFT JOIN fits f ON f.k = o.k LEFT JOIN judged j ON j.node = {node.format(u='o.url')}
"""


#: A run of period q and 4 q words or more repeats every three words that its first 3 q words begin; islands of these are the runs.
OP12_SQL = r"""
WITH z AS (
  SELECT list_transform(range(256), lambda b: list_reduce([b, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, x: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS crc
), d AS (SELECT row_number() OVER () AS k, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
h AS (SELECT k, doc_id, w, len(w) AS n, xor(4294967295, list_reduce([4294967295] || list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda x: CAST(ord(x) AS BIGINT)),
                                                                          lambda c, x: xor(c >> 8, crc[1 + xor(c & 255, x)]))) AS h FROM d, z),
a AS (SELECT *, CASE WHEN h % 10 = 0 AND n > 0 THEN (h // 10) % n END AS a, 3 + (h // 10) % 8 AS z FROM h),
v AS (SELECT k, doc_id, n, CASE WHEN a IS NULL THEN w ELSE list_transform(range(n), lambda i: w[1 + CASE WHEN i < a THEN i ELSE a + (i - a) % (1 + (n - a) // z) END]) END AS w FROM a),
p AS (SELECT k, n, w, unnest(range(n)) AS i FROM v),
g AS (SELECT k, n, i, w[i + 1] AS x, array_to_string(w[i + 1:i + 3], ' ') AS t, i + 2 < n AS whole FROM p),
m AS (SELECT l.k, l.i, r.i - l.i AS q FROM g l JOIN g r ON l.k = r.k AND l.t = r.t AND r.i > l.i AND 4 * (r.i - l.i) <= l.n WHERE l.whole AND r.whole),
s AS (SELECT k, q, i, i - row_number() OVER (PARTITION BY k, q ORDER BY i) AS island FROM m),
e AS (SELECT k, q, min(i) AS start, max(i) - min(i) + 3 + q AS length FROM s GROUP BY k, q, island),
r AS (SELECT k, start, length, min(q) AS q FROM e WHERE length >= greatest(6, 4 * q) GROUP BY k, start, length),
one AS (SELECT k, count(*) AS n_runs, string_agg(start || ',' || length || ',' || q || chr(10), '' ORDER BY start, q) AS lines,
        first(struct_pack(s := start, l := length, q := q) ORDER BY length DESC, start, q) AS b FROM r GROUP BY k),
c AS (SELECT g.k, g.i, g.x FROM g ANTI JOIN r ON g.k = r.k AND g.i >= r.start + r.q AND g.i < r.start + r.length),
t AS (SELECT k, string_agg(x, ' ' ORDER BY i) AS kept FROM c GROUP BY k)
SELECT d.doc_id, coalesce(o.n_runs, 0) AS n_runs, o.b.s AS start, o.b.l AS length, o.b.q AS period, 1000 * o.b.l // o.b.q AS exponent_milli,
  sha256(coalesce(o.lines, '')) AS runs_sha256, sha256(coalesce(t.kept, '')) AS collapsed_sha256
FROM d LEFT JOIN one o ON o.k = d.k LEFT JOIN t ON t.k = d.k
"""


def oracle_sql() -> dict[str, str]:
    return {"op3_embedding_dedup": OP3_SQL, "op4_substring_dedup": OP4_SQL, "op5_minhash_dedup": OP5_SQL, "op9_url_filter": _op9_sql(), "op12_periodic_runs": OP12_SQL}
