"""The queries of this subpackage, each over its whole table, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def op1_maxscore_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .search import scaled, top_k

    return top_k(scaled(_read(spark, sf_dir, "embeddings")), F.col("id") % 50 == 0, 5)


def op2_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .html_text import extract

    return extract(_read(spark, sf_dir, "pages").select("page_id", "url", "html"))


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .line_dedup import report

    return report(_read(spark, sf_dir, "documents"))


def op4_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .near_dedup import classes, digest

    return digest(classes(_read(spark, sf_dir, "documents")))


def op5_class_model_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .language_model import scores

    return scores(_read(spark, sf_dir, "documents"))


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .token_counts import VOCABULARY, count_tokens, tiktoken_pieces

    return count_tokens(_read(spark, sf_dir, "documents").select("doc_id", "text"), tiktoken_pieces(VOCABULARY))


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .language import fit, held_out, identify

    docs = _read(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    found = identify(docs.select("doc_id", "text"), fit(docs.where(~held_out())), with_text=False)
    return found.select("doc_id", held_out().alias("held_out"), "lang_pred", "score", "rejected")


def op8_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .decontamination import digest, hits

    return digest(hits(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "benchmark")))


def op9_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .mixing import decisions

    made = decisions(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels"))
    return made.select("doc_id", "size", "source_size", "target", "taken")


def op10_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .secrets import digest, spans

    return digest(spans(_read(spark, sf_dir, "documents")))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (op1_maxscore_search, op2_html_text, op3_line_dedup, op4_minhash_near_dedup, op5_class_model_scores, op6_token_counts, op7_language_id, op8_decontaminate, op9_mix_sources, op10_secret_scan)}
_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_ALNUM = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_SPACED = r"[^\x20\x09-\x0D]+"

ORACLE_SQL: dict[str, str] = {
    "op1_maxscore_search": """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS w FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
e AS (SELECT vec_id, unnest(range(len(w))) AS d, unnest(w) AS x FROM v),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(sum(q.x * c.x) AS BIGINT) AS score
  FROM e q JOIN e c ON q.d = c.d AND q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0 GROUP BY ALL),
r AS (SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
""",
    "op3_line_dedup": f"""
WITH d AS (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents),
l AS (SELECT doc_id, i, list_sort(list_distinct(regexp_extract_all(lower(ls[i]), '{_SPACED}'))) AS w
  FROM (SELECT doc_id, ls, unnest(range(1, len(ls) + 1)) AS i FROM d)),
s AS (SELECT row_number() OVER (ORDER BY f) AS id, w, f FROM (SELECT w, min((doc_id, i)) AS f FROM l WHERE len(w) > 0 GROUP BY w)),
t AS (SELECT id, unnest(w) AS t, len(w) AS n FROM s),
c AS (SELECT t, count(*) AS f FROM t GROUP BY t),
p AS (SELECT id, t, n FROM (SELECT id, t, n, row_number() OVER (PARTITION BY id ORDER BY f, t) AS pos FROM t JOIN c USING (t)) WHERE pos <= n - ceil(0.85 * n - 1e-9) + 1),
pairs AS (SELECT DISTINCT a.id AS a, b.id AS b FROM p a JOIN p b ON a.t = b.t AND a.id < b.id),
m AS (
  SELECT DISTINCT b FROM pairs JOIN s x ON x.id = a JOIN s y ON y.id = b
  WHERE len(list_intersect(x.w, y.w)) >= 0.85 * (len(x.w) + len(y.w) - len(list_intersect(x.w, y.w))) - 1e-9),
gone AS (
  SELECT l.doc_id, l.i FROM l JOIN s USING (w) WHERE s.id IN (SELECT b FROM m) OR (l.doc_id, l.i) <> s.f),
g AS (SELECT doc_id, count(*) AS n, string_agg(i, ',' ORDER BY i) AS removed FROM gone GROUP BY doc_id)
SELECT doc_id, CAST(coalesce(len(ls), 0) AS BIGINT) AS n_lines, CAST(coalesce(n, 0) AS BIGINT) AS n_removed, coalesce(removed, '') AS removed
FROM d LEFT JOIN g USING (doc_id)
""",
    "op4_minhash_near_dedup": f"""
WITH RECURSIVE w AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all({_LOWER}, '{_SPACED}') AS w FROM documents),
s AS (SELECT DISTINCT r, array_to_string(w[i:i + 4], ' ') AS s FROM (SELECT r, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM w WHERE len(w) > 0)),
n AS (SELECT r, count(*) AS n FROM s GROUP BY r),
c AS (SELECT a.r AS a, b.r AS b, count(*) AS c FROM s a JOIN s b ON a.s = b.s AND a.r < b.r GROUP BY ALL),
l AS (SELECT a, b FROM c JOIN n x ON x.r = a JOIN n y ON y.r = b WHERE 100 * c >= 75 * (x.n + y.n - c)),
e AS (SELECT a, b FROM l UNION SELECT b, a FROM l),
reach AS (SELECT r AS a, r AS b FROM w UNION SELECT reach.a, e.b FROM reach JOIN e ON reach.b = e.a),
g AS (SELECT a, min(doc_id) AS component_id FROM reach JOIN w ON w.r = b GROUP BY a)
SELECT doc_id, coalesce(n, 0)::BIGINT AS n_shingles, component_id, coalesce(doc_id = component_id, false) AS kept FROM w LEFT JOIN n USING (r) JOIN g ON g.a = w.r
""",
    "op9_mix_sources": f"""
WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '{_SPACED}')) AS size, md5(coalesce(text, '')) AS digest FROM documents),
q AS (SELECT doc_id, max(quality) AS q FROM labels WHERE doc_id IS NOT NULL GROUP BY 1),
k AS (
  SELECT d.*, -ln((CAST('0x' || substr(md5('mix:' || coalesce(CAST(doc_id AS VARCHAR), '') || ':' || digest), 1, 13) AS BIGINT)::DOUBLE + 0.5) / 4503599627370496.0)
    / CASE q WHEN 1 THEN 2.0 WHEN 0 THEN 1.0 ELSE 1.5 END AS key
  FROM d LEFT JOIN q USING (doc_id)),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM k GROUP BY 1),
w AS (SELECT *, (row_number() OVER (ORDER BY source IS NULL, source) - 1) % 3 + 1 AS w, 3.0::DOUBLE * source_size AS cap FROM s),
v AS (
  SELECT *, (sum(source_size::DOUBLE) OVER () - coalesce(sum(cap) OVER up, 0)) / (sum(w) OVER () - coalesce(sum(w) OVER up, 0)) AS level
  FROM w WINDOW up AS (ORDER BY cap / w, source IS NULL, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
a AS (SELECT level FROM v WHERE level * w <= cap ORDER BY cap / w, level LIMIT 1),
t AS (SELECT source, source_size, coalesce(least(cap, (SELECT level FROM a) * w), cap)::DOUBLE AS target FROM v),
e AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END AS epochs FROM t),
f AS (
  SELECT k.*, source_size, target, epochs, target - epochs * source_size AS rest,
    coalesce(sum(size) OVER (PARTITION BY k.source ORDER BY key, doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
  FROM k JOIN e ON k.source IS NOT DISTINCT FROM e.source)
SELECT doc_id, size, source_size, target, CAST(size * (epochs + CASE WHEN size > 0 AND before + size / 2.0 <= rest THEN 1 ELSE 0 END) AS BIGINT) AS taken FROM f
""",
    "op8_decontaminate": f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all({_LOWER}, '{_ALNUM}') AS w FROM documents),
b AS (SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all({_LOWER}, '{_ALNUM}') AS w FROM benchmark),
bw AS (
  SELECT DISTINCT item, n, array_to_string(w[i:i + n - 1], ' ') AS g
  FROM (SELECT item, w, least(13, len(w)) AS n, unnest(range(1, len(w) - least(13, len(w)) + 2)) AS i FROM b WHERE len(w) > 0)),
dw AS (
  SELECT r, i, n, array_to_string(w[i:i + n - 1], ' ') AS g
  FROM (SELECT r, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, (SELECT DISTINCT n FROM bw))),
h AS (SELECT r, i, n, item FROM dw JOIN bw USING (n, g)),
cov AS (SELECT r, count(*) AS n_hit FROM (SELECT DISTINCT r, unnest(range(i, i + n)) AS p FROM h) GROUP BY r),
it AS (SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT r, item FROM h) GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
  CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(items, '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN cov USING (r) LEFT JOIN it USING (r)
""",
}
