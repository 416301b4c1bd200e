"""The queries of this subpackage over the tables of a folder, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import byte_bpe, decontamination, filter_audit, html_text, near_duplicates, packing, quality, sharding, spelling, token_counts, token_files, toxicity, warc
from .shared import table


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op2_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packed(table(spark, sf_dir, "documents")).drop("fill")


def op3_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files.token_files(table(spark, sf_dir, "documents")).drop("file", "frame")


def op4_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.sharded(table(spark, sf_dir, "documents")).drop("shard")


def op5_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates.near_duplicates(table(spark, sf_dir, "documents"))


def op6_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.main_text(table(spark, sf_dir, "pages")).drop("n_blocks")


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archived(table(spark, sf_dir, "pages")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.maintained(table(spark, sf_dir, "documents"))


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontamination.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return decontamination.with_digest(found).drop("longest_match", "match_at", "match_item", "match_item_at")


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    columns = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "p_good"]
    return quality.judged(table(spark, sf_dir, "documents")).select(*columns)


def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variants(table(spark, sf_dir, "documents"))


def op12_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return byte_bpe.round_trip(table(spark, sf_dir, "documents"))


def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = (
        op1_toxicity, op2_best_fit_packing, op3_token_files, op4_sharding, op5_near_duplicates,
        op6_html_text, op7_warc, op8_token_counts, op9_decontamination, op10_quality_rules,
        op11_spelling_variants, op12_byte_bpe, op13_filter_audit,
    )
    return {f.__name__: f for f in found}


#: Lower case of A-Z alone, as both contracts ask.
_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

OP5_SQL = rf"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all({_LOWER}, '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN CAST([] AS VARCHAR[]) WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END) AS s FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
sets AS (SELECT doc_id, md5(string_agg(s, chr(10) ORDER BY s)) AS k FROM s GROUP BY doc_id),
firsts AS (SELECT k, min(doc_id) AS id FROM sets GROUP BY k),
few AS (SELECT s.doc_id AS id, s.s FROM s JOIN firsts f ON s.doc_id = f.id),
pairs AS (SELECT a.id AS a, b.id AS b, count(*) AS c FROM few a JOIN few b ON a.s = b.s AND a.id < b.id GROUP BY 1, 2),
links AS (SELECT a, b FROM pairs JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 85 * (x.n + y.n - c)),
both_ways AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach AS (SELECT id AS a, id AS b FROM firsts UNION SELECT r.a, e.b FROM reach r JOIN both_ways e ON r.b = e.a),
comp AS (SELECT a AS id, min(b) AS component FROM reach GROUP BY a)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, coalesce(c.component, d.doc_id) AS component_id,
  coalesce(c.component, d.doc_id) = d.doc_id AS kept
FROM documents d LEFT JOIN n ON n.doc_id = d.doc_id LEFT JOIN sets ON sets.doc_id = d.doc_id
LEFT JOIN firsts f ON f.k = sets.k LEFT JOIN comp c ON c.id = f.id"""

OP9_SQL = rf"""
WITH d AS (SELECT doc_id, regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
bw AS (SELECT DISTINCT item_id, n, array_to_string(w[i:i + n - 1], ' ') AS s
  FROM (SELECT item_id, w, least(10, len(w)) AS n, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS i FROM b WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT n FROM bw),
dw AS (SELECT doc_id, i, n, array_to_string(w[i:i + n - 1], ' ') AS s
  FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, sizes WHERE len(w) >= n)),
hits AS (SELECT dw.doc_id, dw.i, dw.n, bw.item_id FROM dw JOIN bw ON dw.n = bw.n AND dw.s = bw.s),
covered AS (SELECT DISTINCT doc_id, unnest(range(i, i + n)) AS at FROM (SELECT DISTINCT doc_id, i, n FROM hits)),
n_hit AS (SELECT doc_id, count(*) AS n_hit FROM covered GROUP BY doc_id),
items AS (SELECT doc_id, count(*) AS n_items, string_agg(x, ',' ORDER BY x) AS ids
  FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS x FROM hits) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN n_hit ON n_hit.doc_id = d.doc_id LEFT JOIN items ON items.doc_id = d.doc_id"""


OP4_SQL = "SELECT doc_id, CAST(octet_length(encode(text)) AS BIGINT) AS text_bytes, sha256(text) AS text_sha256 FROM documents"

OP7_SQL = """
WITH p AS (SELECT page_id, CAST(octet_length(encode(coalesce(html, ''))) AS BIGINT) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages),
f AS (SELECT payload_digest AS d, min(page_id) AS first FROM p GROUP BY payload_digest)
SELECT page_id, payload_bytes, payload_digest,
  CASE WHEN payload_bytes >= 100 AND first <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN payload_bytes >= 100 AND first <> page_id THEN first END AS refers_to
FROM p JOIN f ON p.payload_digest = f.d"""


OP11_SQL = rf"""
WITH RECURSIVE crc AS (
  SELECT list_transform(range(256), lambda b: list_reduce(list_prepend(b, range(8)),
    lambda c, i: CASE WHEN c & 1 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END)) AS t),
runs AS (
  SELECT coalesce(CAST(doc_id AS VARCHAR), '') AS id,
    unnest(list_transform(regexp_extract_all({_LOWER}, '[A-Za-z\x{{C0}}-\x{{FF}}]+'), lambda r: r)) AS w FROM documents),
bytes AS (
  SELECT w, flatten(list_transform(string_split(id || ':' || w, ''), lambda c: CASE WHEN unicode(c) < 128 THEN [CAST(unicode(c) AS BIGINT)]
    ELSE [CAST(192 + (unicode(c) >> 6) AS BIGINT), CAST(128 + (unicode(c) & 63) AS BIGINT)] END)) AS b FROM runs WHERE len(w) >= 7),
hashed AS (
  SELECT w, xor(4294967295, list_reduce(list_prepend(CAST(4294967295 AS BIGINT), b),
    lambda c, x: xor(t[xor(c & 255, x) + 1], c >> 8))) AS h FROM bytes, crc),
results AS (SELECT CASE WHEN h % 31 = 0 THEN w[:h % len(w)] || w[h % len(w) + 2:] ELSE w END AS word FROM hashed),
v AS (SELECT word, count(*) AS n FROM results WHERE len(word) >= 7 GROUP BY word HAVING count(*) >= 2),
cuts AS (SELECT word, i, word[:i - 1] || word[i + 1:] AS cut FROM (SELECT word, unnest(range(1, len(word) + 1)) AS i FROM v)),
shorter AS (SELECT DISTINCT c.word AS a, c.cut AS b FROM cuts c JOIN v ON v.word = c.cut),
pairs AS (
  SELECT a, b FROM shorter UNION SELECT b, a FROM shorter
  UNION SELECT x.word, y.word FROM cuts x JOIN cuts y ON x.cut = y.cut AND x.i = y.i AND x.word <> y.word),
ranked AS (
  SELECT a, b, v.n, count(*) OVER (PARTITION BY a) AS n_near, row_number() OVER (PARTITION BY a ORDER BY v.n DESC, b) AS k
  FROM pairs JOIN v ON v.word = b),
formed AS (
  SELECT v.word, v.n, coalesce(n_near, 0) AS n_near, CASE WHEN r.n >= 10 * v.n THEN b END AS form, CASE WHEN r.n >= 10 * v.n THEN r.n END AS form_n
  FROM v LEFT JOIN ranked r ON r.a = v.word AND r.k = 1),
chain AS (
  SELECT word, form AS at FROM formed WHERE form IS NOT NULL
  UNION ALL SELECT c.word, f.form FROM chain c JOIN formed f ON f.word = c.at WHERE f.form IS NOT NULL),
ends AS (SELECT c.word, c.at FROM chain c JOIN formed f ON f.word = c.at WHERE f.form IS NULL)
SELECT f.word, form, coalesce(e.at, f.word) AS root, n, n_near, form_n FROM formed f LEFT JOIN ends e ON e.word = f.word"""

OP13_SQL = r"""
WITH texts AS (
  SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
marks AS (SELECT doc_id, max(CAST(quality = 1 AS INT)) AS good, max(CAST(toxic = 1 AS INT)) AS toxic FROM labels GROUP BY doc_id),
flags AS (
  SELECT part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic, [
    len(w) < 50,
    100 * len(list_distinct(w)) < 65 * len(w),
    100 * len(regexp_replace(t, '[^A-Z]', '', 'g')) > 5 * len(t),
    regexp_matches(t, '[#$%&*|]'),
    coalesce(x.doc_id > min(x.doc_id) OVER (PARTITION BY t), false)] AS fails
  FROM texts x LEFT JOIN marks m ON m.doc_id = x.doc_id),
cells AS (SELECT part, fails, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM flags GROUP BY part, fails),
f AS (SELECT unnest(range(1, 6)) AS i),
orders AS (
  SELECT [a.i, b.i, c.i, d.i, e.i] AS o FROM f a, f b, f c, f d, f e
  WHERE len(list_distinct([a.i, b.i, c.i, d.i, e.i])) = 5),
steps AS (SELECT o, f.i AS step, o[f.i] AS own, o[:f.i - 1] AS earlier FROM orders, f),
judged AS (
  SELECT part, o, step, own, n, good, toxic, fails[own] AS failing,
    len(list_filter(earlier, lambda k: fails[k])) > 0 AS gone, len(list_filter(fails, lambda x: x)) = 1 AS alone
  FROM cells, steps),
sums AS (
  SELECT part, o, step, own,
    coalesce(sum(n) FILTER (NOT failing AND NOT gone), 0) AS kept, coalesce(sum(n) FILTER (failing AND NOT gone), 0) AS removed,
    coalesce(sum(n) FILTER (failing AND gone), 0) AS redundant, coalesce(sum(n) FILTER (failing AND alone), 0) AS unique_fails,
    coalesce(sum(good) FILTER (failing AND NOT gone), 0) AS good_lost, coalesce(sum(toxic) FILTER (failing AND NOT gone), 0) AS toxic_lost
  FROM judged GROUP BY part, o, step, own)
SELECT part, array_to_string(list_transform(o, lambda i: substr('ABCDE', i, 1)), '') AS filter_order, CAST(step AS INT) AS step,
  CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed, CAST(redundant AS BIGINT) AS redundant,
  CAST(unique_fails AS BIGINT) AS unique_fails, CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost,
  CAST(sum(removed) OVER (PARTITION BY part, own) AS BIGINT) AS shapley
FROM sums"""


def oracle_sql() -> dict[str, str]:
    return {"op4_sharding": OP4_SQL, "op5_near_duplicates": OP5_SQL, "op7_warc": OP7_SQL, "op9_decontamination": OP9_SQL, "op11_spelling_variants": OP11_SQL, "op13_filter_audit": OP13_SQL}
