"""The queries of this subpackage and, where SQL can express them, their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chats, decontaminate, html, langid, media, mixing, negatives, ngrams, quality, simhash, substrings, tokens, urls
from .common import read


def op1_ngram_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngrams.score(read(spark, sf_dir, "documents"))


def op2_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.extract(read(spark, sf_dir, "pages"))


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(read(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op4_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    model = urls.train(urls.labelled(spark))
    return urls.judge(read(spark, sf_dir, "pages"), model)


def url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.ruled(read(spark, sf_dir, "pages"))


def op5_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.token_table(read(spark, sf_dir, "documents"))


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(read(spark, sf_dir, "documents")).drop("text_key")


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = read(spark, sf_dir, "documents")
    found = langid.identify(documents, langid.train(documents))
    return found.select("doc_id", langid.held_out("doc_id").alias("held_out"), "lang_pred", "score", "ambiguous")


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    report = decontaminate.contamination(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))
    return report.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


def op9_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.dedup(read(spark, sf_dir, "documents"), with_text=False)


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality.judge(read(spark, sf_dir, "documents"))
    return judged.withColumn("clean_sha256", F.sha2("text", 256)).drop("text")


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.col("label").cast("long")
    rows = negatives.prepared(read(spark, sf_dir, "embeddings"), "vec_id", "embedding", F.when(F.col("vec_id") % 7 == 0, (label + 1) % 10).otherwise(label))
    return negatives.mine(rows, rows.filter("id % 100 = 0"))


def op12_mpeg(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.read_back(media.store(read(spark, sf_dir, "documents"))).withColumnRenamed("id", "doc_id")


def op13_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chats.report(read(spark, sf_dir, "conversations"))


def queries() -> dict:
    found = (
        op1_ngram_score, op2_html, op3_simhash, op4_url_filter, op5_tokens, op6_mixing, op7_language_id, op8_decontamination, op9_substrings, op10_quality, op11_hard_negatives, op12_mpeg, op13_conversations,
    )
    return {f.__name__: f for f in (*found, url_rules)}


_WORDS = r"list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '')"
SQL = {
    "url_rules": r"""
WITH p AS (SELECT page_id, CASE WHEN contains(coalesce(url, ''), '://') THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages
), h AS (SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM p
), r(rule) AS (VALUES ('com/'), ('example.com/en/'), ('www.example.com/en/'), ('net/es/'), ('net/fr/'))
SELECT page_id, host, path, (SELECT arg_max(rule, length(rule)) FROM r WHERE (host = split_part(rule, '/', 1) OR ends_with(host, '.' || split_part(rule, '/', 1))) AND starts_with(path, substr(rule, strpos(rule, '/')))) AS rule FROM h
""",
    "op11_hard_negatives": """
WITH v AS (
  SELECT row_number() OVER () AS r, vec_id AS id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS e
  FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT a.r AS anchor, a.id AS anchor_id, a.label AS own, n.r, n.id, n.label, CAST(list_sum(list_transform(range(1, least(len(a.e), len(n.e)) + 1), lambda i: a.e[i] * n.e[i])) AS BIGINT) AS score
  FROM v a JOIN v n ON a.id % 100 = 0 AND n.id IS DISTINCT FROM a.id
), p AS (SELECT * FROM s WHERE label = own QUALIFY row_number() OVER (PARTITION BY anchor ORDER BY score DESC, id NULLS LAST) <= 5
), n AS (
  SELECT p.anchor_id, p.id AS positive_id, p.score AS positive_score, s.id AS negative_id, s.score AS negative_score, row_number() OVER (PARTITION BY p.anchor, p.r ORDER BY s.score DESC, s.id NULLS LAST) AS rank
  FROM p JOIN s USING (anchor) WHERE s.label <> p.label AND 30 * p.score <= 100 * s.score AND 100 * s.score <= 90 * p.score)
SELECT anchor_id, positive_id, CAST(rank AS INTEGER) AS rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 10
""",
    "op9_substrings": f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {_WORDS} AS ws FROM documents
), win AS (SELECT r, doc_id, i, array_to_string(list_slice(ws, i, i + 12), ' ') AS w FROM (SELECT r, doc_id, ws, unnest(range(1, len(ws) - 11)) AS i FROM d)
), low AS (SELECT w, min(coalesce(doc_id, -9223372036854775808)) AS least FROM win GROUP BY w
), hit AS (SELECT DISTINCT r, unnest(range(i, i + 13)) AS p FROM win JOIN low USING (w) WHERE least < coalesce(doc_id, -9223372036854775808)
), gone AS (SELECT r, count(*) AS n FROM hit GROUP BY r
), rest AS (SELECT r, string_agg(w, ' ' ORDER BY p) AS kept FROM (SELECT r, unnest(ws) AS w, unnest(range(1, len(ws) + 1)) AS p FROM d WHERE r IN (SELECT r FROM gone)) ANTI JOIN hit USING (r, p) GROUP BY r)
SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(n, 0) AS BIGINT) AS n_removed, sha256(CASE WHEN n IS NULL THEN array_to_string(ws, ' ') ELSE coalesce(kept, '') END) AS kept_sha256
FROM d LEFT JOIN gone USING (r) LEFT JOIN rest USING (r)
""",
    "op10_quality": f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, source, coalesce(text, '') AS t, {_WORDS} AS ws FROM documents
), win AS (SELECT r, i, list_slice(ws, i, i + 2) AS w FROM (SELECT r, ws, unnest(range(1, len(ws) - 1)) AS i FROM d)
), twice AS (SELECT r, w FROM win GROUP BY r, w HAVING count(*) > 1
), rep AS (SELECT r, count(DISTINCT p) AS n_repeat FROM (SELECT r, unnest(range(i, i + 3)) AS p FROM win JOIN twice USING (r, w)) GROUP BY r
), line AS (SELECT r, doc_id, source, t, unnest(string_split(t, chr(10))) AS x, unnest(range(1, len(string_split(t, chr(10))) + 1)) AS p FROM d
), words AS (SELECT *, list_filter(string_split_regex(x, '[\\x20\\x09-\\x0D]+'), lambda y: y <> '') AS lw FROM line
), norm AS (SELECT *, translate(array_to_string(lw, ' '), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ123456789', 'abcdefghijklmnopqrstuvwxyz000000000') AS k FROM words
), freq AS (SELECT source, k, count(DISTINCT (doc_id, t)) AS n FROM norm WHERE len(lw) > 0 GROUP BY source, k
), seen AS (SELECT norm.*, len(lw) > 0 AND coalesce(freq.n, 0) > 20 AS common FROM norm LEFT JOIN freq ON freq.source IS NOT DISTINCT FROM norm.source AND freq.k = norm.k
), told AS (
  SELECT r, count(*) FILTER (WHERE len(lw) > 0) - count(DISTINCT CASE WHEN len(lw) > 0 THEN x END) AS dup, coalesce(sum(len(lw)) FILTER (WHERE common), 0) AS lost, coalesce(string_agg(x, chr(10) ORDER BY p) FILTER (WHERE NOT common), '') AS clean FROM seen GROUP BY r
), c AS (
  SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(list_sum(list_transform(ws, lambda x: length(x))), 0) AS BIGINT) AS word_chars, CAST(length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
    CAST(dup AS BIGINT) AS n_dup_lines, CAST(coalesce(n_repeat, 0) AS BIGINT) AS n_repeat_words, CAST(lost AS BIGINT) AS n_lost_words, clean FROM d JOIN told USING (r) LEFT JOIN rep USING (r)
), b AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM c)
SELECT * EXCLUDE clean, NOT base_failed AND n_lost_words <= 0.5 * n_words AS kept, sha256(clean) AS clean_sha256 FROM b
""",
    "op8_decontamination": r"""
WITH item AS (
  SELECT CAST(item_id AS VARCHAR) AS item, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS ws FROM benchmark
), win AS (
  SELECT item, w FROM (SELECT item, CASE WHEN len(ws) >= 10 THEN unnest([list_slice(ws, i, i + 9) FOR i IN range(1, greatest(len(ws) - 8, 2))]) ELSE ws END AS w FROM item WHERE len(ws) > 0)
), wins AS (SELECT w, list(DISTINCT item) AS items FROM win GROUP BY w
), doc AS (
  SELECT doc_id, row_number() OVER () AS r, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS ws FROM documents
), hit AS (
  SELECT d.r, d.i, len(wins.w) AS n, wins.items FROM (SELECT r, n, i, list_slice(ws, i, i + n - 1) AS w FROM (SELECT r, ws, n, unnest(range(1, len(ws) - n + 2)) AS i FROM doc, (SELECT DISTINCT len(w) AS n FROM wins))) d JOIN wins ON d.w = wins.w
), words AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(i, i + n)) AS p FROM hit) GROUP BY r
), its AS (SELECT r, list_sort(list(DISTINCT item)) AS items FROM (SELECT r, unnest(items) AS item FROM hit) GROUP BY r)
SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(len(items), 0) AS BIGINT) AS n_items,
  sha256(coalesce(array_to_string(items, ','), '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM doc LEFT JOIN words USING (r) LEFT JOIN its USING (r)
""",
    "op6_mixing": r"""
WITH d AS (
  SELECT doc_id, source, len(list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '')) AS size, md5('mix' || coalesce(CAST(doc_id AS VARCHAR), '')) AS key, coalesce('=' || source, 'null') AS skey FROM documents
), s AS (SELECT skey, min(source) AS source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY skey
), t0 AS (SELECT *, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS rank FROM s
), t1 AS (SELECT *, CAST([3, 1, 2][rank % 3 + 1] AS DOUBLE) AS w, source_size * CAST(2 AS DOUBLE) AS cap FROM t0
), t2 AS (SELECT *, cap / w AS ratio, sum(source_size) OVER () * CAST(1.5 AS DOUBLE) AS total FROM t1
), t3 AS (SELECT *, coalesce(sum(cap) OVER (ORDER BY ratio, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before, sum(w) OVER (ORDER BY ratio, rank ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS rest FROM t2
), t4 AS (SELECT *, ratio <= (total - before) / rest AS full_ FROM t3
), t5 AS (SELECT *, CASE WHEN full_ THEN cap ELSE (total - sum(CASE WHEN full_ THEN cap ELSE 0 END) OVER ()) * w / sum(CASE WHEN full_ THEN 0 ELSE w END) OVER () END AS target FROM t4
), t AS (SELECT skey, source_size, total, target, sum(target) OVER (ORDER BY rank) AS hi FROM t5
), b AS (SELECT 64 AS block, max(hi) AS top, max(total) AS total FROM t
), slot AS (SELECT k, (k % 2147483648 * 1327217885 % 2147483648) / CAST(2147483648 AS DOUBLE) * top AS at FROM (SELECT unnest(range(CAST(ceil(total / block) AS BIGINT))) AS k, top FROM b)
), got AS (SELECT k, skey, row_number() OVER (PARTITION BY skey ORDER BY k) - 1 AS r FROM slot ASOF JOIN (SELECT skey, hi - target AS lo, target FROM t WHERE target > 0) z ON slot.at >= z.lo
), times AS (SELECT skey, r % nb AS block_no, count(*) AS times FROM (SELECT got.skey, r, CAST(ceil(source_size / block) AS BIGINT) AS nb FROM got JOIN t USING (skey), b) WHERE r < 2 * nb GROUP BY 1, 2
), p AS (SELECT *, CAST(coalesce(sum(size) OVER (PARTITION BY skey ORDER BY key ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start FROM d
), piece AS (SELECT skey, start, size, block, unnest(range(start // block, (start + size - 1) // block + 1)) AS block_no FROM p, b WHERE size > 0
), took AS (SELECT piece.skey, start, sum((least(start + size, (block_no + 1) * block) - greatest(start, block_no * block)) * times) AS taken FROM piece JOIN times USING (skey, block_no) GROUP BY 1, 2)
SELECT doc_id, CAST(size AS BIGINT) AS size, source_size, target, CAST(CASE WHEN size > 0 THEN coalesce(taken, 0) ELSE 0 END AS BIGINT) AS taken
FROM p JOIN t USING (skey) LEFT JOIN took USING (skey, start)
""",
}


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
