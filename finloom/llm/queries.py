"""Registered queries of the corpus operators and their DuckDB counterparts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from finloom.llm import decontaminate, jaccard, licences, pieces, pii, pseudo_likelihood, quality, resampling, secrets, topk, warc, whitening, wordpieces
from finloom.llm.shared import ORACLES, QUERIES, register, small_batches, table
from finloom.session import materialise

__all__ = ["ORACLES", "QUERIES"]


@register(
    "op1_topk_search",
    """
    WITH v AS (
      SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)) AS q, len(embedding) AS dim FROM embeddings
      WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
    s AS (
      SELECT a.vec_id AS query_id, b.vec_id, CAST(list_inner_product(a.q, b.q) AS BIGINT) AS score
      FROM v a JOIN v b ON a.dim = b.dim AND a.vec_id <> b.vec_id WHERE a.vec_id % 100 = 0)
    SELECT query_id, CAST(row_number() OVER w AS INTEGER) AS rank, vec_id, score FROM s
    WINDOW w AS (PARTITION BY query_id ORDER BY score DESC, vec_id) QUALIFY row_number() OVER w <= 10
    """,
)
def op1_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)


@register(
    "op2_jaccard_join",
    r"""
    WITH RECURSIVE w AS (
      SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                        '[^\x20\x09-\x0D]+') AS words FROM documents),
    sets AS (
      SELECT doc_id, list_distinct(CASE WHEN len(words) = 0 THEN [] WHEN len(words) < 3 THEN [array_to_string(words, ' ')]
        ELSE list_transform(range(1, len(words) - 1), lambda i: words[i] || ' ' || words[i + 1] || ' ' || words[i + 2]) END) AS s FROM w),
    t AS (SELECT doc_id, len(s) AS n, unnest(s) AS g FROM sets),
    links AS (
      SELECT a.doc_id AS a, b.doc_id AS b FROM t a JOIN t b ON a.g = b.g AND a.doc_id <> b.doc_id
       AND 100 * least(a.n, b.n) >= 90 * greatest(a.n, b.n)
      GROUP BY a.doc_id, b.doc_id HAVING 100 * count(*) >= 90 * (any_value(a.n) + any_value(b.n) - count(*))),
    reach(id, c) AS (
      SELECT doc_id, doc_id FROM sets
      UNION SELECT l.b, r.c FROM reach r JOIN links l ON l.a = r.id WHERE r.c < l.b)
    SELECT s.doc_id, CAST(len(s.s) AS BIGINT) AS n_shingles, m.c AS component_id
    FROM sets s JOIN (SELECT id, min(c) AS c FROM reach GROUP BY id) m ON m.id = s.doc_id
    """,
)
def op2_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return jaccard.jaccard_classes(table(spark, sf_dir, "documents"))


@register(
    "op3_warc",
    """
    WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS body FROM pages),
    d AS (SELECT page_id, octet_length(body) AS n, sha1(body) AS h FROM p),
    b AS (
      SELECT page_id, n, h, list_aggregate(list_transform(range(1, 41), lambda i:
        lpad(bin(strpos('0123456789abcdef', substr(h, i, 1)) - 1), 4, '0')), 'string_agg', '') AS bits FROM d),
    e AS (
      SELECT page_id, n, list_aggregate(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
        1 + list_sum(list_transform(range(1, 6), lambda j: CAST(substr(bits, CAST(5 * i + j AS BIGINT), 1) AS INTEGER) * CAST(pow(2, 5 - j) AS INTEGER)))::BIGINT, 1)),
        'string_agg', '') AS digest FROM b),
    f AS (SELECT *, min(page_id) OVER (PARTITION BY digest, n) AS first FROM e)
    SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, digest AS payload_digest,
      CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
      CASE WHEN page_id <> first THEN first END AS refers_to FROM f
    """,
)
def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    archives = materialise(warc.write_archives(warc.mark_revisits(table(spark, sf_dir, "pages"))), "archives")
    records = warc.read_archives(archives, with_payload=False)
    # a record that does not hold its digest is an error, not a result
    checked = records.where(F.when(F.col("digest_ok"), True).otherwise(F.raise_error(F.lit("a record does not match its digest")).cast("boolean")))
    return checked.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


@register("op10_secret_scans")
def op10_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    found = secrets.find_secrets(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", *secrets.digest(found, ("assign", "access", "hex")))


@register("op4_pii")
def op4_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.find_pii(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", *secrets.digest(found, pii.BASE_KINDS))


@register("op6_quality")
def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = quality.score(docs, quality.fit(docs, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", quality.held_out().alias("held_out"), "score", F.when(F.col("score") >= 0.3, 1).otherwise(0).alias("predicted"))


@register("op5_decontaminate")
def op5_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    found = decontaminate.leaks(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "leaked_items", (F.size("leaked_items") > 0).alias("leaked"))


@register("op9_sentencepiece")
def op9_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    coded = pieces.encode(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return coded.select("doc_id", F.size("piece_ids").cast("long").alias("n_pieces"), F.element_at("scores", 1).alias("score"),
                        F.get("scores", F.lit(1)).alias("second_score"), "round_trip", "piece_ids", "scores")


@register("op7_token_counts")
def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return wordpieces.count_pieces(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "n_tokens")


@register("op8_lm_scoring")
def op8_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = pseudo_likelihood.score(docs, pseudo_likelihood.train(docs))
    return scored.select("doc_id", "n_words", "log_likelihood", "per_word")


@register(
    "op11_importance_resample",
    r"""
    WITH RECURSIVE crc_byte(b, k, c) AS (
      SELECT b, 0, b::BIGINT FROM range(256) r(b)
      UNION ALL SELECT b, k + 1, CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END FROM crc_byte WHERE k < 8),
    crc_table AS (SELECT list(c ORDER BY b) AS t FROM crc_byte WHERE k = 8),
    texts AS (
      SELECT 1 AS raw, doc_id, text, row_number() OVER () AS row_no FROM documents
      UNION ALL SELECT 0, item_id, text, -row_number() OVER () FROM benchmark),
    words AS (
      SELECT raw, doc_id, row_no, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                                     '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM texts),
    runs AS (
      SELECT raw, row_no, unnest(list_concat(w,
        list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]),
        list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]))) AS f FROM words),
    counted AS (SELECT raw, row_no, f, count(*) AS n FROM runs GROUP BY ALL),
    features AS (SELECT f, hex(encode(f)) AS h FROM (SELECT DISTINCT f FROM counted)),
    hashed(f, h, i, c) AS (
      SELECT f, h, 0, 4294967295::BIGINT FROM features
      UNION ALL
      SELECT f, h, i + 1, xor(c // 256, t[xor(c % 256, 16 * (strpos('0123456789ABCDEF', h[2 * i + 1]) - 1) + strpos('0123456789ABCDEF', h[2 * i + 2]) - 1) + 1])
      FROM hashed, crc_table WHERE 2 * i < len(h)),
    placed AS (SELECT raw, row_no, n, xor(c, 4294967295) % 10000 AS bucket FROM counted JOIN hashed USING (f) WHERE 2 * i = len(h)),
    totals AS (SELECT coalesce(sum(n) FILTER (raw = 1), 0) AS s, coalesce(sum(n) FILTER (raw = 0), 0) AS t FROM placed),
    gains AS (
      SELECT bucket, CAST(floor(1000 * ln((coalesce(sum(n) FILTER (raw = 0), 0) + 1)::DOUBLE * (any_value(totals.s) + 10000)::DOUBLE
        / ((coalesce(sum(n) FILTER (raw = 1), 0) + 1)::DOUBLE * (any_value(totals.t) + 10000)::DOUBLE))) AS BIGINT) AS gain
      FROM placed, totals GROUP BY bucket),
    weights AS (SELECT row_no, sum(n * gain) AS weight FROM placed JOIN gains USING (bucket) WHERE raw = 1 GROUP BY row_no),
    scored AS (
      SELECT doc_id, len(w) AS n_words, greatest(len(w), 0) + greatest(len(w) - 1, 0) + greatest(len(w) - 2, 0) AS n_features,
        CAST(coalesce(weight, 0) AS BIGINT) AS weight,
        CAST(coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || substr(sha256('42:' || doc_id), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296::DOUBLE))) AS BIGINT) AS score
      FROM words LEFT JOIN weights USING (row_no) WHERE raw = 1),
    ranked AS (
      SELECT *, n_words >= 20 AS c, row_number() OVER (PARTITION BY n_words >= 20 ORDER BY score DESC, doc_id, n_features) AS r, count(*) FILTER (n_words >= 20) OVER () AS n FROM scored)
    SELECT doc_id, CAST(n_features AS BIGINT) AS n_features, weight, score, CASE WHEN c AND r <= 5 * n // 100 THEN r END AS rank FROM ranked
    """,
)
def op11_importance_resample(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    drawn = resampling.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return drawn.select("doc_id", "n_features", "weight", "score", "rank")


@register("op12_whitening")
def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(table(spark, sf_dir, "embeddings"))


@register("op13_license_scan")
def op13_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    found = licences.find_licences(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", *licences.summary())
