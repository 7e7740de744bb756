"""The registered queries of this package, with production parameters, and their SQL."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import adaptive_scan, bpe, decontaminate, hard_negatives, langid, near_vectors, ngram_join, periodic, pii, sharding, suffixes, url_filter, word_windows
from tidemark.llm.graph import shared_top

#: (verdict, host, path) of the rules that come before a host's reputation.
URL_RULES = [("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/"), ("block", "net", "/fr/")]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(docs: DataFrame) -> DataFrame:
    """docs in a partition for each core, where the files give fewer splits than that: one large row group is one task else."""
    cores = docs.sparkSession.sparkContext.defaultParallelism
    return docs.repartition(cores) if docs.rdd.getNumPartitions() < cores else docs


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder that driver and executors share."""
    return f"{shared_top(spark)}/{name}-{uuid.uuid4().hex}"


def op1_pca_tiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors.near_duplicates(table(spark, sf_dir, "embeddings"), 0.98)


def op2_word_window_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return word_windows.remove_repeats(table(spark, sf_dir, "documents"), length=20)


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return langid.identify(docs, langid.fit(docs))


def op4_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixes.remove_repeats(table(spark, sf_dir, "documents"), length=100)


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), short_items=True)
    return found.select("doc_id", "item_id", "n_covered", "n_item", F.size("tiles").alias("n_tiles"))


def op6_bpe_prefix_dp(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return bpe.digests(spread(table(spark, sf_dir, "documents")), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def op7_url_reputation(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = table(spark, sf_dir, "labels")  # a page's outcome is the label of the document of the same number
    outcomes = labels.select(F.col("doc_id").alias("page_id"), F.when((F.col("toxic") == 1) | (F.col("quality") == 0), 1).otherwise(0).alias("bad"))
    return url_filter.judge(table(spark, sf_dir, "pages"), outcomes, URL_RULES)


def op8_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.jaccard_components(table(spark, sf_dir, "documents"))


def op9_contextual_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find(table(spark, sf_dir, "documents"))


def op10_tiered_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = sharding.shard_documents(table(spark, sf_dir, "documents"), shared_folder(spark, "shards"))
    return rows.select("doc_id", "arrival", F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("text_sha256"))


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    other = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives.mine(vectors.withColumn("label", other))


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periodic.digests(periodic.with_planted(spread(table(spark, sf_dir, "documents"))))


def op13_adaptive_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return adaptive_scan.neighbours(table(spark, sf_dir, "embeddings"))


_ALL = (op1_pca_tiles, op2_word_window_dedup, op3_language_id, op4_suffix_dedup, op5_decontamination, op6_bpe_prefix_dp, op7_url_reputation, op8_ngram_jaccard, op9_contextual_pii, op10_tiered_shards)
_ALL += (op11_hard_negatives, op12_periodic_runs, op13_adaptive_scan)
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in _ALL}

_OP1 = """
WITH RECURSIVE v AS (SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND len(embedding) > 0
  AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
links AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND len(a.e) = len(b.e) AND a.vec_id <> b.vec_id WHERE list_cosine_similarity(a.e, b.e) >= 0.98),
reach AS (SELECT vec_id AS a, vec_id AS b FROM embeddings UNION SELECT reach.a, links.b FROM reach JOIN links ON reach.b = links.a),
n AS (SELECT a, count(*) AS n FROM links GROUP BY a)
SELECT c.a AS vec_id, coalesce(n, 0)::BIGINT AS n_links, component_id, c.a = component_id AS kept FROM (SELECT a, min(b) AS component_id FROM reach GROUP BY a) c LEFT JOIN n ON n.a = c.a
"""

_OP2 = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
win AS (SELECT r, doc_id, i, array_to_string(w[i:i + 19], ' ') AS k FROM (SELECT r, doc_id, w, unnest(range(1, len(w) - 18)) AS i FROM d WHERE len(w) >= 20)),
firsts AS (SELECT k, min(struct_pack(d := doc_id, i := i)) AS f FROM win GROUP BY k HAVING count(*) > 1),
late AS (SELECT win.r, win.i FROM win JOIN firsts USING (k) WHERE struct_pack(d := doc_id, i := i) > f),
gone AS (SELECT DISTINCT r, i + j AS i FROM late, (SELECT unnest(range(0, 20)) AS j)),
kept AS (SELECT d.r, string_agg(d.w[p.i], ' ' ORDER BY p.i) AS t, count(*) AS n
         FROM (SELECT r, unnest(range(1, len(w) + 1)) AS i FROM d) p JOIN d USING (r) ANTI JOIN gone ON gone.r = p.r AND gone.i = p.i GROUP BY d.r)
SELECT doc_id, len(w)::BIGINT AS n_words, (len(w) - coalesce(n, 0))::BIGINT AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (r)
"""

_OP4 = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, lower(hex(encode(coalesce(text, '')))) AS h FROM documents),
win AS (SELECT r, doc_id, i, substr(h, 2 * i + 1, 200) AS k FROM (SELECT r, doc_id, h, unnest(range(0, len(h) // 2 - 99)) AS i FROM d WHERE len(h) >= 200)),
firsts AS (SELECT k, min(struct_pack(d := doc_id, i := i)) AS f FROM win GROUP BY k HAVING count(*) > 1),
late AS (SELECT win.r, win.i, lag(win.i) OVER (PARTITION BY win.r ORDER BY win.i) AS p FROM win JOIN firsts USING (k) WHERE struct_pack(d := doc_id, i := i) > f),
spans AS (SELECT r, min(i) AS a, max(i) + 100 AS b FROM (SELECT r, i, sum(CASE WHEN p IS NULL OR i > p + 100 THEN 1 ELSE 0 END) OVER (PARTITION BY r ORDER BY i) AS g FROM late) GROUP BY r, g),
gaps AS (SELECT r, a, b, coalesce(lag(b) OVER (PARTITION BY r ORDER BY a), 0) AS from_, count(*) OVER (PARTITION BY r) AS c, row_number() OVER (PARTITION BY r ORDER BY a DESC) AS last_ FROM spans),
kept AS (SELECT r, sum(b - a) AS gone, count(*) AS n, string_agg(substr(h, 2 * from_ + 1, 2 * (a - from_)) || CASE WHEN last_ = 1 THEN substr(h, 2 * b + 1) ELSE '' END, '' ORDER BY a) AS t FROM gaps JOIN d USING (r) GROUP BY r)
SELECT doc_id, (len(h) // 2)::BIGINT AS n_bytes, coalesce(gone, 0)::BIGINT AS n_removed, coalesce(n, 0)::BIGINT AS n_spans, sha256(unhex(coalesce(t, h))) AS kept_sha256
FROM d LEFT JOIN kept USING (r)
"""

_OP7 = r"""
WITH u AS (SELECT page_id, coalesce(translate(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
                  coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 2), '') AS path FROM pages),
h AS (SELECT host, count(*) AS n, sum(CASE WHEN toxic = 1 OR quality = 0 THEN 1 ELSE 0 END) AS bad, regexp_replace(host, ':[0-9]*$', '') AS bare FROM u JOIN labels ON doc_id = page_id GROUP BY host),
h2 AS (SELECT *, CASE WHEN regexp_extract(bare, '([^.]+[.][^.]+)$', 1) = '' THEN bare ELSE regexp_extract(bare, '([^.]+[.][^.]+)$', 1) END AS domain, regexp_extract(bare, '([^.]*)$', 1) AS suffix FROM h),
d AS (SELECT domain, suffix, sum(n) AS n, sum(bad) AS bad FROM h2 GROUP BY ALL),
s AS (SELECT suffix, sum(n) AS n, sum(bad) AS bad FROM d GROUP BY ALL),
a AS (SELECT 'h' AS l, n, bad FROM h2 UNION ALL SELECT 'd', n, bad FROM d UNION ALL SELECT 's', n, bad FROM s),
m AS (SELECT l, sum(n)::DOUBLE AS nn, sum(bad)::DOUBLE AS x, sum(n * n)::DOUBLE AS n2, round(sum(bad * bad / n::DOUBLE), 9) AS q, count(*) AS g FROM a GROUP BY l),
r AS (SELECT l, x / nn AS rate, CASE WHEN x / nn * (1 - x / nn) = 0 THEN NULL ELSE ((q - x * (x / nn)) / (x / nn * (1 - x / nn)) - (g - 1)) / nullif(nn - n2 / nn - (g - 1), 0) END AS rho FROM m),
k AS (SELECT l, rate, CASE WHEN rho > 0 THEN greatest(1.0, least(1000000.0, 1 / rho - 1)) ELSE 1000000.0 END AS k FROM r),
sm AS (SELECT suffix, (bad + k * rate) / (n + k) AS mean FROM s, k WHERE l = 's'),
dm AS (SELECT domain, suffix, (bad + k * sm.mean) / (n + k) AS mean FROM d JOIN sm USING (suffix), k WHERE l = 'd'),
hm AS (SELECT host, n + k AS w, (bad + k * dm.mean) / (n + k) AS mean FROM h2 JOIN dm USING (domain, suffix), k WHERE l = 'h'),
v AS (SELECT host, mean - 1.645 * sqrt(mean * (1 - mean) / (w + 1)) AS lower FROM hm)
SELECT page_id, host, path,
       CASE WHEN (host = 'www.example.com' OR host LIKE '%.www.example.com') AND starts_with(path, '/en/') THEN 'www.example.com/en/'
            WHEN (host = 'example.com' OR host LIKE '%.example.com') AND starts_with(path, '/en/') THEN 'example.com/en/'
            WHEN (host = 'net' OR host LIKE '%.net') AND starts_with(path, '/fr/') THEN 'net/fr/'
            WHEN (host = 'net' OR host LIKE '%.net') AND starts_with(path, '/es/') THEN 'net/es/'
            WHEN (host = 'com' OR host LIKE '%.com') AND starts_with(path, '/') THEN 'com/' END AS rule,
       CASE WHEN rule IN ('www.example.com/en/', 'com/') THEN 'allow' WHEN rule IS NOT NULL THEN 'block' WHEN lower >= 0.5 THEN 'block' ELSE 'allow' END AS verdict
FROM u LEFT JOIN v USING (host)
"""

_OP8 = r"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, md5(array_to_string(w[i:i + 4], ' ')) AS k FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 2))) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
links AS (SELECT a, b FROM (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM s x JOIN s y USING (k) WHERE x.doc_id <> y.doc_id GROUP BY ALL) JOIN n na ON a = na.doc_id JOIN n nb ON b = nb.doc_id WHERE 100 * c >= 80 * (na.n + nb.n - c)),
reach AS (SELECT doc_id AS a, doc_id AS b FROM d UNION SELECT reach.a, links.b FROM reach JOIN links ON reach.b = links.a)
SELECT doc_id, coalesce(n, 0)::BIGINT AS n_shingles, c AS component_id FROM (SELECT a AS doc_id, min(b) AS c FROM reach GROUP BY a) LEFT JOIN n USING (doc_id)
"""

# Whatever shard a document ends up in: it is there once, and as it was.
_OP10 = "SELECT doc_id, coalesce((doc_id % 16 + 16) % 16, 0)::BIGINT AS arrival, sha256(coalesce(text, '')) AS text_sha256 FROM documents"

_OP11 = """
WITH v AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS q FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0),
s AS (SELECT a.vec_id AS a, b.vec_id AS b, a.label = b.label AS same, list_dot_product(a.q, b.q)::BIGINT AS score FROM v a JOIN v b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id AND len(a.q) = len(b.q)),
p AS (SELECT a, b, score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY a ORDER BY score DESC, b) <= 5)
SELECT p.a AS anchor_id, p.b AS positive_id, row_number() OVER (PARTITION BY p.a, p.b ORDER BY s.score DESC, s.b)::INTEGER AS rank, s.b AS negative_id, p.score AS positive_score, s.score AS negative_score
FROM p JOIN s ON s.a = p.a AND NOT s.same AND 80 * p.score <= 100 * s.score AND s.score <= p.score QUALIFY rank <= 5
"""

# Pairs of places that begin the same six words, in rows of consecutive ones, are stretches with a period; of stretches that are one, the smallest period counts.
_OP12 = r"""
WITH crc AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w,
    xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(doc_id::VARCHAR, ''), lambda c: ascii(c)::BIGINT)),
      lambda c, b: list_reduce(list_prepend(xor(c, b), range(8)), lambda x, k: CASE WHEN x % 2 = 1 THEN xor(x // 2, 3988292384::BIGINT) ELSE x // 2 END)), 4294967295::BIGINT) AS h FROM documents),
plan AS (SELECT *, (h // 10) AS g, len(w)::BIGINT AS n FROM crc),
cut AS (SELECT *, CASE WHEN n > 0 THEN g % n ELSE 0 END AS a, CASE WHEN n > 0 THEN 1 + (n - g % n) // (3 + g % 8) ELSE 1 END AS p FROM plan),
d AS (SELECT r, doc_id, CASE WHEN h % 10 = 0 AND n > 0 THEN list_transform(range(n), lambda i: w[1 + CASE WHEN i >= a THEN a + (i - a) % p ELSE i END]) ELSE w END AS w FROM cut),
six AS (SELECT r, i, array_to_string(w[i + 1:i + 6], ' ') AS k FROM (SELECT r, w, unnest(range(0, len(w) - 5)) AS i FROM d WHERE len(w) >= 12)),
pairs AS (SELECT x.r, x.i, y.i - x.i AS q, x.i - row_number() OVER (PARTITION BY x.r, y.i - x.i ORDER BY x.i) AS island FROM six x JOIN six y ON x.r = y.r AND x.k = y.k AND x.i < y.i),
stretches AS (SELECT r, q, min(i) AS start, count(*) + 5 + q AS length FROM pairs GROUP BY r, q, island HAVING count(*) + 5 >= greatest(q, 12 - q)),
short AS (SELECT six.r, start, length, min(q) AS period FROM stretches JOIN (SELECT DISTINCT r FROM six) six USING (r) GROUP BY ALL),
digest AS (SELECT r, count(*) AS n_runs, arg_min(struct_pack(start, length, period), struct_pack(a := -length, b := start, c := period)) AS best, string_agg(start || ',' || length || ',' || period || chr(10), '' ORDER BY start, period) AS t FROM short GROUP BY r),
gone AS (SELECT DISTINCT r, unnest(range(start + period, start + length)) AS i FROM short),
kept AS (SELECT r, string_agg(w[i + 1], ' ' ORDER BY i) AS t FROM (SELECT r, w, unnest(range(len(w))) AS i FROM d SEMI JOIN digest USING (r)) ANTI JOIN gone USING (r, i) GROUP BY r)
SELECT doc_id, coalesce(n_runs, 0)::BIGINT AS n_runs, best.start::BIGINT AS start, best.length::BIGINT AS length, best.period::BIGINT AS period, (1000 * best.length // best.period)::BIGINT AS exponent_milli,
       sha256(coalesce(digest.t, '')) AS runs_sha256, sha256(CASE WHEN n_runs IS NULL THEN array_to_string(w, ' ') ELSE coalesce(kept.t, '') END) AS collapsed_sha256
FROM d LEFT JOIN digest USING (r) LEFT JOIN kept USING (r)
"""

ORACLE_SQL: dict[str, str] = {"op1_pca_tiles": _OP1, "op2_word_window_dedup": _OP2, "op4_suffix_dedup": _OP4, "op7_url_reputation": _OP7, "op8_ngram_jaccard": _OP8, "op10_tiered_shards": _OP10, "op11_hard_negatives": _OP11, "op12_periodic_runs": _OP12}
