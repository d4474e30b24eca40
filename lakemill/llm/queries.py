"""The queries of these operators over whole tables, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lakemill.sources.readers import spread

from .tokens import vocabulary

URL_RULES = [
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
]


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return spread(rows) if name in ("documents", "pages") else rows


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality_rules import quality_rules

    return quality_rules(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels")).drop("rejected_by", "ra", "rb")


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .language_id import fit, predict

    docs = _table(spark, sf_dir, "documents")
    held_out = F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(4)) == 2, F.lit(False))
    return predict(docs, fit(docs, ~held_out), held_out)


def op3_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .packing import best_fit_packing

    return best_fit_packing(_table(spark, sf_dir, "documents"), vocabulary())


def op4_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .suffix_dedup import suffix_dedup

    return suffix_dedup(_table(spark, sf_dir, "documents")).drop("text", "carried")


def op5_bpe_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .chunk_encoding import encode_decode

    return encode_decode(_table(spark, sf_dir, "documents"), vocabulary())


def op6_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .token_files import token_digests

    return token_digests(_table(spark, sf_dir, "documents"), vocabulary())


def op7_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .url_filters import url_verdicts

    return url_verdicts(_table(spark, sf_dir, "pages"), URL_RULES)


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .simhash import near_duplicates

    return near_duplicates(_table(spark, sf_dir, "documents"))


def op9_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .topk import top_k

    return top_k(_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_lines, n_removed, n_runs, kept_sha256 of every document."""
    from .line_dedup import line_dedup

    done = line_dedup(_table(spark, sf_dir, "documents"))
    return done.select("doc_id", "n_lines", "n_removed", "n_runs", F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("kept_sha256"))


def op10_line_dedup_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op10_line_dedup with lines of a passage's length as runs by themselves."""
    from .line_dedup import PASSAGE_WORDS, line_dedup

    done = line_dedup(_table(spark, sf_dir, "documents"), passage_words=PASSAGE_WORDS)
    return done.select("doc_id", "n_lines", "n_removed", "n_runs", F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("kept_sha256"))


QUERIES = {f.__name__: f for f in (op1_quality_rules, op2_language_id, op3_best_fit_packing, op4_suffix_array_dedup, op5_bpe_chunks, op6_token_files, op7_url_filters, op8_simhash, op9_exact_topk, op10_line_dedup, op10_line_dedup_passages)}


SQL = {
    # cutoffs: alpha 0.01, delta 0.05, cost 20, 5 rules, 50 bins; a trial is a distinct text; the tail is summed over the terms of the exact binomial
    "op1_quality_rules": r"""
WITH t AS (SELECT doc_id, lang, coalesce(text, '') AS t, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w, list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l FROM documents),
g AS (SELECT doc_id, unnest(range(1, len(w) - 1)) AS i, unnest(list_transform(range(1, len(w) - 1), lambda i: md5(w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]))) AS s FROM t WHERE len(w) >= 3),
r AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, s) AS n FROM g),
c AS (SELECT doc_id, count(DISTINCT i + j) AS n FROM r, (SELECT unnest([0, 1, 2]) AS j) WHERE r.n > 1 GROUP BY doc_id),
k AS (SELECT t.doc_id, lang, md5(t) AS copy, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(list_sum(list_transform(w, lambda x: length(x))), 0) AS BIGINT) AS word_chars, CAST(length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols, CAST(len(l) - len(list_distinct(l)) AS BIGINT) AS n_dup_lines, CAST(coalesce(c.n, 0) AS BIGINT) AS n_repeat_words, len(l) AS n_lines, length(t) - length(replace(t, '!', '')) AS n_exclaims, length(t) - length(replace(t, '|', '')) AS n_bars FROM t LEFT JOIN c ON t.doc_id = c.doc_id),
b AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed, [struct_pack(rule := 'symbols', v := n_symbols / nullif(word_chars, 0)), struct_pack(rule := 'exclamations', v := n_exclaims / nullif(word_chars, 0)), struct_pack(rule := 'bars', v := n_bars / nullif(n_words, 0)), struct_pack(rule := 'repeats', v := n_repeat_words / nullif(n_words, 0)), struct_pack(rule := 'repeated_lines', v := n_dup_lines / nullif(n_lines, 0))] AS vs FROM k),
x AS (SELECT doc_id, lang, copy, base_failed, u.rule AS rule, CAST(least(50, floor(coalesce(50 * u.v, 0))) AS INTEGER) AS bin FROM (SELECT doc_id, lang, copy, base_failed, unnest(vs) AS u FROM b)),
trials AS (SELECT lang, copy, rule, bin, bool_or(quality > 0) AS good FROM x JOIN labels ON x.doc_id = labels.doc_id WHERE NOT base_failed AND quality IS NOT NULL GROUP BY ALL),
h AS (SELECT lang, rule, bin, count(*) FILTER (good) AS good, count(*) FILTER (NOT good) AS bad FROM trials GROUP BY ALL),
a AS (SELECT lang, rule, bin, sum(good) OVER d AS lost, sum(bad) OVER d AS caught, sum(good) OVER (PARTITION BY lang, rule) AS n FROM h WINDOW d AS (PARTITION BY lang, rule ORDER BY bin DESC)),
s AS (SELECT count(*) AS strata FROM (SELECT DISTINCT lang FROM h)),
p AS (SELECT a.*, strata, (SELECT sum(exp(CASE WHEN i = 0 THEN a.n * ln(0.99) ELSE lgamma(a.n + 1) - lgamma(i + 1) - lgamma(a.n - i + 1) + i * ln(0.01) + (a.n - i) * ln(0.99) END)) FROM (SELECT CAST(unnest(range(0, CAST(a.lost AS BIGINT) + 1)) AS DOUBLE) AS i)) AS tail FROM a, s WHERE bin > 0 AND n > 0),
best AS (SELECT lang, rule, arg_max(bin, struct_pack(g := caught - 20.0 * lost, b := bin)) AS cutoff FROM p WHERE tail <= 0.05 / (strata * 5) AND caught - 20.0 * lost > 0 GROUP BY lang, rule),
hit AS (SELECT DISTINCT x.doc_id FROM x JOIN best ON x.lang IS NOT DISTINCT FROM best.lang AND x.rule = best.rule WHERE bin >= cutoff)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND doc_id NOT IN (SELECT doc_id FROM hit) AS kept FROM b
""",
    "op4_suffix_array_dedup": r"""
WITH d AS (SELECT doc_id, encode(coalesce(text, '')) AS b, hex(encode(coalesce(text, ''))) AS x FROM documents), q AS (SELECT doc_id, q, n, substr(x, 2 * q + 1, 1398) AS x FROM (SELECT doc_id, x, octet_length(b) AS n, unnest(range(0, octet_length(b) - 199, 500)) AS q FROM d WHERE octet_length(b) >= 200)),
w AS (SELECT doc_id, q + p AS p, md5(substr(x, 2 * p + 1, 400)) AS s FROM (SELECT doc_id, q, x, unnest(range(0, least(500, n - 199 - q))) AS p FROM q)),
r AS (SELECT doc_id, p FROM w WHERE s IN (SELECT s FROM w GROUP BY s HAVING count(*) > 1)),
o AS (SELECT doc_id, p, max(p) OVER (PARTITION BY doc_id ORDER BY p ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) + 200 AS reach FROM r),
i AS (SELECT doc_id, p, sum(CASE WHEN reach IS NULL OR p > reach THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY p) AS isl FROM o),
z AS (SELECT doc_id, isl, min(p) AS a, max(p) + 200 AS e FROM i GROUP BY ALL),
k AS (SELECT doc_id, list(struct_pack(a := a, e := e) ORDER BY a) AS z FROM z GROUP BY doc_id),
j AS (SELECT d.doc_id, b, coalesce(z, []) AS z FROM d LEFT JOIN k ON d.doc_id = k.doc_id)
SELECT doc_id, octet_length(b) AS n_bytes, CAST(coalesce(list_sum(list_transform(z, lambda x: x.e - x.a)), 0) AS BIGINT) AS n_removed, CAST(len(z) AS BIGINT) AS n_spans,
sha256(unhex(array_to_string(list_transform(range(0, len(z) + 1), lambda n: hex(b)[2 * (CASE WHEN n = 0 THEN 0 ELSE z[n].e END) + 1 : 2 * (CASE WHEN n = len(z) THEN octet_length(b) ELSE z[n + 1].a END)]), ''))) AS kept_sha256 FROM j
""",
    "op7_url_filters": r"""
WITH cut AS (SELECT page_id, CASE WHEN position('://' IN coalesce(url, '')) > 0 THEN regexp_replace(substr(url, position('://' IN url) + 3), '[?#](.|\n)*$', '') ELSE '' END AS rest FROM pages),
split AS (SELECT page_id, translate(CASE WHEN position('/' IN rest) > 0 THEN substr(rest, 1, position('/' IN rest) - 1) ELSE rest END, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, CASE WHEN position('/' IN rest) > 0 THEN substr(rest, position('/' IN rest)) ELSE '' END AS path FROM cut),
rules(verdict, rule_host, rule_path) AS (VALUES ('allow', 'com', '/'), ('block', 'example.com', '/en/'), ('allow', 'www.example.com', '/en/'), ('block', 'net', '/es/'), ('block', 'net', '/fr/')),
fits AS (SELECT page_id, rule_host || rule_path AS rule, verdict, row_number() OVER (PARTITION BY page_id ORDER BY length(rule_host || rule_path) DESC) AS r FROM split JOIN rules ON (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path))
SELECT split.page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM split LEFT JOIN fits ON split.page_id = fits.page_id AND r = 1
""",
    "op9_exact_topk": r"""
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS e FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_dot_product(q.e, c.e) AS BIGINT) AS score FROM v q JOIN v c ON q.vec_id <> c.vec_id AND len(q.e) = len(c.e) WHERE q.vec_id % 50 = 0),
r AS (SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
""",
    "op10_line_dedup": r"""
WITH raw AS (SELECT doc_id, text, unnest(string_split(coalesce(text, ''), chr(10))) AS x, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS i FROM documents),
l AS (SELECT doc_id, i, x, row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1 AS pos FROM raw WHERE regexp_matches(x, '[^\x20\x09-\x0D]')),
runs AS (SELECT doc_id, pos, x, lead(x) OVER (PARTITION BY doc_id ORDER BY pos) AS y FROM l),
later AS (SELECT doc_id, pos, row_number() OVER (PARTITION BY x, y ORDER BY doc_id, pos) AS copy FROM runs WHERE y IS NOT NULL),
gone AS (SELECT DISTINCT doc_id, pos FROM (SELECT doc_id, pos FROM later WHERE copy > 1 UNION ALL SELECT doc_id, pos + 1 FROM later WHERE copy > 1)),
per AS (SELECT l.doc_id, count(*) AS n_lines, count(g.pos) AS n_removed, count(CASE WHEN g.pos IS NOT NULL AND b.pos IS NULL THEN 1 END) AS n_runs FROM l LEFT JOIN gone g ON l.doc_id = g.doc_id AND l.pos = g.pos LEFT JOIN gone b ON l.doc_id = b.doc_id AND l.pos - 1 = b.pos GROUP BY l.doc_id),
kept AS (SELECT raw.doc_id, string_agg(raw.x, chr(10) ORDER BY raw.i) AS t FROM raw LEFT JOIN l ON raw.doc_id = l.doc_id AND raw.i = l.i LEFT JOIN gone g ON l.doc_id = g.doc_id AND l.pos = g.pos WHERE g.pos IS NULL GROUP BY raw.doc_id)
SELECT d.doc_id, CAST(coalesce(n_lines, 0) AS BIGINT) AS n_lines, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, CAST(coalesce(n_runs, 0) AS BIGINT) AS n_runs, sha256(coalesce(kept.t, '')) AS kept_sha256
FROM documents d LEFT JOIN per ON d.doc_id = per.doc_id LEFT JOIN kept ON d.doc_id = kept.doc_id
""",
}
