"""Web captures, opt-out, HTML, conversations and preferences."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import hashing as H
from ..functions import text as T
from ..functions import urls as U
from ..operators import chat as C
from ..operators import nested as N
from ..operators import pages as P
from ..operators import web as W
from .registry import query, table

_URL = r"WITH p AS (SELECT page_id, url, lower(regexp_extract(url, '^[A-Za-z]+://([^/?#:]*)', 1)) AS h, regexp_extract(url, '^[A-Za-z]+://[^/?#]*([^?#]*)', 1) AS path, html FROM pages)"


def captures(spark, sf_dir):
    """Each page as if captured once, with the coordinates a crawl index has; derived from page_id so that SQL can too."""
    i = F.col("page_id")
    return table(spark, sf_dir, "pages").select("page_id", "url", U.host(F.col("url")).alias("host"), F.md5((i % 40).cast("string").cast("binary")).alias("digest"), F.concat(F.lit("u"), (i % 60).cast("string")).alias("canonical"), F.when(i % 23 == 0, 404).otherwise(200).alias("status"), F.when(i % 29 == 0, "application/pdf").otherwise("text/html").alias("mime"), (i % 31 == 0).alias("truncated"), (i * 37 % 5000).alias("length"), (i * 7919 % 100000).alias("epoch"), (i % 3).alias("priority"), F.md5(i.cast("string").cast("binary")).alias("sample_hash"))


_CAP = _URL + r", c AS (SELECT page_id, url, h AS host, md5(CAST(page_id % 40 AS VARCHAR)) AS digest, 'u' || page_id % 60 AS canonical, CASE WHEN page_id % 23 = 0 THEN 404 ELSE 200 END AS status, CASE WHEN page_id % 29 = 0 THEN 'application/pdf' ELSE 'text/html' END AS mime, page_id % 31 = 0 AS truncated, page_id * 37 % 5000 AS length, page_id * 7919 % 100000 AS epoch, page_id % 3 AS priority, md5(CAST(page_id AS VARCHAR)) AS sample_hash FROM p)"


def crawl_rows(spark, sf_dir):
    """Rows of a crawl index with each of their fields wrong in some."""
    i, d = F.col("page_id"), F.col("page_id") % 37
    digest = F.upper(F.translate(F.substring(F.concat(F.md5(i.cast("string").cast("binary")), F.md5("url")), 1, 32), "01989", "abcde"))
    return table(spark, sf_dir, "pages").select(
        "page_id", F.when(d == 15, "not a url").otherwise(F.col("url")).alias("url"), F.when(d == 1, 404).otherwise(200).alias("status"), F.when(d == 2, "length").alias("truncated"),
        F.when(d == 3, "xyz").otherwise(F.concat(F.lit("SHA1:"), digest)).alias("digest"), F.when(d.isin(4, 5), "application/pdf").otherwise("Text/HTML; charset=utf-8").alias("mime_sent"), F.when(d == 4, "image/png").otherwise("text/plain").alias("mime_found"),
        F.when(d == 6, "deu,fra").otherwise("fra, ENG").alias("languages"), F.when(d == 7, -1).when(d == 8, None).otherwise(10).cast("bigint").alias("offset"), F.when(d == 9, 100).otherwise(2000).cast("bigint").alias("length"),
        F.when(d == 10, "crawl-data/C/../x.warc.gz").when(d == 11, "elsewhere/x.warc.gz").otherwise("crawl-data/C/x.warc.gz").alias("file"), F.when(d == 12, None).when(d == 13, "2020-01-01 00:00:00").when(d == 14, "2031-01-01 00:00:00").otherwise("2025-06-01 00:00:00").cast("timestamp").alias("fetched"), F.lit("com").alias("suffix"),
    )


_TOKENS = lambda words: "[" + ", ".join(f"'{w}'" for w in words) + "]"
_CATEGORY = "CASE WHEN ends_with(h, '.gov') OR contains(h, '.gov.') THEN 'government' WHEN ends_with(h, '.edu') THEN 'education' " + " ".join(f"WHEN list_has_any(regexp_split_to_array(h, '[._-]') || regexp_split_to_array(lower(path), '[/._-]'), {_TOKENS(words)}) THEN '{name}'" for name, words in U.CATEGORY_TOKENS) + f" WHEN regexp_matches(lower(path), '{U.DATE_PATH}') THEN 'reporting' ELSE 'general' END"
_GATES = _URL + rf""", o AS (SELECT p.page_id, min(CASE WHEN rule_path IS NULL THEN 0 ELSE 1 END) AS out FROM p JOIN OPT ON (p.h = rule_host OR ends_with(p.h, '.' || rule_host)) AND FITS GROUP BY p.page_id),
g AS (SELECT p.page_id, CASE WHEN p.page_id % 37 = 1 THEN 'http_status' WHEN p.page_id % 37 = 2 THEN 'content_truncated' WHEN p.page_id % 37 = 3 THEN 'missing_or_invalid_digest' WHEN p.page_id % 37 = 4 THEN 'mime' WHEN p.page_id % 37 = 6 THEN 'language' WHEN p.page_id % 37 = 15 THEN 'malformed_metadata' WHEN ends_with(h, 'example.net') THEN 'domain_denied'
 WHEN out = 0 THEN 'common_crawl_opt_out_domain' WHEN out = 1 THEN 'common_crawl_opt_out_url' WHEN regexp_matches(CANON, '{U.REJECTED_PATH}') THEN 'url_pattern' WHEN p.page_id % 37 = 8 THEN 'malformed_metadata' WHEN p.page_id % 37 IN (7, 9) THEN 'range_bounds' WHEN p.page_id % 37 IN (10, 11) THEN 'warc_path' WHEN p.page_id % 37 = 12 THEN 'malformed_metadata' WHEN p.page_id % 37 = 13 THEN 'capture_before_freshness_cutoff' WHEN p.page_id % 37 = 14 THEN 'capture_after_freshness_cutoff' WHEN NOT list_contains(['general', 'technical', 'science', 'software', 'official_docs'], {_CATEGORY}) THEN 'route_category' END AS reason FROM p LEFT JOIN o ON p.page_id = o.page_id)"""
#: DuckDB: the registry's rules, and when one fits.
_RULES = "(VALUES ('ththre.example.com', NULL, NULL, false, false), ('example.org', NULL, NULL, false, false), ('example.net', '/en', NULL, false, false), ('example.com', '/de/1', NULL, true, false), ('example.com', '/fr', 'page=1', false, false), ('example.com', '/', 'page=2', true, true)) AS opt(rule_host, rule_path, rule_query, path_prefix, query_prefix)"
_FITS = "(rule_path IS NULL OR ((CASE WHEN path_prefix THEN starts_with(NPATH, rule_path) ELSE NPATH = rule_path OR starts_with(NPATH, rtrim(rule_path, '/') || '/') END) AND (rule_query IS NULL OR CASE WHEN query_prefix THEN starts_with(regexp_extract(url, '^[^?#]*\\?([^#]*)', 1), rule_query) ELSE regexp_extract(url, '^[^?#]*\\?([^#]*)', 1) = rule_query END)))".replace("NPATH", r"CASE WHEN regexp_matches('/' || path, '^/+$') THEN '/' ELSE regexp_replace(regexp_replace('/' || path, '/+', '/', 'g'), '/+$', '') END")
_CANON_URL = r"(h || CASE WHEN regexp_matches('/' || path, '^/+$') THEN '/' ELSE regexp_replace(regexp_replace('/' || path, '/+', '/', 'g'), '/+$', '') END || CASE WHEN contains(url, '?') THEN regexp_extract(url, '(\?[^#]*)', 1) ELSE '' END)"
_GATES = _GATES.replace("OPT ON", _RULES + " ON").replace("FITS", _FITS).replace("CANON", _CANON_URL)


def opt_out(spark):
    """Rules read from a registry's entries."""
    registry = spark.createDataFrame([("* ththre.example.com, https://www.nobody.invalid@x",), ("<example.org>;\nhttps://*.example.net/en",), ("example.com/de/1*",), ("example.com/fr?page=1 example.com/*?page=2*",)], "entries string")
    return W.opt_out_rules(registry, "entries")


@query(_GATES + " SELECT page_id, reason FROM g")
def f6_f7_crawl_gates(spark, sf_dir):
    """The first of 16 reasons, cheap metadata first; the opt-out policy judges the address as captured."""
    return _gated(spark, sf_dir).select("page_id", "reason")


def _gated(spark, sf_dir):
    rows = crawl_rows(spark, sf_dir)
    told = W.opt_out_reasons(rows, opt_out(spark), "page_id").withColumnRenamed("reason", "opted")
    reason = W.gate_reason("C", denied=["example.net"], categories=["general", "technical", "science", "software", "official_docs"], first_day="2024-01-01", last_day="2030-12-31", opted=F.col("opted"))
    return rows.join(told, "page_id", "left").withColumn("reason", reason)


@query(_GATES + " SELECT reason, count(*) AS n FROM g WHERE reason IS NOT NULL GROUP BY reason UNION ALL SELECT 'scanned', count(*) FROM g")
def f7_a25_gate_tallies(spark, sf_dir):
    return W.gate_tallies(_gated(spark, sf_dir), F.col("reason"))


@query(_CAP + r""", u AS (SELECT * FROM c QUALIFY row_number() OVER (PARTITION BY canonical ORDER BY priority DESC, length >= 1024 DESC, epoch DESC, length DESC, sample_hash) = 1) SELECT page_id, canonical, digest FROM u QUALIFY row_number() OVER (PARTITION BY digest ORDER BY priority DESC, length >= 1024 DESC, epoch DESC, length DESC, sample_hash) = 1""")
def a24_w1_url_then_digest_winners(spark, sf_dir):
    return W.capture_winners(captures(spark, sf_dir)).select("page_id", "canonical", "digest")


@query(_URL + f", o AS (SELECT p.page_id, min(CASE WHEN rule_path IS NULL THEN 0 ELSE 1 END) AS out FROM p JOIN {_RULES} ON (p.h = rule_host OR ends_with(p.h, '.' || rule_host)) AND {_FITS} GROUP BY p.page_id) SELECT page_id, CASE out WHEN 0 THEN 'common_crawl_opt_out_domain' ELSE 'common_crawl_opt_out_url' END AS reason FROM o")
def f8_j8_opt_out(spark, sf_dir):
    """Hosts meet rules by an equal domain suffix, so no rule is compared with every page."""
    return W.opt_out_reasons(table(spark, sf_dir, "pages"), opt_out(spark), "page_id")


_FIELDS = r"WITH f AS (SELECT page_id, CASE WHEN page_id % 3 = 0 THEN '' ELSE 'http://fine.example.edu/x' END AS a, CASE WHEN page_id % 2 = 0 THEN url END AS b, CASE WHEN page_id % 5 = 0 THEN 'https://sub.example.org/' END AS c FROM pages), e AS (SELECT page_id, 0 AS pos, a AS url FROM f WHERE trim(a) <> '' UNION ALL SELECT page_id, 1, b FROM f WHERE b IS NOT NULL UNION ALL SELECT page_id, 2, c FROM f WHERE c IS NOT NULL), p AS (SELECT page_id, pos, url, lower(regexp_extract(url, '^[A-Za-z]+://([^/?#:]*)', 1)) AS h, regexp_extract(url, '^[A-Za-z]+://[^/?#]*([^?#]*)', 1) AS path FROM e)"


@query(_FIELDS + f", o AS (SELECT page_id, pos, any_value(url) AS url, min(CASE WHEN rule_path IS NULL THEN 0 ELSE 1 END) AS out FROM p JOIN {_RULES} ON (p.h = rule_host OR ends_with(p.h, '.' || rule_host)) AND {_FITS} GROUP BY page_id, pos) SELECT page_id, arg_min(CASE out WHEN 0 THEN 'final_common_crawl_opt_out_domain' ELSE 'final_common_crawl_opt_out_url' END, pos) AS reason, arg_min(url, pos) AS url FROM o GROUP BY page_id")
def f9_final_opt_out(spark, sf_dir):
    """The first of several addresses of a row that is opted out."""
    i = F.col("page_id")
    rows = table(spark, sf_dir, "pages").select("page_id", F.when(i % 3 == 0, "").otherwise("http://fine.example.edu/x").alias("a"), F.when(i % 2 == 0, F.col("url")).alias("b"), F.when(i % 5 == 0, "https://sub.example.org/").alias("c"))
    return W.final_opt_out(rows, opt_out(spark), "page_id", ["a", "b", "c"])


_META = """'{"license": "' || CASE page_id % 11 WHEN 0 THEN 'GPL' WHEN 1 THEN '' ELSE 'MIT' END || '", "deep": [{"Source-Dataset": "' || CASE page_id % 13 WHEN 2 THEN 'openai/gsm8k' WHEN 3 THEN 'math' ELSE 'web' END || '", "eval_benchmark": ["' || CASE page_id % 17 WHEN 4 THEN 'MATH' ELSE 'none' END || '"], "links": {"url": "' || url || '", "x": "http://other.example.edu/"}}]}'"""


def _metadata():
    i = F.col("page_id")
    part = lambda *x: F.concat(*[F.lit(v) if isinstance(v, str) else v for v in x])
    return part('{"license": "', F.when(i % 11 == 0, "GPL").when(i % 11 == 1, "").otherwise("MIT"), '", "deep": [{"Source-Dataset": "', F.when(i % 13 == 2, "openai/gsm8k").when(i % 13 == 3, "math").otherwise("web"), '", "eval_benchmark": ["', F.when(i % 17 == 4, "MATH").otherwise("none"), '"], "links": {"url": "', F.col("url"), '", "x": "http://other.example.edu/"}}]}')


@query("SELECT page_id, CAST(0 AS INTEGER) AS pos, url FROM pages")
def f5_nested_urls(spark, sf_dir):
    """Addresses under known keys, however deep in the metadata."""
    return N.published_urls(table(spark, sf_dir, "pages").select("page_id", _metadata().alias("metadata")), "page_id", "metadata")


@query("SELECT page_id, CASE WHEN page_id % 13 = 2 THEN 'gsm8k' WHEN page_id % 17 = 4 THEN 'math' END AS benchmark FROM pages")
def u24_nested_lineage(spark, sf_dir):
    """Benchmarks that the metadata names; one that is an ordinary word counts only in a field of benchmarks."""
    return table(spark, sf_dir, "pages").select("page_id", N.benchmark_lineage(_metadata(), {"gsm8k": ["openai/gsm8k"], "math": []}).alias("benchmark"))


@query(_URL + f", o AS (SELECT DISTINCT p.page_id FROM p JOIN {_RULES} ON (p.h = rule_host OR ends_with(p.h, '.' || rule_host)) AND {_FITS})" + """, b AS (SELECT DISTINCT page_id FROM pages WHERE page_id % 19 = 5)
SELECT p.page_id, CASE WHEN page_id % 23 = 0 THEN 'blocked_by_hand' WHEN page_id % 13 = 2 OR page_id % 17 = 4 THEN 'benchmark_genealogy' WHEN page_id % 29 = 0 THEN 'publisher_machine_learning_opt_out' WHEN page_id % 11 = 1 THEN 'missing_per_record_license' WHEN page_id % 11 = 0 THEN 'per_record_license_not_allowed' WHEN page_id IN (SELECT page_id FROM o) THEN 'final_opt_out' WHEN NOT contains(html, 'lang="en"') THEN 'language_not_in_source_policy' WHEN length(html) < 2000 THEN 'quality_minimum_characters' WHEN page_id IN (SELECT page_id FROM b) THEN 'exact' END AS reason FROM p""")
def f3_f24_eligibility(spark, sf_dir):
    """Ordered: admission, lineage, publisher's opt-out, licence, opted-out addresses, language, quality, contamination."""
    return _eligible(spark, sf_dir)


@query(_URL + f", o AS (SELECT DISTINCT p.page_id FROM p JOIN {_RULES} ON (p.h = rule_host OR ends_with(p.h, '.' || rule_host)) AND {_FITS})" + """
SELECT p.page_id, CASE WHEN page_id % 23 = 0 THEN 'blocked_by_hand' WHEN page_id % 13 = 2 OR page_id % 17 = 4 THEN 'benchmark_genealogy' WHEN page_id % 29 = 0 THEN 'publisher_machine_learning_opt_out' WHEN page_id % 11 = 1 THEN 'missing_per_record_license' WHEN page_id % 11 = 0 THEN 'per_record_license_not_allowed' WHEN page_id IN (SELECT page_id FROM o) THEN 'final_opt_out' WHEN NOT contains(html, 'lang="en"') THEN 'language_not_in_source_policy' END AS reason FROM p""")
def f24_compliance_only(spark, sf_dir):
    """The same without quality and contamination, which come later."""
    return _eligible(spark, sf_dir, deferred=("quality", "contamination"))


def _eligible(spark, sf_dir, deferred=()):
    i = F.col("page_id")
    pages = table(spark, sf_dir, "pages").withColumn("metadata", _metadata())
    urls = N.published_urls(pages, "page_id", "metadata")
    out = W.opt_out_reasons(urls.withColumn("_k", F.struct("page_id", "pos")), opt_out(spark), "_k").select("_k.page_id").distinct().withColumn("out", F.lit(True))
    rows = pages.join(out, "page_id", "left")
    checks = {
        "admission": F.when(i % 23 == 0, "blocked_by_hand"),
        "benchmark": F.when(N.benchmark_lineage(F.col("metadata"), {"gsm8k": ["openai/gsm8k"], "math": []}).isNotNull(), "benchmark_genealogy"),
        "publisher": F.when(i % 29 == 0, "publisher_machine_learning_opt_out"),
        "license": W.license_reason(F.get_json_object("metadata", "$.license"), ["mit", "apache-2.0"]),
        "opt_out": F.when(F.col("out"), "final_opt_out"),
        "language": F.when(~F.contains("html", F.lit('lang="en"')), "language_not_in_source_policy"),
        "quality": F.when(F.length("html") < 2000, "quality_minimum_characters"),
        "contamination": F.when(i % 19 == 5, "exact"),
    }
    return rows.select("page_id", W.eligibility({k: v for k, v in checks.items() if k not in deferred}).alias("reason"))


@query(_URL + " SELECT page_id, h = 'example.com' OR ends_with(h, '.example.com') AS inside FROM p")
def f10_domain_suffix(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", U.in_domain(U.host(F.col("url")), F.lit("example.com")).alias("inside"))


@query("SELECT doc_id, len(list_filter(string_split(lower(l), ' or '), lambda x: NOT list_contains(['mit', 'apache-2.0', 'cc0-1.0'], x))) = 0 AS allowed FROM (SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN 'MIT' WHEN 1 THEN 'Apache-2.0 OR MIT' WHEN 2 THEN 'MIT OR GPL-3.0' ELSE 'CC0-1.0' END AS l FROM documents)")
def f4_license_allow_list(spark, sf_dir):
    m = F.col("doc_id") % 4
    lic = F.when(m == 0, "MIT").when(m == 1, "Apache-2.0 OR MIT").when(m == 2, "MIT OR GPL-3.0").otherwise("CC0-1.0")
    return table(spark, sf_dir, "documents").select("doc_id", W.license_allowed(lic, ["mit", "apache-2.0", "cc0-1.0"]).alias("allowed"))


@query()
def t37_body_text(spark, sf_dir):
    """Words in the text of the body without scripts and navigation, by a parser; tested against expectations by hand."""
    return P.read_texts(table(spark, sf_dir, "pages"), "page_id", "html").select("page_id", T.number_of(F.regexp_replace("body", "&[a-z]+;", " "), "[A-Za-z]+").alias("words"))


@query()
def t38_visible_text(spark, sf_dir):
    """Lines that a reader sees; with language, canonical address and robots' directives of the page; tested against expectations by hand."""
    return P.read_texts(table(spark, sf_dir, "pages"), "page_id", "html").select("page_id", "visible", "lang", "canonical", "robots")


def evidenced(spark, sf_dir):
    """Pages with evidence of each kind put into their heads."""
    i = F.col("page_id")
    head = F.concat(
        F.when(i % 2 == 0, '<link rel="canonical" href="/p">').otherwise(""), F.when(i % 3 == 0, '<meta name="dc.rights" content="CC BY 4.0">').when(i % 3 == 1, '<a rel="license" href="https://creativecommons.org/licenses/by-nc/4.0/">x</a>').otherwise(""),
        F.when(i % 5 == 0, '<script type="application/ld+json">{"@type": "Article", "datePublished": "12 March 2021", "version": 3}</script>').when(i % 5 == 1, '<time class="published" datetime="2020/1/5">').otherwise(""), F.when(i % 7 == 0, "<title>Docs 2.1.0</title>").otherwise(""), F.when(i % 11 == 0, '<meta name="robots" content="noai, index">').otherwise(""),
    )
    return table(spark, sf_dir, "pages").select("page_id", "url", F.concat(head, "html").alias("html"))


_DATES = "CASE WHEN page_id % 5 = 0 THEN DATE '2021-03-12' WHEN page_id % 5 = 1 THEN DATE '2020-01-05' END"


@query(f"SELECT page_id, CASE WHEN page_id % 3 = 0 THEN 'cc_by_or_cc_by_sa' END AS license_rule, {_DATES} AS publication_date, page_id % 5 = 0 AS explicit_version, page_id % 7 = 0 AS titled_version, page_id % 2 = 0 AS canonical, page_id % 11 = 0 AS opted FROM pages")
def t41_page_evidence(spark, sf_dir):
    """Licence, date, version and canonical address from tags, attributes and JSON-LD."""
    rows = P.read_pages(evidenced(spark, sf_dir), "page_id", "html", "url").join(table(spark, sf_dir, "pages").select("page_id", "url"), "page_id")
    none = F.array().cast("array<string>")
    out = P.page_evidence(rows, F.col("url"), none, none)
    return out.select("page_id", "license_rule", "publication_date", F.array_contains("versions", "3").alias("explicit_version"), F.array_contains("versions", "2.1.0").alias("titled_version"), F.coalesce(F.endswith(F.col("declared_canonical"), F.lit("/p")), F.lit(False)).alias("canonical"), F.array_contains("page.robots", "noai").alias("opted"))


@query()
def t36_t39_structured_html(spark, sf_dir):
    """Headings, lists, tables and code kept as text, navigation left out; with the structural score, and the reasons for English (t40)."""
    rows = P.read_pages(table(spark, sf_dir, "pages"), "page_id", "html")
    none = F.array().cast("array<string>")
    return rows.select("page_id", F.col("page.text").alias("text"), P.structural_quality(F.col("page")).alias("s"), P.english_reasons(F.col("page"), none, none).alias("reasons")).select("page_id", "text", "s.score", "s.passed", "reasons")


@query("SELECT page_id, list_filter([CASE WHEN page_id % 2 = 0 THEN 'url_index_eng' END, CASE WHEN page_id % 3 = 0 THEN 'html_lang_en' END, CASE WHEN page_id % 5 = 0 THEN 'http_content_language_en' END, CASE WHEN page_id % 7 = 0 THEN 'latin_text_with_common_english_words' END], lambda x: x IS NOT NULL) AS reasons FROM pages")
def t40_english_reasons(spark, sf_dir):
    """From the index, the page's own tags, the header, and the text."""
    i = F.col("page_id")
    html = F.concat(F.when(i % 3 == 0, '<html lang="en-GB">').otherwise('<html lang="de">'), F.when(i % 7 == 0, "<p>this is the text of that page and it has words from here").otherwise("<p>dies ist der Text"))
    rows = P.read_pages(table(spark, sf_dir, "pages").select("page_id", html.alias("html")), "page_id", "html")
    langs = lambda n, yes: F.when(i % n == 0, F.array(F.lit(yes))).otherwise(F.array(F.lit("de")))
    return rows.select("page_id", P.english_reasons(F.col("page"), langs(2, "eng"), langs(5, "en")).alias("reasons"))


@query(f"""WITH p AS (SELECT page_id, page_id % 13 AS d FROM pages) SELECT page_id, CASE d WHEN 1 THEN 'malformed_warc' WHEN 2 THEN 'bodyless_revisit' WHEN 3 THEN 'not_response' WHEN 4 THEN 'warc_http_status' WHEN 5 THEN 'warc_digest_header' WHEN 6 THEN 'warc_target_uri' WHEN 7 THEN 'warc_payload_digest' WHEN 8 THEN 'extracted_mime' WHEN 9 THEN 'publisher_machine_learning_opt_out' WHEN 10 THEN 'too_short' WHEN 11 THEN 'missing_reusable_open_license' END AS reason FROM p""")
def f17_capture_acceptance(spark, sf_dir):
    """Archive members with each of their parts wrong in some: records, digests, addresses, kinds, robots, length and licence."""
    members = P.made_members(table(spark, sf_dir, "pages"))
    rows = P.read_captures(members, "page_id", "member", "digest", "canonical")
    out = P.page_evidence(rows, F.col("target"), F.array(F.lit("eng")), F.coalesce("http_languages", F.array().cast("array<string>")))
    return out.select("page_id", P.acceptance_reason(out, F.col("digest"), F.col("canonical"), 100, require_license=True).alias("reason"))


@query(r"""WITH r AS (SELECT page_id % 8 AS file, page_id * 1000 AS start, page_id * 1000 + 300 + page_id * 37 % 2500 AS stop FROM pages), l AS (SELECT *, max(stop) OVER (PARTITION BY file ORDER BY start, stop ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM r), i AS (SELECT *, sum(CASE WHEN reach IS NULL OR start > reach + 5500 THEN 1 ELSE 0 END) OVER (PARTITION BY file ORDER BY start, stop) AS isl FROM l)
SELECT file, min(start) AS start, max(stop) AS stop, count(*) AS members FROM i GROUP BY file, isl""")
def w11_range_islands(spark, sf_dir):
    """Byte ranges of a file joined while the gap is small."""
    i = F.col("page_id")
    ranges = table(spark, sf_dir, "pages").select((i % 8).alias("file"), (i * 1000).alias("start"), (i * 1000 + 300 + i * 37 % 2500).alias("stop"))
    return W.islands(ranges, "file", 5500)


@query()
def w11_bounded_ranges(spark, sf_dir):
    """The same with a bound on the joined span, which needs a fold in order."""
    i = F.col("page_id")
    ranges = table(spark, sf_dir, "pages").select((i % 8).alias("file"), (i * 1000).alias("start"), (i * 1000 + 300 + i * 37 % 2500).alias("stop"))
    return W.bounded_ranges(ranges, "file", 5500, 30000)


@query(r"""WITH c AS (SELECT conv_id, turn, role, trim(regexp_replace(text, '[\s\x0b]+', ' ', 'g')) AS t, lag(role) OVER (PARTITION BY conv_id ORDER BY turn) AS before FROM conversations) SELECT conv_id, turn, before = 'user' AS follows_user FROM c WHERE role = 'assistant'""")
def w10_follows_user(spark, sf_dir):
    before = F.lag("role").over(Window.partitionBy("conv_id").orderBy("turn"))
    return table(spark, sf_dir, "conversations").withColumn("before", before).where("role = 'assistant'").select("conv_id", "turn", (F.col("before") == "user").alias("follows_user"))


_PAIRS = r"""WITH c AS (SELECT conv_id, turn, role, COLLAPSED AS t FROM conversations WHERE role IN ('user', 'assistant') AND COLLAPSED <> ''),
h AS (SELECT *, lag(role) OVER w AS p, list(upper(left(role, 1)) || substr(role, 2) || ': ' || t) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN 5 PRECEDING AND 2 PRECEDING) AS hist, lag(t) OVER w AS u FROM c WINDOW w AS (PARTITION BY conv_id ORDER BY turn)),
pairs AS (SELECT conv_id, turn, left(CASE WHEN hist IS NULL OR len(hist) = 0 THEN u ELSE 'Conversation so far:' || chr(10) || array_to_string(hist, chr(10)) || chr(10) || 'User: ' || u END, 8000) AS prompt, t AS answer FROM h WHERE role = 'assistant' AND p = 'user')""".replace("COLLAPSED", T.collapsed_sql("text"))


@query(_PAIRS + " SELECT conv_id, turn, sha256(prompt) AS prompt, sha256(answer) AS answer FROM pairs")
def c1_c2_w9_pairs(spark, sf_dir):
    """Prompt with up to four turns of history, and answer, of each assistant turn that follows a user turn."""
    pairs = C.pairs(table(spark, sf_dir, "conversations"), history=4)
    return pairs.select("conv_id", "turn", H.sha256(F.col("prompt")).alias("prompt"), H.sha256(F.col("answer")).alias("answer"))


@query(_PAIRS + " SELECT DISTINCT sha1(lower(prompt) || chr(31) || lower(answer)) AS key FROM pairs")
def a34_pair_dedup(spark, sf_dir):
    key = F.sha1(F.concat(F.lower("prompt"), F.lit("\x1f"), F.lower("answer")).cast("binary"))
    return C.pairs(table(spark, sf_dir, "conversations"), history=4).select(key.alias("key")).distinct()


@query(_PAIRS + r", s AS (SELECT *, regexp_replace(answer, '[\s\x0b]+', '', 'g') AS solid, length(answer) - length(regexp_replace(answer, '\p{L}', '', 'g')) AS letters FROM pairs) SELECT conv_id, turn, letters / length(solid) < 0.5 OR (length(answer) - length(regexp_replace(answer, '[A-Za-z]', '', 'g'))) / letters < 0.65 OR len(regexp_extract_all(answer, 'http://|https://|www\.')) > 2 AS low FROM s WHERE letters > 0")
def f13_f14_low_quality_answers(spark, sf_dir):
    a = F.col("answer")
    return C.pairs(table(spark, sf_dir, "conversations"), history=4).where(T.alpha_chars(a) > 0).select("conv_id", "turn", ((T.alpha_ratio(a) < 0.5) | (T.latin_ratio(a) < 0.65) | (T.url_count(a) > 2)).alias("low"))


@query(r"""WITH a AS (SELECT conv_id, max(turn) AS turn FROM conversations WHERE role = 'assistant' GROUP BY conv_id) SELECT c.conv_id, sha256(string_agg(c.text, chr(10) ORDER BY c.turn) FILTER (c.turn < a.turn)) AS prompt, sha256(max(c.text) FILTER (c.turn = a.turn)) AS response FROM conversations c JOIN a ON c.conv_id = a.conv_id GROUP BY c.conv_id HAVING count(*) FILTER (c.turn < a.turn) > 0""")
def c3_last_response(spark, sf_dir):
    out = C.last_response(table(spark, sf_dir, "conversations")).where("size(prompt) > 0")
    return out.select("conv_id", H.sha256(F.array_join("prompt", "\n")).alias("prompt"), H.sha256(F.col("response")).alias("response"))


_CAND = r"WITH r AS (SELECT o_custkey AS prompt, o_orderkey AS id, 'answer ' || o_orderkey AS answer, CAST(floor(o_totalprice) AS BIGINT) % 5 AS rating FROM orders)"


def candidates(spark, sf_dir):
    """Orders as rated answers, customers as prompts."""
    return table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("prompt"), F.col("o_orderkey").alias("id"), F.concat(F.lit("answer "), F.col("o_orderkey").cast("string")).alias("answer"), (F.floor("o_totalprice") % 5).alias("rating"))


@query(_CAND + " SELECT prompt, arg_max(answer, struct_pack(a := rating, b := -id)) AS chosen, arg_min(answer, struct_pack(a := rating, b := id)) AS rejected, CAST(greatest(max(rating) - min(rating), 1) AS BIGINT) AS weight FROM r GROUP BY prompt HAVING max(rating) > min(rating)")
def l22_a47_best_and_worst(spark, sf_dir):
    return C.best_and_worst(candidates(spark, sf_dir), "prompt", "answer", "rating", "id")


@query(_CAND + ", o AS (SELECT prompt, list(answer ORDER BY id) FILTER (rating >= 3) AS good, list(answer ORDER BY id) FILTER (rating < 3) AS bad FROM r GROUP BY prompt) SELECT prompt, good[1] AS chosen, bad[1] AS rejected FROM o WHERE len(good) > 0 AND len(bad) > 0")
def l23_first_right_and_wrong(spark, sf_dir):
    return C.first_right_and_wrong(candidates(spark, sf_dir), "prompt", "answer", F.col("rating") >= 3, "id")


@query(_CAND + ", p AS (SELECT prompt, id, answer AS chosen, CASE WHEN id % 9 = 0 THEN answer WHEN id % 7 = 0 THEN '  ' ELSE 'other' END AS rejected FROM r) SELECT id, trim(chosen) <> '' AND trim(rejected) <> '' AND chosen <> rejected AS valid FROM p")
def c4_c5_valid_preferences(spark, sf_dir):
    rows = candidates(spark, sf_dir).withColumn("rejected", F.when(F.col("id") % 9 == 0, F.col("answer")).when(F.col("id") % 7 == 0, "  ").otherwise("other"))
    return rows.select("id", C.valid_preference(F.lit("p"), F.col("answer"), F.col("rejected")).alias("valid"))


def _answers():
    """Turns with think blocks, thought and solution marks, a solution alone, or nothing added."""
    t, m = F.col("text"), F.col("turn") % 4
    think = F.concat(F.lit("<Think>"), F.substring("text", 1, 30), F.lit("</think>"), F.substr("text", F.lit(31)))
    both = F.concat(F.lit("<|begin_of_thought|>"), F.substring("text", 1, 30), F.lit("<|end_of_thought|> so <|begin_of_solution|>"), F.substr("text", F.lit(31)), F.lit("<|end_of_solution|>"))
    return F.when(m == 0, think).when(m == 1, both).when(m == 2, F.concat(F.lit("x <|begin_of_solution|>"), t, F.lit("<|end_of_solution|>"))).otherwise(t)


_ASK = r"""WITH t AS (SELECT conv_id, turn, CASE turn % 4 WHEN 0 THEN '<Think>' || left(text, 30) || '</think>' || substr(text, 31) WHEN 1 THEN '<|begin_of_thought|>' || left(text, 30) || '<|end_of_thought|> so <|begin_of_solution|>' || substr(text, 31) || '<|end_of_solution|>' WHEN 2 THEN 'x <|begin_of_solution|>' || text || '<|end_of_solution|>' ELSE text END AS t FROM conversations),
r AS (SELECT conv_id, turn, CASE WHEN regexp_matches(t, 'THOUGHT') OR regexp_matches(t, 'SOLUTION') THEN regexp_extract(t, 'THOUGHT', 1) ELSE regexp_extract(t, 'THINK', 1) END AS thought, CASE WHEN regexp_matches(t, 'SOLUTION') THEN regexp_extract(t, 'SOLUTION', 1) WHEN regexp_matches(t, 'THOUGHT') THEN t ELSE regexp_replace(t, 'THINK', '', 'g') END AS answer FROM t)""".replace("THOUGHT", C.THOUGHT).replace("SOLUTION", C.SOLUTION).replace("THINK", C.THINK)


@query(_ASK + f" SELECT conv_id, turn, sha256({T.collapsed_sql('thought')}) AS thought, sha256({T.collapsed_sql('answer')}) AS answer FROM r")
def t43_reasoning(spark, sf_dir):
    thought, answer = C.reasoning(_answers())
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", H.sha256(thought).alias("thought"), H.sha256(answer).alias("answer"))


_CUT = lambda x, n: T.collapsed_sql(f"left({x}, {n})")


@query(_ASK + f", c AS (SELECT conv_id, turn, {_CUT('k.thought', 20)} AS thought, {_CUT('k.answer', 100)} AS answer FROM (SELECT conv_id, turn, {T.collapsed_sql('thought')} AS thought, {T.collapsed_sql('answer')} AS answer FROM r) k), d AS (SELECT conv_id, turn, CASE WHEN thought <> '' THEN '<think>' || chr(10) || thought || chr(10) || '</think>' || chr(10) || chr(10) || answer ELSE answer END AS reply FROM c) SELECT conv_id, turn, regexp_replace(reply, '^[ENDS]+|[ENDS]+$', '', 'g') AS reply FROM d".replace("ENDS", T.BLANKS + T.LINE_ENDS))
def t43_shortened(spark, sf_dir):
    """Thoughts cut at 20 characters and answers at 100."""
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", C.shortened(_answers(), True, 20, 100, 4000).alias("reply"))


@query(r"""WITH m AS (SELECT conv_id, string_agg('<|im_start|>' || role || chr(10) || text || '<|im_end|>', chr(10) ORDER BY turn) AS t FROM conversations GROUP BY conv_id), x AS (SELECT conv_id, regexp_extract_all(t, '(?s)<\|im_start\|>(\w+)\n(.*?)<\|im_end\|>', 1) AS roles, regexp_extract_all(t, '(?s)<\|im_start\|>(\w+)\n(.*?)<\|im_end\|>', 2) AS texts FROM m) SELECT conv_id, array_to_string(roles, ',') AS roles, sha256(array_to_string(texts, chr(31))) AS texts FROM x""")
def t45_chatml(spark, sf_dir):
    turns = F.transform(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))), lambda m: F.concat(F.lit("<|im_start|>"), m["role"], F.lit("\n"), m["text"], F.lit("<|im_end|>")))
    whole = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.array_join(turns, "\n").alias("t"))
    return whole.select("conv_id", F.array_join(C.chatml(F.col("t"), 1), ",").alias("roles"), H.sha256(F.array_join(C.chatml(F.col("t"), 2), "\x1f")).alias("texts"))


_OF = lambda words, test: "(" + " OR ".join(test.format(w.replace("'", "''")) for w in words) + ")"
_OPENERS = ["Sure, ", "The answer is clearly this. ", "- a\n- b\n", ""]


def _replies(pairs):
    """Answers with openers, fake confidence, bullets and think blocks added, and every fifth repeated to be verbose."""
    m, a = F.col("turn") % 4, F.col("answer")
    opened = F.concat(F.coalesce(*[F.when(m == i, F.lit(x)) for i, x in enumerate(_OPENERS)]), F.when(F.col("conv_id") % 3 == 0, "<think>let's think step by step because so </think>").otherwise(""), a)
    return pairs.select("conv_id", "turn", "prompt", F.when(F.col("conv_id") % 5 == 0, F.repeat(opened, F.lit(3))).otherwise(opened).alias("reply"))


_REPLIES = _PAIRS + ", o AS (SELECT conv_id, turn, prompt, CASE turn % 4 " + " ".join("WHEN {} THEN {}".format(i, " || chr(10) || ".join("'" + p + "'" for p in x.split("\n"))) for i, x in enumerate(_OPENERS)) + " END || CASE WHEN conv_id % 3 = 0 THEN '<think>let''s think step by step because so </think>' ELSE '' END || answer AS o FROM pairs), n AS (SELECT conv_id, turn, prompt, CASE WHEN conv_id % 5 = 0 THEN o || o || o ELSE o END AS reply FROM o), q AS (SELECT *, lower(reply) AS low FROM n)"
_COUNTED = lambda words, t: " + ".join("(length({0}) - length(replace({0}, {1}, ''))) // {2}".format(t, " || chr(10) || ".join("'" + p.replace("'", "''") + "'" for p in w.split("\n")), len(w)) for w in words)
_LONG = lambda kind: "length(reply) >= greatest(CAST(floor(length(prompt) * {}) AS BIGINT), length(prompt) + {}, {})".format(*C.VERBOSE[kind])


def _verdict(checks, least, needs):
    reasons = "list_filter([" + ", ".join(f"CASE WHEN {c} THEN '{n}' END" for n, c, _ in checks) + "], lambda x: x IS NOT NULL)"
    score = " + ".join(f"CASE WHEN {c} THEN {k} ELSE 0 END" for _, c, k in checks)
    return f", v AS (SELECT conv_id, turn, {reasons} AS r, {score} AS s FROM q) SELECT conv_id, turn, CASE WHEN s >= {least} AND {needs} THEN r ELSE CAST([] AS VARCHAR[]) END AS reasons, CAST(CASE WHEN s >= {least} AND {needs} THEN s ELSE 0 END AS INTEGER) AS score FROM v"


_CHAT = [("oververbose", _LONG("chat"), 2), ("polished_opener", _OF(C.POLISHED_OPENERS, "starts_with(low, '{}')"), 1), ("fake_confidence", _OF(C.FAKE_CONFIDENCE, "contains(low, '{}')"), 1), ("overstructured", f"({_COUNTED([chr(10)], 'reply')} >= 4 OR {_COUNTED([chr(10) + '- ', chr(10) + '* '], 'reply')} + len(regexp_extract_all(reply, '\\n\\d+\\.\\s')) >= 2)", 1)]
_LAST = f"coalesce(list_filter(string_split(regexp_replace(low, '{T.EDGES}', chr(10), 'g'), chr(10)), lambda x: x <> '')[-1], '')"
_FINAL = f"({_OF(C.FINAL_ANSWER, 'contains(low, {!r})'.replace('{!r}', chr(39) + '{}' + chr(39)))} OR (length({_LAST}) <= 120 AND (starts_with({_LAST}, 'answer') OR starts_with({_LAST}, 'final'))))"
_THINKING = [("think_tags", f"regexp_matches(reply, '{C.THINK}')", 2), ("reasoning_trace", f"{_COUNTED(C.REASONING_MARKERS, 'low')} >= 3", 1), ("verbose", _LONG("think"), 1), ("no_clear_final", f"NOT {_FINAL}", 2), ("fake_confidence", _OF(C.FAKE_CONFIDENCE, "contains(low, '{}')"), 1)]


@query(_REPLIES + _verdict(_CHAT, 2, "list_has_any(r, ['oververbose', 'fake_confidence', 'overstructured'])"))
def t46_negatives(spark, sf_dir):
    pairs = C.pairs(table(spark, sf_dir, "conversations"), history=4)
    return _replies(pairs).select("conv_id", "turn", C.chat_negative(F.col("reply"), F.col("prompt")).alias("x")).select("conv_id", "turn", "x.reasons", "x.score")


@query(_REPLIES + _verdict(_THINKING, 3, "list_contains(r, 'no_clear_final') AND list_has_any(r, ['reasoning_trace', 'think_tags'])"))
def t46_think_negatives(spark, sf_dir):
    pairs = C.pairs(table(spark, sf_dir, "conversations"), history=4)
    return _replies(pairs).select("conv_id", "turn", C.think_negative(F.col("reply"), F.col("prompt")).alias("x")).select("conv_id", "turn", "x.reasons", "x.score")


@query()
def t47_sequence_ratio(spark, sf_dir):
    """The ratio of matching blocks in the whole case-folded texts of every pair; SQL has none, so it is tested against Python."""
    whole = C.pairs(table(spark, sf_dir, "conversations"), history=4, most_chars=2**31 - 1)
    return whole.select("conv_id", "turn", F.round(T.sequence_ratio(F.col("prompt"), F.col("answer")), 9).alias("ratio"))


# Readers of preference sets. Their nested rows are made from orders: a customer is a prompt, an order an answer.
_ROWS = r"""WITH o AS (SELECT o_custkey AS id, 'Question ' || o_custkey || CASE WHEN o_custkey % 50 = 0 THEN ' import x' ELSE '' END AS prompt, o_orderkey, 'answer ' || o_orderkey || CASE WHEN o_orderkey % 40 = 0 THEN ' def f' ELSE '' END AS answer, CAST(floor(o_totalprice) AS BIGINT) % 5 AS rating, o_orderkey % 4 = 0 AS ok FROM orders),
g AS (SELECT id, any_value(prompt) AS prompt, list(answer ORDER BY o_orderkey) AS answers, list(rating ORDER BY o_orderkey) AS ratings, list(ok ORDER BY o_orderkey) AS oks FROM o GROUP BY id)"""
_CODED = lambda *x: "NOT (" + " OR ".join(f"contains({t}, '{n}')" for t in x for n in ("def ", "import ")) + ")"


def preference_rows(spark, sf_dir):
    """(id, prompt, answers: array of structs with answer, rating, rank, ok and annotations)."""
    o = table(spark, sf_dir, "orders")
    answer = F.concat(F.lit("answer "), F.col("o_orderkey").cast("string"), F.when(F.col("o_orderkey") % 40 == 0, " def f").otherwise(""))
    score = (F.floor("o_totalprice") % 5).cast("bigint")
    item = F.struct("o_orderkey", answer.alias("answer"), score.alias("rating"), (5 - score).cast("int").alias("rank"), (F.col("o_orderkey") % 4 == 0).alias("ok"), F.struct(score.cast("string").alias("helpfulness"), F.lit("N/A").alias("honesty")).alias("annotations"))
    prompt = F.concat(F.lit("Question "), F.col("o_custkey").cast("string"), F.when(F.col("o_custkey") % 50 == 0, " import x").otherwise(""))
    return o.groupBy(F.col("o_custkey").alias("id")).agg(F.min(prompt).alias("prompt"), F.array_sort(F.collect_list(item)).alias("answers"))


@query(_ROWS + f" SELECT id, prompt, CASE WHEN r > 0 THEN b ELSE a END AS chosen, CASE WHEN r > 0 THEN a ELSE b END AS rejected, CAST(abs(r) AS DOUBLE) AS pair_weight FROM (SELECT id, prompt, answers[1] AS a, answers[2] AS b, ratings[2] - ratings[1] AS r FROM g WHERE len(answers) >= 2) WHERE r <> 0 AND {_CODED('prompt', 'a', 'b')}")
def c5_preferred_of_two(spark, sf_dir):
    """Two answers and a signed preference, ties and code left out."""
    two = preference_rows(spark, sf_dir).where("size(answers) >= 2").select("id", "prompt", F.get("answers", F.lit(0)).alias("a"), F.get("answers", F.lit(1)).alias("b"))
    return C.preferred_of_two(two, F.col("prompt"), F.col("a.answer"), F.col("b.answer"), F.col("b.rating") - F.col("a.rating"), ["id"], drop_code=True)


@query(_ROWS + " SELECT id, prompt, list_filter(answers, lambda x, i: ratings[i] = list_max(ratings))[1] AS chosen, list_filter(answers, lambda x, i: ratings[i] = list_min(ratings))[-1] AS rejected, CAST(greatest(list_max(ratings) - list_min(ratings), 1) AS DOUBLE) AS pair_weight FROM g WHERE len(answers) >= 2 AND list_max(ratings) > list_min(ratings)")
def c5_annotated_completions(spark, sf_dir):
    """The best and the worst of several answers by the sum of their annotations; of equal ones the first is best and the last is worst."""
    score = lambda x: C.annotated_score(x, ["helpfulness", "honesty"], "answer")
    return C.best_and_worst_of(preference_rows(spark, sf_dir), F.col("prompt"), "answers", "answer", score, ["id"])


@query(_ROWS + " SELECT id, prompt, list_filter(answers, lambda x, i: ratings[i] = list_max(ratings))[1] AS chosen, list_filter(answers, lambda x, i: ratings[i] = list_min(ratings))[-1] AS rejected, CAST(list_max(ratings) - list_min(ratings) AS DOUBLE) AS pair_weight FROM g WHERE len(answers) >= 2 AND list_max(ratings) > list_min(ratings)")
def c5_ranked_answers(spark, sf_dir):
    """The best rank against the last, prompts marked Human and Assistant."""
    rows = preference_rows(spark, sf_dir).withColumn("turns", F.concat(F.lit("\n\nHuman: "), F.col("prompt"), F.lit("\n\nAssistant:")))
    pairs = C.ranked_answers(rows, C.message_prompt(F.col("turns")), "answers", "answer", "rank", F.col("id"), ["id"])
    return pairs.withColumn("prompt", F.regexp_replace("prompt", "^User: ", ""))


@query()
def c5_ranked_answers_sampled(spark, sf_dir):
    """Also against one of the worse half, chosen by a hash, which SQL has not."""
    return C.ranked_answers(preference_rows(spark, sf_dir), F.col("prompt"), "answers", "answer", "rank", F.col("id"), ["id"], sampled=True)


@query(_ROWS + " SELECT id, prompt, list_filter(answers, lambda x, i: oks[i])[1] AS chosen, list_filter(answers, lambda x, i: NOT oks[i])[1] AS rejected, CAST(2 AS DOUBLE) AS pair_weight FROM g WHERE len(answers) >= 2 AND list_contains(oks, true) AND list_contains(oks, false)")
def c5_verified_generations(spark, sf_dir):
    rows = preference_rows(spark, sf_dir).select("id", "prompt", F.transform("answers", lambda x: x["answer"]).alias("generations"), F.transform("answers", lambda x: x["ok"]).alias("correct"))
    return C.verified_generations(rows, F.col("prompt"), "generations", "correct", ["id"])


@query(_ROWS + " SELECT id, CASE WHEN id % 2 = 0 THEN prompt ELSE 'instead' END AS prompt, answers[1] AS chosen, answers[2] AS rejected, CAST(1 AS DOUBLE) AS pair_weight FROM g WHERE len(answers) >= 2")
def c5_named_pairs(spark, sf_dir):
    """By the first column name that is there and filled."""
    two = preference_rows(spark, sf_dir).where("size(answers) >= 2").select("id", F.when(F.col("id") % 2 == 0, F.col("prompt")).otherwise("").alias("prompt"), F.lit("instead").alias("question"), F.get("answers", F.lit(0))["answer"].alias("chosen_response"), F.get("answers", F.lit(1))["answer"].alias("rejected"))
    return C.named_pairs(two, ["prompt", "instruction", "question", "input"], ["chosen", "chosen_response"], ["rejected", "rejected_response"], ["id"])
