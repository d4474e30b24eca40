"""Extraction from nested rows, identities, receipts, tokens, shards."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import hashing as H
from ..functions import text as T
from ..operators import graph as G
from ..operators import select as S
from ..operators import tokenizing as K
from ..sources import readers
from .registry import query, table


@query(r"""SELECT o_orderkey, CAST(l_linenumber AS INTEGER) AS component, sha256('obj' || chr(0) || o_orderkey || chr(0) || l_linenumber) AS row_id, 'part ' || l_partkey AS body FROM orders JOIN lineitem ON o_orderkey = l_orderkey""")
def p2_files_to_documents(spark, sf_dir):
    """An object with an array of files becomes one document a file, in order."""
    lines = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey"))).alias("files"))
    files = table(spark, sf_dir, "orders").join(lines, F.col("o_orderkey") == F.col("l_orderkey")).select("o_orderkey", F.explode("files").alias("f"))
    return files.select("o_orderkey", F.col("f.l_linenumber").alias("component"), H.keyed(F.lit("obj"), F.col("o_orderkey"), F.col("f.l_linenumber")).alias("row_id"), F.concat(F.lit("part "), F.col("f.l_partkey").cast("string")).alias("body"))


@query(r"""WITH p AS (SELECT conv_id, string_agg(text, chr(10) ORDER BY turn) AS t FROM conversations GROUP BY conv_id) SELECT conv_id, sha256(t) AS digest FROM p""")
def p2_joined_pages(spark, sf_dir):
    pages = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("turn", "text"))), lambda x: x["text"]).alias("pages"))
    return readers.extracted(pages.withColumn("text", F.lit(" "))).select("conv_id", H.sha256(F.col("training_text")).alias("digest"))


@query(r"""SELECT doc_id, coalesce(CASE WHEN doc_id % 4 = 0 THEN 'row' END, CASE WHEN doc_id % 4 = 1 THEN 'meta' END, source) AS license, CASE WHEN doc_id % 4 = 0 THEN 'row' WHEN doc_id % 4 = 1 THEN 'metadata' ELSE 'source_default' END AS method FROM documents""")
def p3_metadata_precedence(spark, sf_dir):
    """Row, then metadata, then the source's default; and which of them it was."""
    m = F.col("doc_id") % 4
    meta = F.when(m == 1, '{"license": "meta"}').otherwise("{}")
    fields = [("row", F.when(m == 0, "row")), ("metadata", F.get_json_object(meta, "$.license")), ("source_default", F.col("source"))]
    return table(spark, sf_dir, "documents").select("doc_id", F.coalesce(*[v for _, v in fields]).alias("license"), F.coalesce(*[F.when(v.isNotNull(), F.lit(k)) for k, v in fields]).alias("method"))


@query(r"""SELECT item_id, sha256('["task","job",' || item_id || ']') AS row_identity FROM benchmark""")
def p12_holdout_identity(spark, sf_dir):
    """SHA-256 of canonical JSON."""
    whole = F.concat(F.lit('["task","job",'), F.col("item_id").cast("string"), F.lit("]"))
    return table(spark, sf_dir, "benchmark").select("item_id", H.sha256(whole).alias("row_identity"))


@query(r"""SELECT doc_id, regexp_matches(t, '^version https://git-lfs\.github\.com/spec/v1') OR regexp_matches(t, '^swh:1:(cnt|dir|rev|rel|snp):[0-9a-f]{40}$') AS pointer FROM (SELECT doc_id, CASE doc_id % 5 WHEN 0 THEN 'version https://git-lfs.github.com/spec/v1' WHEN 1 THEN 'swh:1:cnt:' || sha1(text) ELSE text END AS t FROM documents)""")
def p7_pointers(spark, sf_dir):
    m = F.col("doc_id") % 5
    t = F.when(m == 0, "version https://git-lfs.github.com/spec/v1").when(m == 1, F.concat(F.lit("swh:1:cnt:"), F.sha1(F.col("text").cast("binary")))).otherwise(F.col("text"))
    return table(spark, sf_dir, "documents").select("doc_id", readers.is_pointer(t).alias("pointer"))


@query(r"""SELECT doc_id, coalesce(CASE WHEN doc_id % 3 = 0 THEN 'id-' || doc_id END, sha256(text)) AS id, source AS quota_source_id, false AS replacement, 1 AS exposure FROM documents""")
def p14_p15_schedule_rows(spark, sf_dir):
    given = F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("id-"), F.col("doc_id").cast("string")))
    return table(spark, sf_dir, "documents").select("doc_id", F.coalesce(given, H.sha256(F.col("text"))).alias("id"), F.col("source").alias("quota_source_id"), F.lit(False).alias("replacement"), F.lit(1).alias("exposure"))


@query(r"""WITH d AS (SELECT doc_id, lang, length(text) AS n, coalesce(sum(length(text)) OVER (PARTITION BY lang ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM documents) SELECT lang, CAST(before // 100000 AS BIGINT) AS chunk, min(doc_id) AS first, max(doc_id) AS last, count(*) AS rows, CAST(sum(n) AS BIGINT) AS chars FROM d GROUP BY ALL""")
def k3_chunk_receipts(spark, sf_dir):
    """Chunks by a cap on characters, with the range of rows of each."""
    sized = table(spark, sf_dir, "documents").select("doc_id", "lang", F.length("text").cast("bigint").alias("n"))
    rows = S.running(sized, ["lang"], ["doc_id"], "n", span=F.floor(F.col("doc_id") / 4096))
    return rows.groupBy("lang", F.floor(F.col("start") / 100000).alias("chunk")).agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last"), F.count("*").alias("rows"), F.sum("n").alias("chars"))


def _vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


@query()
def c6_c8_token_counts(spark, sf_dir):
    """Ids by a public byte-level BPE and one end token each, with their digest."""
    return K.token_counts(table(spark, sf_dir, "documents"), _vocabulary(), 50256)


@query()
def c7_token_cache(spark, sf_dir):
    """Contents that the cache has are not encoded again."""
    docs = table(spark, sf_dir, "documents")
    cache = G.cut(K.cached_counts(docs.where("doc_id % 2 = 0"), None, _vocabulary(), 50256)[1])
    return K.cached_counts(docs, cache, _vocabulary(), 50256)[0]


@query(r"""WITH c AS (SELECT doc_id, len(regexp_extract_all(text, '[\p{L}\p{N}_]+')) + 1 AS n FROM documents), s AS (SELECT doc_id, n, CAST(sum(n) OVER (ORDER BY doc_id) AS BIGINT) AS b FROM c), x AS (SELECT *, b - n AS a, unnest(range((b - n) // 10000, (b - 1) // 10000 + 1)) AS shard FROM s)
SELECT CAST(shard AS BIGINT) AS shard, CAST(greatest(a, shard * 10000) - shard * 10000 AS BIGINT) AS "offset", doc_id, CAST(greatest(a, shard * 10000) - a AS BIGINT) AS start, CAST(least(b, (shard + 1) * 10000) - greatest(a, shard * 10000) AS BIGINT) AS length FROM x""")
def k7_token_shards(spark, sf_dir):
    """The span index of fixed-size token shards over all documents."""
    counts = table(spark, sf_dir, "documents").select("doc_id", (T.number_of(F.col("text"), T.WORD) + 1).alias("token_count"))
    return K.token_shards(counts, 10000)


@query(r"""SELECT lang, round(avg(CASE WHEN length(text) >= 400 THEN 1.0 ELSE 0 END), 6) AS accept_rate, count(*) AS sampled FROM documents WHERE sha256(CAST(doc_id AS VARCHAR)) < '4' GROUP BY lang""")
def f23_preflight_rate(spark, sf_dir):
    """Accept rates over a hash sample, the feature being the sample."""
    rows = table(spark, sf_dir, "documents").where(H.sha256(F.col("doc_id").cast("string")) < "4")
    return rows.groupBy("lang").agg(F.round(F.avg((F.length("text") >= 400).cast("double")), 6).alias("accept_rate"), F.count("*").alias("sampled"))


@query(r"""SELECT doc_id, CASE WHEN lang <> 'fr' THEN NULL WHEN NOT regexp_matches(text, '(?m)^\S.*\.$') THEN 'no_sentence' WHEN length(text) < 800 THEN 'incomplete' END AS quarantine, CASE WHEN n_chars IS NULL THEN 'missing_license' END AS license_gate FROM documents""")
def f19_f21_quarantine(spark, sf_dir):
    whole = F.when(F.col("lang") != "fr", None).when(~F.col("text").rlike(r"(?m)^\S.*\.$"), "no_sentence").when(F.length("text") < 800, "incomplete")
    return table(spark, sf_dir, "documents").select("doc_id", whole.alias("quarantine"), F.when(F.col("n_chars").isNull(), "missing_license").alias("license_gate"))


# extraction, with what is refused


@query(r"""WITH f AS (SELECT o_orderkey, list(struct_pack(n := l_linenumber, t := CASE l_partkey % 5 WHEN 0 THEN 'version https://git-lfs.github.com/spec/v1' WHEN 1 THEN '' WHEN 2 THEN NULL ELSE 'part ' || l_partkey END, l := CASE WHEN l_suppkey % 2 = 0 THEN 'mit' END) ORDER BY l_linenumber, l_partkey, l_suppkey) AS files FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY o_orderkey),
e AS (SELECT o_orderkey, unnest(files) AS f, generate_subscripts(files, 1) - 1 AS position, len(files) AS file_count FROM f)
SELECT o_orderkey, 'files/' || position AS component, f.t AS body, coalesce(f.l, 'repository') AS license, file_count, CASE WHEN f.t IS NULL OR starts_with(f.t, 'version https') THEN 'pointer_only_code' END AS rejection FROM e
UNION ALL SELECT o_orderkey, 'row', NULL, 'repository', 0, 'empty_file_list' FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem)""")
def p2_file_components(spark, sf_dir):
    """Files of an object as documents with the repository's licence where they have none of their own; pointers and empty lists are refused."""
    m = F.col("l_partkey") % 5
    text = F.when(m == 0, "version https://git-lfs.github.com/spec/v1").when(m == 1, "").when(m == 2, None).otherwise(F.concat(F.lit("part "), F.col("l_partkey").cast("string")))
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", F.struct("l_linenumber", "l_partkey", "l_suppkey", text.alias("text"), F.when(F.col("l_suppkey") % 2 == 0, "mit").alias("license")).alias("f"))
    files = lines.groupBy("l_orderkey").agg(F.array_sort(F.collect_list("f")).alias("files"))
    rows = table(spark, sf_dir, "orders").select("o_orderkey").join(files, F.col("o_orderkey") == F.col("l_orderkey"), "left").select("o_orderkey", F.coalesce("files", F.array().cast(files.schema["files"].dataType)).alias("files"), F.lit("repository").alias("license"))
    return readers.file_components(rows, "o_orderkey").select("o_orderkey", "component", "body", "license", "file_count", "rejection")


@query("""SELECT page_id, CASE page_id % 4 WHEN 0 THEN 'en' WHEN 1 THEN 'de' END AS language, CASE page_id % 4 WHEN 0 THEN 'lang' WHEN 1 THEN 'doc_language' END AS language_field, CASE WHEN page_id % 3 = 0 THEN url ELSE 'http://other/' END AS canonical_url, CASE WHEN page_id % 3 = 0 THEN 'url' ELSE 'source_url' END AS url_field, CASE page_id % 5 WHEN 0 THEN 'MIT' WHEN 1 THEN 'Apache-2.0,MIT' END AS license, CASE page_id % 7 WHEN 0 THEN 'set-a' ELSE 'set-b' END AS source_dataset FROM pages""")
def p3_aliases_and_lineage(spark, sf_dir):
    """Language, address, licence and lineage from whichever of their aliases a row's JSON has, and which it was."""
    i = F.col("page_id")
    part = lambda *x: F.concat(*[F.lit(v) if isinstance(v, str) else v for v in x])
    meta = part('{"lang": "', F.when(i % 4 == 0, "en").otherwise(""), '", "doc_language": "', F.when(i % 4 == 1, "de").otherwise(""), '", "url": "', F.when(i % 3 == 0, F.col("url")).otherwise(""), '", "source_url": "http://other/", "license": ', F.when(i % 5 == 0, '"MIT"').when(i % 5 == 1, '["Apache-2.0", "MIT", "none"]').otherwise('"NOASSERTION"'), ', "seed_dataset": "', F.when(i % 7 == 0, "set-a").otherwise("set-b"), '"}')
    return readers.projected_metadata(table(spark, sf_dir, "pages").select("page_id", "url", meta.alias("metadata")), "metadata").select("page_id", "language", "language_field", "canonical_url", "url_field", "license", "source_dataset")


# spans and dense ids


@query()
def t12_sentence_spans(spark, sf_dir):
    """Sentences as [start, end) in the text, tested against a splitter by hand."""
    rows = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(T.sentence_spans(F.col("text"))).alias("pos", "s"))
    return rows.select("doc_id", "pos", "s.start", "s.end")


@query()
def t50_dense_ids(spark, sf_dir):
    """Accent-free tokens numbered by their first appearance; appearances are counted in spans of documents, so no task numbers all."""
    first = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(T.found(T.plain_token("text"), T.WORD)).alias("pos", "token")).groupBy("token").agg(F.min(F.struct("doc_id", "pos")).alias("f"))
    rows = first.select("token", F.col("f.doc_id").alias("doc_id"), F.col("f.pos").alias("pos"), F.lit(1).alias("n"), F.lit(0).alias("all"))
    return S.running(rows, ["all"], ["doc_id", "pos"], "n", span=F.floor(F.col("doc_id") / 64)).select("token", F.col("start").alias("id"))


# tokens in files


_IDS = r"WITH w AS (SELECT doc_id, list_transform(regexp_extract_all(text, '[\p{L}\p{N}_]+'), lambda x: length(x)) || [0] AS ids FROM documents)"


def _ids(spark, sf_dir):
    """Documents as ids below 65,536: the lengths of their words, and 0 at the end."""
    words = F.transform(T.found(F.col("text"), T.WORD), lambda w: F.length(w))
    return table(spark, sf_dir, "documents").select("doc_id", F.concat(words, F.array(F.lit(0))).alias("ids"))


@query(_IDS + " SELECT doc_id, CAST(len(ids) AS BIGINT) AS n, md5(array_to_string(ids, ',')) AS digest FROM w")
def k7_s22_binary_shards(spark, sf_dir):
    """Ids in binary shards of 16-bit numbers, with the index of their spans; every document read back from its spans."""
    from .streams import _scratch

    path = _scratch(spark)
    index = K.write_binary_shards(_ids(spark, sf_dir), 10000, path)
    back = K.read_binary_shards(spark, path, index)
    return back.select("doc_id", F.size("ids").cast("bigint").alias("n"), F.md5(F.array_join("ids", ",").cast("binary")).alias("digest"))


@query(_IDS + " SELECT doc_id, CAST(len(ids) AS BIGINT) AS token_count, CAST(sum(len(ids)) OVER (ORDER BY doc_id) - len(ids) AS BIGINT) AS prefix FROM w")
def a56_lengths_and_prefixes(spark, sf_dir):
    """Lengths with the end id, and the ids of all documents before."""
    rows = _ids(spark, sf_dir).select("doc_id", F.size("ids").cast("bigint").alias("token_count"), F.lit(0).alias("all"))
    return S.running(rows, ["all"], ["doc_id"], "token_count", span=F.floor(F.col("doc_id") / 4096)).select("doc_id", "token_count", F.col("start").alias("prefix"))


@query(r"""WITH d AS (SELECT doc_id, lang, CAST(len(regexp_extract_all(text, '[\p{L}\p{N}_]+')) + 1 AS BIGINT) AS tokens FROM documents), s AS (SELECT *, CAST(sum(tokens) OVER (PARTITION BY lang ORDER BY doc_id) AS BIGINT) AS e FROM d), t(lang, target) AS (VALUES ('de', 3000), ('en', 7000), ('es', 1), ('fr', 900000)), c AS (SELECT doc_id, s.lang, e - tokens AS a, least(e, target) AS b FROM s JOIN t ON s.lang = t.lang WHERE e - tokens < target)
SELECT doc_id, lang, CAST(k AS BIGINT) AS shard, CAST(greatest(a, k * 2500) - a AS BIGINT) AS start, CAST(least(b, (k + 1) * 2500) - greatest(a, k * 2500) AS BIGINT) AS length FROM (SELECT *, unnest(range(a // 2500, (b - 1) // 2500 + 1)) AS k FROM c)""")
def c9_phase_targets(spark, sf_dir):
    """Documents packed until a phase's target, the last one cropped, in shards of 2,500."""
    targets = spark.createDataFrame([("de", 3000), ("en", 7000), ("es", 1), ("fr", 900000)], "lang string, target bigint")
    rows = table(spark, sf_dir, "documents").select("doc_id", "lang", (T.number_of(F.col("text"), T.WORD) + 1).alias("tokens"))
    items = S.running(rows, ["lang"], ["doc_id"], "tokens", span=F.floor(F.col("doc_id") / 4096)).join(F.broadcast(targets), "lang").where("start < target").withColumn("end", F.least("end", "target"))
    shards = items.withColumn("shard", F.explode(F.sequence(F.floor(F.col("start") / 2500), F.floor((F.col("end") - 1) / 2500))))
    a, b = F.greatest("start", F.col("shard") * 2500), F.least("end", (F.col("shard") + 1) * 2500)
    return shards.select("doc_id", "lang", "shard", (a - F.col("start")).alias("start"), (b - a).alias("length"))


@query("WITH c(source, n) AS (VALUES ('a', 50), ('b', 30), ('c', 20)), s AS (SELECT source, unnest(range(0, n)) AS i FROM c) SELECT CAST(row_number() OVER (ORDER BY sha256('42' || chr(0) || source || chr(0) || i), source, i) - 1 AS BIGINT) AS place, source FROM s")
def l7_weighted_schedule(spark, sf_dir):
    """A seeded order of sources, each as often as its weight says: slots in the order of their hashes."""
    from ..operators.mixture import planned_counts

    weights = {"a": 0.5, "b": 0.3, "c": 0.2}
    counts = dict(zip(weights, planned_counts(list(weights.values()), 100)))
    slots = spark.createDataFrame(list(counts.items()), "source string, n bigint").select("source", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("n") - 1)).alias("i"))
    hashed = slots.withColumn("h", H.keyed(F.lit(42), F.col("source"), F.col("i"))).withColumn("one", F.lit(1)).withColumn("all", F.lit(0))
    return S.running(hashed, ["all"], ["h", "source", "i"], "one", span=F.substring("h", 1, 1)).select(F.col("start").alias("place"), "source")


@query(r"""WITH RECURSIVE d AS (SELECT vec_id AS id, vec_id % 400 AS digest, vec_id % 7 AS priority, (vec_id % 400 * 40503) & 65535 AS fp FROM embeddings), w AS (SELECT digest, arg_min(id, struct_pack(a := -priority, b := id)) AS id, any_value(fp) AS fp, max(priority) AS priority FROM d GROUP BY digest), l AS (SELECT a.id AS u, b.id AS v FROM w a JOIN w b ON a.id <> b.id AND bit_count(xor(a.fp, b.fp)) <= 1),
reach(node, other) AS (SELECT u, u FROM l UNION SELECT r.node, l.v FROM reach r JOIN l ON r.other = l.u), c AS (SELECT node, min(other) AS component FROM reach GROUP BY node), k AS (SELECT w.id, coalesce(component, w.id) AS component, priority FROM w LEFT JOIN c ON w.id = c.node), b AS (SELECT component, arg_min(id, struct_pack(a := -priority, b := id)) AS keeper FROM k GROUP BY component)
SELECT id, CASE WHEN id NOT IN (SELECT id FROM w) THEN 'exact_lower_priority' WHEN id NOT IN (SELECT keeper FROM b) THEN 'near_duplicate' END AS reason FROM d""")
def a1_exact_and_near_reasons(spark, sf_dir):
    """Why each row goes: the digest's copy of more priority stays, then one of each component of near fingerprints."""
    from ..operators import dedup as D
    from ..operators import graph as G

    i = F.col("vec_id")
    rows = table(spark, sf_dir, "embeddings").select(i.alias("id"), (i % 400).alias("digest"), (i % 7).alias("priority"), (i % 400 * 40503).bitwiseAND(F.lit(65535).cast("bigint")).alias("fp"))
    return D.exact_and_near(rows, "id", "digest", "fp", [-F.col("priority"), F.col("id")], 1, G.connected_components)
