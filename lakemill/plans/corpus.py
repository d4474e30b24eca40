"""Dedup, components, decontamination, selection, packing, sampling over documents."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import hashing as H
from ..functions import text as T
from ..operators import decontam as C
from ..operators import dedup as D
from ..operators import evidence as E
from ..operators import graph as G
from ..operators import select as S
from ..operators import similar as N
from .registry import query, table

_CANON = r"trim(regexp_replace(lower(text), '[\s\x0b]+', ' ', 'g'))"
_KEYED = f"SELECT d.doc_id, d.lang, d.source, sha256({_CANON}) AS dedup_hash, d.doc_id % 100 AS priority, CAST(coalesce(l.quality, -1) AS DOUBLE) AS quality_score, length(text) AS chars FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id"


def keyed(spark, sf_dir):
    """Documents as dedup sees them: digest, priority, quality (-1: unknown), no text."""
    labels = table(spark, sf_dir, "labels").select("doc_id", "quality")
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "source", H.sha256(T.canonical(F.col("text"))).alias("dedup_hash"), F.length("text").cast("bigint").alias("chars"))
    return docs.join(labels, "doc_id", "left").withColumn("priority", F.col("doc_id") % 100).withColumn("quality_score", F.coalesce(F.col("quality").cast("double"), F.lit(-1.0))).drop("quality")


@query(f"SELECT doc_id FROM ({_KEYED}) QUALIFY row_number() OVER (PARTITION BY dedup_hash ORDER BY priority DESC, sha256(CAST(doc_id AS VARCHAR)), doc_id) = 1")
def a2_exact_winners(spark, sf_dir):
    order = [-F.col("priority"), H.sha256(F.col("doc_id").cast("string")), F.col("doc_id")]
    return keyed(spark, sf_dir).groupBy("dedup_hash").agg(F.min_by("doc_id", F.struct(*[o.alias(f"o{i}") for i, o in enumerate(order)])).alias("doc_id")).select("doc_id")


@query(f"SELECT dedup_hash, doc_id, priority, quality_score FROM ({_KEYED}) QUALIFY row_number() OVER (PARTITION BY dedup_hash ORDER BY priority DESC, quality_score < 0, quality_score DESC, doc_id) = 1")
def a18_winner_order(spark, sf_dir):
    rows = keyed(spark, sf_dir).select("dedup_hash", "doc_id", "priority", "quality_score")
    return D.winners(rows, ["dedup_hash"], D.winner_order())


@query(f"SELECT doc_id, first_value(doc_id) OVER w AS winner FROM ({_KEYED}) WINDOW w AS (PARTITION BY dedup_hash ORDER BY priority DESC, quality_score < 0, quality_score DESC, doc_id) QUALIFY row_number() OVER w > 1")
def a1_j5_duplicates(spark, sf_dir):
    return D.duplicates(keyed(spark, sf_dir), "dedup_hash", D.winner_order())


@query(f"SELECT doc_id, dedup_hash AS final_content_sha256 FROM ({_KEYED}) QUALIFY row_number() OVER (PARTITION BY dedup_hash ORDER BY priority DESC, quality_score < 0, quality_score DESC, doc_id) = 1")
def a3_j1_removed_anti_join(spark, sf_dir):
    rows = keyed(spark, sf_dir)
    return D.remove(rows, D.duplicates(rows, "dedup_hash", D.winner_order())).select("doc_id", F.col("dedup_hash").alias("final_content_sha256"))


@query(f"""WITH d AS (SELECT *, doc_id % 10 AS batch FROM ({_KEYED})), deliveries AS (SELECT * FROM d UNION ALL SELECT * FROM d WHERE batch < 3)
SELECT CAST(count(*) AS BIGINT) AS input_rows, count(DISTINCT doc_id) AS raw_occurrences, count(DISTINCT dedup_hash) AS unique_winners, count(*) - count(DISTINCT doc_id) AS repeated_deliveries, count(DISTINCT doc_id) - count(DISTINCT dedup_hash) AS duplicate_occurrences FROM deliveries""")
def a17_a22_status(spark, sf_dir):
    """Three of ten batches are delivered twice."""
    rows = keyed(spark, sf_dir).withColumn("occurrence_id", F.col("doc_id"))
    return D.status(rows.unionByName(rows.where("doc_id % 10 < 3")))


@query(f"SELECT doc_id, dedup_hash FROM ({_KEYED})")
def a19_canonical_occurrences(spark, sf_dir):
    rows = keyed(spark, sf_dir).select("doc_id", "dedup_hash")
    return D.merged(rows, rows.where("doc_id % 10 < 3"), ["dedup_hash"], [F.col("doc_id")], ["dedup_hash", "doc_id"])


@query(f"SELECT dedup_hash, count(*) AS occurrences, min(doc_id) AS first_doc, sum(chars) AS raw_chars, max(chars) AS winner_chars FROM ({_KEYED}) GROUP BY dedup_hash HAVING count(*) > 1")
def a20_j18_run_summary(spark, sf_dir):
    return keyed(spark, sf_dir).groupBy("dedup_hash").agg(F.count("*").alias("occurrences"), F.min("doc_id").alias("first_doc"), F.sum("chars").alias("raw_chars"), F.max("chars").alias("winner_chars")).where("occurrences > 1")


_SENT = r"list_filter(list_transform(regexp_split_to_array(regexp_replace(text, '([.!?]+)([\s\x0b]+|$)', '\1' || chr(1), 'g'), '[\x01\n]'), lambda s: trim(regexp_replace(s, '[\s\x0b]+', ' ', 'g'))), lambda s: s <> '')"
_SPANS = f"""WITH s AS (SELECT doc_id, {_SENT} AS s FROM documents), w AS (SELECT doc_id, unnest(range(1, len(s) - 1)) AS i, s FROM s WHERE len(s) >= 3),
d AS (SELECT doc_id, CAST(i - 1 AS INTEGER) AS pos, sha256(lower(array_to_string(s[i:i+2], chr(30)))) AS digest FROM w WHERE len(regexp_extract_all(array_to_string(s[i:i+2], ' '), '[\\p{{L}}\\p{{N}}_]+')) >= 24),
r AS (SELECT digest, arg_min(doc_id, struct_pack(a := -(doc_id % 100), b := doc_id)) AS keeper FROM d GROUP BY digest HAVING min(doc_id) <> max(doc_id)), sp AS (SELECT doc_id, pos, d.digest, keeper FROM d JOIN r ON d.digest = r.digest)"""


@query(_SPANS + " SELECT doc_id, pos, digest, keeper FROM sp")
def a4_a5_shared_spans(spark, sf_dir):
    return D.shared_spans(table(spark, sf_dir, "documents"), order=-(F.col("doc_id") % 100))


@query(_SPANS + """, gone AS (SELECT DISTINCT doc_id, pos + j AS pos FROM sp, (SELECT unnest([0, 1, 2]) AS j) WHERE doc_id <> keeper), e AS (SELECT doc_id, unnest(s) AS x, generate_subscripts(s, 1) - 1 AS pos FROM s),
k AS (SELECT s.doc_id, CAST(len(s.s) AS INTEGER) AS n_sentences, CAST(len(s.s) - count(e.pos) FILTER (g.pos IS NULL) AS INTEGER) AS n_removed, count(e.pos) FILTER (g.pos IS NULL) AS left_over, coalesce(string_agg(e.x, ' ' ORDER BY e.pos) FILTER (g.pos IS NULL), '') AS t FROM s LEFT JOIN e ON s.doc_id = e.doc_id LEFT JOIN gone g ON e.doc_id = g.doc_id AND e.pos = g.pos GROUP BY s.doc_id, s.s)
SELECT doc_id, n_sentences, n_removed, sha256(t) AS digest, CASE WHEN n_removed > 0 AND (len(regexp_extract_all(t, '[\\p{L}\\p{N}_]+')) < 50 OR left_over < 3) THEN 'dropped' WHEN n_removed > 0 THEN 'stripped' ELSE 'kept' END AS decision FROM k""".replace("\\\\", "\\"))
def a6_t15_span_filter(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return D.strip_spans(docs, D.shared_spans(docs, order=-(F.col("doc_id") % 100))).select("doc_id", "n_sentences", "n_removed", H.sha256(F.col("kept_text")).alias("digest"), "decision")


@query(r"""WITH t AS (SELECT doc_id, regexp_extract_all(text, '[\p{L}\p{N}_]+|[^\p{L}\p{N}_\s\x0b]') AS t FROM documents), b AS (SELECT doc_id, md5(array_to_string(t[i:i+95], ' ')) AS digest, count(*) AS w FROM (SELECT doc_id, t, unnest(range(1, len(t) - 94, 96)) AS i FROM t WHERE len(t) >= 96) GROUP BY ALL), f AS (SELECT digest, min(doc_id) AS first FROM b GROUP BY digest)
SELECT doc_id, CAST(sum(w) AS BIGINT) AS weight, CAST(sum(CASE WHEN first <> doc_id THEN w ELSE 0 END) AS BIGINT) AS duplicate_weight, sum(CASE WHEN first <> doc_id THEN w ELSE 0 END) / sum(w) >= 0.8 AS removed FROM b JOIN f ON b.digest = f.digest GROUP BY doc_id""")
def a7_a8_t35_block_duplicates(spark, sf_dir):
    return D.block_duplicates(table(spark, sf_dir, "documents"), T.found(F.col("text"), T.WORD_OR_MARK))


#: DuckDB: 200 minima of (a h + b) mod p over hashed 5-word shingles, in 20 bands of 10, and the components of equal bands.
_NEAR = r"""WITH RECURSIVE w AS (SELECT doc_id, lang, list_transform(regexp_extract_all(text, '[\p{L}\p{N}_]+'), lambda x: lower(x)) AS w FROM documents), g AS (SELECT doc_id, lang, unnest(list_distinct(list_transform(range(1, len(w) - 3), lambda i: CAST('0x' || left(md5(array_to_string(w[i:i+4], ' ')), 8) AS BIGINT)))) AS h FROM w WHERE len(w) >= 5),
k AS (SELECT unnest(range(0, 200)) AS k), ab AS (SELECT k, CAST((k + 1) * 2654435761 % 1073741789 AS BIGINT) AS a, CAST((k + 1) * 40503 * 65537 % 1073741827 AS BIGINT) AS b FROM k),
s AS (SELECT doc_id, lang, k, min((a * h + b) % 2147483647) AS m FROM g, ab GROUP BY ALL), b AS (SELECT doc_id, lang, k // 10 AS band, string_agg(m, ',' ORDER BY k) AS v FROM s GROUP BY ALL),
l AS (SELECT DISTINCT a.doc_id AS u, min(b.doc_id) AS v FROM b a JOIN b ON a.lang = b.lang AND a.band = b.band AND a.v = b.v GROUP BY a.doc_id, a.band, a.v), e AS (SELECT u, v FROM l WHERE u <> v UNION SELECT v, u FROM l WHERE u <> v),
reach(node, other) AS (SELECT u, u FROM e UNION SELECT r.node, e.v FROM reach r JOIN e ON r.other = e.u)"""


def signed(spark, sf_dir):
    """(doc_id, lang, s): 200 minima over 5-word shingles, each hashed once; none for shorter texts."""
    words = F.transform(T.found(F.col("text"), T.WORD), F.lower)
    shingles = F.array_distinct(F.transform(T.windows(words, 5), lambda w: H.short_hash(F.array_join(w, " "))))
    return D.signatures(table(spark, sf_dir, "documents").select("doc_id", "lang", shingles.alias("s")), "s", 200)


@query(_NEAR + " SELECT node AS doc_id, min(other) AS component FROM reach GROUP BY node")
def a9_a10_j15_minhash_components(spark, sf_dir):
    """Signatures of 20 bands of 10 minima; documents of a bucket are linked to its smallest, links are joined to components."""
    return G.connected_components(D.band_links(signed(spark, sf_dir), D.band_keys(F.col("s"), 10, F.col("lang")))).select(F.col("node").alias("doc_id"), "component")


@query(_NEAR + ", c AS (SELECT node, min(other) AS component FROM reach GROUP BY node) SELECT component, arg_min(node, struct_pack(a := -(node % 100), b := -(node * 7919 % 1009), c := node)) AS winner, count(*) - 1 AS removed FROM c GROUP BY component")
def a11_a12_component_winners(spark, sf_dir):
    """Most priority, then the larger tie-break, then the smaller node."""
    nodes = a9_a10_j15_minhash_components(spark, sf_dir)
    order = F.struct(-(F.col("doc_id") % 100), -(F.col("doc_id") * 7919 % 1009), F.col("doc_id"))
    return nodes.groupBy("component").agg(F.min_by("doc_id", order).alias("winner"), (F.count("*") - 1).alias("removed"))


@query()
def a9_a10_j15_similar_components(spark, sf_dir):
    """Documents of one language that links of similarity 0.8 or more over 5-word shingles join: every such pair, and no other."""
    words = F.transform(T.found(F.col("text"), T.WORD), F.lower)
    rows = table(spark, sf_dir, "documents").select("doc_id", "lang", words.alias("w")).where("size(w) >= 5").select("doc_id", "lang", F.array_join("w", " ").alias("text"))
    rows = G.cut(rows)  # read many times
    found = G.cut(N.groups(rows, lambda df, name: G.cut(df), G.connected_components, G.forget, scope="lang").select("doc_id", F.col("component_id").alias("component")))
    G.forget(rows)
    return found.join(found.groupBy("component").agg(F.count("*").alias("n")).where("n > 1").select("component").hint("merge"), "component", "left_semi").select("doc_id", "component")


@query()
def a11_a12_similar_winners(spark, sf_dir):
    """As a11_a12_component_winners, of the components by similarity."""
    order = F.struct(-(F.col("doc_id") % 100), -(F.col("doc_id") * 7919 % 1009), F.col("doc_id"))
    return a9_a10_j15_similar_components(spark, sf_dir).groupBy("component").agg(F.min_by("doc_id", order).alias("winner"), (F.count("*") - 1).alias("removed"))


@query(r"""WITH f AS (SELECT vec_id AS id, (vec_id * 40503) & 65535 | ((vec_id % 50) << 16) AS fp FROM embeddings), o AS (SELECT fp, min(id) AS id FROM f GROUP BY fp)
SELECT a.id AS a, b.id AS b, CAST(bit_count(xor(a.fp, b.fp)) AS BIGINT) AS distance FROM o a JOIN o b ON a.id < b.id WHERE bit_count(xor(a.fp, b.fp)) <= 3""")
def j14_simhash_bands(spark, sf_dir):
    """Within three bits one of four bands agrees, so no pair is lost."""
    fp = (F.col("vec_id") * 40503).bitwiseAND(F.lit(65535).cast("bigint")).bitwiseOR(F.shiftleft(F.col("vec_id") % 50, 16))
    return D.greedy_simhash(table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("doc_id"), fp.alias("fp")), "fp")


_GRAMS = r"""WITH dw AS (SELECT doc_id, list_transform(regexp_extract_all(text, '[\p{L}\p{N}_]+'), lambda x: lower(x)) AS w FROM documents), hw AS (SELECT item_id, list_transform(regexp_extract_all(text, '[\p{L}\p{N}_]+'), lambda x: lower(x)) AS w FROM benchmark),
dg AS (SELECT doc_id, i - 1 AS pos, md5(array_to_string(w[i:i+12], ' ')) AS gram FROM (SELECT doc_id, w, unnest(range(1, len(w) - 11)) AS i FROM dw WHERE len(w) >= 13)), hg AS (SELECT DISTINCT item_id, md5(array_to_string(w[i:i+12], ' ')) AS gram FROM (SELECT item_id, w, unnest(range(1, len(w) - 11)) AS i FROM hw WHERE len(w) >= 13)),
ix AS (SELECT * FROM hg WHERE gram IN (SELECT gram FROM hg GROUP BY gram HAVING count(*) <= 32)), m AS (SELECT doc_id, item_id, count(DISTINCT dg.gram) AS n FROM dg JOIN ix ON dg.gram = ix.gram GROUP BY ALL),
h AS (SELECT DISTINCT doc_id, item_id, pos FROM dg JOIN ix ON dg.gram = ix.gram), isl AS (SELECT doc_id, item_id, pos - row_number() OVER (PARTITION BY doc_id, item_id ORDER BY pos) AS isl FROM h), r AS (SELECT doc_id, item_id, max(n) AS run FROM (SELECT doc_id, item_id, isl, count(*) AS n FROM isl GROUP BY ALL) GROUP BY ALL)"""


def _hits(spark, sf_dir):
    return C.hits(table(spark, sf_dir, "documents"), C.index(table(spark, sf_dir, "benchmark")))


@query(_GRAMS + " SELECT doc_id, item_id, n AS n_grams FROM m")
def j6_a14_ngram_matches(spark, sf_dir):
    return C.matches(_hits(spark, sf_dir)).select("doc_id", F.col("group").alias("item_id"), "n_grams")


@query(_GRAMS + " SELECT doc_id, item_id, run FROM r")
def a16_longest_run(spark, sf_dir):
    return C.runs(_hits(spark, sf_dir)).withColumnRenamed("group", "item_id")


#: DuckDB: matches of another family: its tokens, the length of its grams, and the least that match.
def _family(name: str, tokens: str, where: str) -> str:
    n, least = C.FAMILIES[name]
    grams = lambda table, key: f"(SELECT {key}, md5(array_to_string(w[i:i+{n - 1}], chr(1))) AS gram FROM (SELECT {key}, w, unnest(range(1, len(w) - {n - 2})) AS i FROM (SELECT {key}, {tokens} AS w FROM {table} WHERE {where}) WHERE len(w) >= {n}))"
    return f""", {name}_d AS {grams('documents', 'doc_id')}, {name}_h AS (SELECT DISTINCT item_id, gram FROM {grams('benchmark', 'item_id')}), {name}_t AS (SELECT doc_id, count(DISTINCT gram) AS total FROM {name}_d GROUP BY doc_id),
{name}_x AS (SELECT m.doc_id FROM (SELECT doc_id, item_id, count(DISTINCT d.gram) AS n FROM {name}_d d JOIN {name}_h h ON d.gram = h.gram WHERE h.gram IN (SELECT gram FROM {name}_h GROUP BY gram HAVING count(*) <= 32) GROUP BY ALL) m JOIN {name}_t t ON m.doc_id = t.doc_id WHERE n >= greatest({least}, ceil(total * 0.002)))"""


_TOKENS = f"regexp_extract_all(text, '{E.CODE_TOKEN.replace(chr(39), chr(39) * 2)}')"
_KEPT = ", ".join(f"'{w}'" for w in E.KEYWORDS)
_SKELETON = f"list_transform({_TOKENS}, lambda x: CASE WHEN list_contains([{_KEPT}], lower(x)) THEN lower(x) WHEN regexp_matches(x, '^[A-Za-z_$]') THEN '<id>' WHEN regexp_matches(x, '^[0-9]') THEN '<num>' WHEN regexp_matches(x, '^[\"''`]') THEN '<str>' ELSE x END)"
_CODED = f"(regexp_matches(text, '(?m){E.CODE_MARK}') OR len(regexp_extract_all(text, '[{{}}();=]')) >= 4)"
_WORDS = r"list_transform(regexp_extract_all(text, '[\p{L}\p{N}_]+'), lambda x: lower(x))"


@query(_GRAMS + _family("code_ngram", _TOKENS, _CODED) + _family("code_skeleton_ngram", _SKELETON, _CODED) + _family("short_ngram", _WORDS, "true") + f""", t AS (SELECT doc_id, count(DISTINCT gram) AS total FROM dg GROUP BY doc_id), x AS (SELECT doc_id, 0 AS k FROM documents WHERE {_CANON} IN (SELECT {_CANON} FROM benchmark) UNION ALL SELECT doc_id, 1 FROM r WHERE run >= 8 UNION ALL SELECT m.doc_id, 2 FROM m JOIN t ON m.doc_id = t.doc_id WHERE n >= greatest(2, ceil(total * 0.002))
UNION ALL SELECT doc_id, 3 FROM code_ngram_x UNION ALL SELECT doc_id, 4 FROM code_skeleton_ngram_x UNION ALL SELECT doc_id, 5 FROM short_ngram_x)
SELECT doc_id, ['exact', 'contiguous_run', 'ngram', 'code_ngram', 'code_skeleton_ngram', 'short_ngram'][min(k) + 1] AS reason FROM x GROUP BY doc_id""")
def a15_j7_contamination(spark, sf_dir):
    """All six rules, each per single holdout group."""
    return C.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


_TOK = r"CAST(len(regexp_extract_all(text, '[\p{L}\p{N}_]+')) + 1 AS BIGINT)"


def counted(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", "lang", "source", (T.number_of(F.col("text"), T.WORD) + 1).alias("tokens"))


@query(rf"""WITH w AS (SELECT source, sum({_TOK}) AS tokens FROM documents GROUP BY source), f AS (SELECT source, CAST(tokens AS HUGEINT) * 1000 // sum(tokens) OVER () AS f, CAST(tokens AS HUGEINT) * 1000 % sum(tokens) OVER () AS r FROM w)
SELECT source, CAST(f + CASE WHEN row_number() OVER (ORDER BY r DESC, source) <= 1000 - sum(f) OVER () THEN 1 ELSE 0 END AS BIGINT) AS share FROM f""")
def l5_l6_hamilton(spark, sf_dir):
    """The window has one row a source, after an aggregate."""
    weights = counted(spark, sf_dir).groupBy("source").agg(F.sum("tokens").alias("tokens"))
    return S.hamilton(weights, 1000, "source", "tokens").select("source", "share")


@query(rf"""WITH d AS (SELECT doc_id, source, {_TOK} AS tokens, round(CAST('0x' || left(sha256('11' || chr(0) || source || chr(0) || doc_id), 13) AS BIGINT) / 4503599627370496.0, 12) AS fr FROM documents), s AS (SELECT *, sum(tokens) OVER (PARTITION BY source ORDER BY fr, doc_id) AS e FROM d),
t AS (SELECT source, sum(tokens) AS total FROM d GROUP BY source), q AS (SELECT source, 'a' AS phase, 0 AS a, total // 4 AS b FROM t UNION ALL SELECT source, 'b', total // 4, total // 2 FROM t)
SELECT doc_id, s.source, phase, CAST(greatest(e - tokens, a) - (e - tokens) AS BIGINT) AS token_start, CAST(least(e, b) - greatest(e - tokens, a) AS BIGINT) AS token_count FROM s JOIN q ON s.source = q.source WHERE greatest(e - tokens, a) < least(e, b)""")
def l11_j17_quota_overlap(spark, sf_dir):
    """Documents in stable random order fill two phases a source; one that crosses a bound is cut."""
    rows = counted(spark, sf_dir).withColumn("fr", F.round(H.stable_fraction(F.lit(11), F.col("source"), F.col("doc_id")), 12))
    items = S.running(rows, ["source"], ["fr", "doc_id"], "tokens", span=F.floor(F.col("fr") * 4096))
    total = rows.groupBy("source").agg(F.sum("tokens").alias("t"))
    quarter, half = F.floor(F.col("t") / 4), F.floor(F.col("t") / 2)
    quotas = total.select("source", F.explode(F.array(F.struct(F.lit("a").alias("phase"), F.lit(0).cast("bigint").alias("start"), quarter.alias("end")), F.struct(F.lit("b").alias("phase"), quarter.alias("start"), half.alias("end")))).alias("q")).select("source", "q.*")
    return S.overlaps(items, F.broadcast(quotas), ["source"]).select("doc_id", "source", "phase", F.col("cut_start").cast("bigint").alias("token_start"), F.col("cut_length").cast("bigint").alias("token_count"))


@query(rf"""WITH d AS (SELECT doc_id, lang, sha256('3' || chr(0) || doc_id) AS h FROM documents), r AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY h, doc_id) AS r FROM d), q AS (SELECT *, r <= CASE lang WHEN 'en' THEN 20 WHEN 'de' THEN 10 ELSE 5 END AS own FROM r)
SELECT doc_id, lang, NOT own AS filled FROM (SELECT *, row_number() OVER (PARTITION BY own ORDER BY h, doc_id) AS k FROM q) WHERE own OR k <= 60 - 40""")
def l4_category_quota_top_k(spark, sf_dir):
    """The smallest hashes of each language up to its quota, then of all the rest up to the capacity."""
    rows = table(spark, sf_dir, "documents").select("doc_id", "lang", H.keyed(F.lit(3), F.col("doc_id")).alias("h"))
    quotas = spark.createDataFrame([("en", 20), ("de", 10), ("fr", 5), ("es", 5)], "lang string, quota int")
    return S.per_category(rows, quotas, "lang", ["h", "doc_id"], 60, 20).select("doc_id", "lang", "filled")


@query(r"""SELECT doc_id, source, before FROM (SELECT doc_id, source, CAST(coalesce(sum(length(text)) OVER (PARTITION BY source ORDER BY sha256('5' || chr(0) || doc_id), doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS before FROM documents) WHERE before < 5000""")
def l14_a45_until_target(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select("doc_id", "source", F.length("text").alias("chars"))
    h = H.keyed(F.lit(5), F.col("doc_id"))
    return S.until_target(rows, ["source"], [h, F.col("doc_id")], "chars", 5000, F.substring(h, 1, 3)).select("doc_id", "source", "before")


@query(rf"""WITH d AS (SELECT doc_id, source, lang, octet_length(encode(text)) AS bytes, sha256(text) AS c FROM documents), w AS (SELECT lang, sum(bytes) AS w FROM d GROUP BY lang), f AS (SELECT lang, CAST(w AS HUGEINT) * 60000 // sum(w) OVER () AS f, CAST(w AS HUGEINT) * 60000 % sum(w) OVER () AS r FROM w), quota AS (SELECT lang, CAST(f + CASE WHEN row_number() OVER (ORDER BY r DESC, lang) <= 60000 - sum(f) OVER () THEN 1 ELSE 0 END AS BIGINT) AS share FROM f),
u AS (SELECT lang, c, min(doc_id) AS doc_id, any_value(bytes) AS bytes FROM d GROUP BY lang, c), s AS (SELECT *, coalesce(sum(bytes) OVER (PARTITION BY lang ORDER BY sha256('9' || chr(0) || lang || chr(0) || c) ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM u)
SELECT doc_id, s.lang, CAST(least(bytes, share - before) AS BIGINT) AS taken FROM s JOIN quota ON s.lang = quota.lang WHERE before < share""")
def l16_l17_stratified_sample(spark, sf_dir):
    """Distinct texts of each language in hash order until its exact byte quota; the last one is cut."""
    rows = table(spark, sf_dir, "documents").select("doc_id", "lang", F.octet_length("text").alias("bytes"), H.sha256(F.col("text")).alias("c"))
    quotas = S.hamilton(rows.groupBy("lang").agg(F.sum("bytes").alias("w")), 60000, "lang", "w").select("lang", "share")
    unique = rows.groupBy("lang", "c").agg(F.min("doc_id").alias("doc_id"), F.first("bytes").alias("bytes"))
    h = H.keyed(F.lit(9), F.col("lang"), F.col("c"))
    ahead = S.until_target(unique, ["lang"], [h], "bytes", 60000, F.substring(h, 1, 3))
    return ahead.join(F.broadcast(quotas), "lang").where("before < share").select("doc_id", "lang", F.least("bytes", F.col("share") - F.col("before")).cast("bigint").alias("taken"))


@query(r"SELECT lang, sum(length(text)) AS chars, CAST(sum(length(text)) // 4 + CASE WHEN 0 < sum(length(text)) % 4 THEN 1 ELSE 0 END AS BIGINT) AS first_part, CAST(sum(length(text)) // 4 AS BIGINT) AS last_part FROM documents GROUP BY lang")
def l24_balanced_parts(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").groupBy("lang").agg(F.sum(F.length("text")).alias("chars"))
    parts = S.balanced(F.col("chars"), 4)
    return rows.select("lang", "chars", F.get(parts, F.lit(0)).alias("first_part"), F.get(parts, F.lit(3)).alias("last_part"))


@query()
def l9_l10_replacement(spark, sf_dir):
    """Languages short of a common quota take it from others; strict, over one row a language."""
    have = {r["lang"]: r["n"] for r in table(spark, sf_dir, "documents").groupBy("lang").agg(F.count("*").alias("n")).collect()}
    need = {k: sum(have.values()) // 5 for k in have}
    donors = {k: sorted(have, key=lambda d: (-have[d], d)) for k in have}
    return spark.createDataFrame(S.replace(have, need, donors), "target string, donor string, amount bigint")


@query()
def l15_whole_object_pack(spark, sf_dir):
    """Newest first, whole sources only, leaving out what does not fit; one row a source."""
    rows = [(r["source"], r["n"]) for r in table(spark, sf_dir, "documents").groupBy("source").agg(F.sum("n_chars").alias("n"), F.max("doc_id").alias("newest")).orderBy(F.desc("newest"), "source").collect()]
    return spark.createDataFrame([(x,) for x in S.greedy_whole(rows, sum(n for _, n in rows) // 3)], "source string")


_PACK = rf"WITH d AS (SELECT doc_id, lang, {_TOK} AS tokens FROM documents), s AS (SELECT doc_id, lang, tokens, CAST(sum(tokens) OVER (PARTITION BY lang ORDER BY doc_id) AS BIGINT) AS e FROM d)"


@query(_PACK + " SELECT doc_id, lang, CAST(k AS BIGINT) AS shard, CAST(greatest(e - tokens, k * 5000) - (e - tokens) AS BIGINT) AS start, CAST(least(e, (k + 1) * 5000) - greatest(e - tokens, k * 5000) AS BIGINT) AS length FROM (SELECT *, unnest(range((e - tokens) // 5000, (e - 1) // 5000 + 1)) AS k FROM s)")
def c9_w4_exact_packing(spark, sf_dir):
    """Documents with their end token, one after the other, cut at shard bounds."""
    items = S.running(counted(spark, sf_dir), ["lang"], ["doc_id"], "tokens", span=F.floor(F.col("doc_id") / 4096))
    shards = items.withColumn("shard", F.explode(F.sequence(F.floor(F.col("start") / 5000), F.floor((F.col("end") - 1) / 5000))))
    a, b = F.greatest("start", F.col("shard") * 5000), F.least("end", (F.col("shard") + 1) * 5000)
    return shards.select("doc_id", "lang", "shard", (a - F.col("start")).alias("start"), (b - a).alias("length"))


@query(_PACK + ", t AS (SELECT doc_id, lang, e - tokens AS start, e, lag(e) OVER (PARTITION BY lang ORDER BY doc_id) AS p FROM s) SELECT lang, count(*) AS spans, count(*) FILTER (coalesce(p, 0) <> start) AS breaks FROM t GROUP BY lang")
def w7_contiguity_audit(spark, sf_dir):
    items = S.running(counted(spark, sf_dir), ["lang"], ["doc_id"], "tokens", span=F.floor(F.col("doc_id") / 4096))
    # the end before a span's first document is the last one of the span before: one row a span in the outer window
    spans = items.withColumn("_s", F.floor(F.col("doc_id") / 4096))
    last = spans.groupBy("lang", "_s").agg(F.max_by("end", "doc_id").alias("_end")).withColumn("_end", F.lag("_end").over(Window.partitionBy("lang").orderBy("_s")))
    before = F.coalesce(F.lag("end").over(Window.partitionBy("lang", "_s").orderBy("doc_id")), F.col("_end"), F.lit(0))
    met = spans.join(last.hint("merge"), ["lang", "_s"]).withColumn("ok", before == F.col("start"))
    return met.groupBy("lang").agg(F.count("*").alias("spans"), F.count(F.when(~F.col("ok"), 1)).alias("breaks"))


@query(_PACK + ", p AS (SELECT lang, unnest(range(0, max(e), 997)) AS position FROM s GROUP BY lang) SELECT p.lang, CAST(position AS BIGINT) AS position, doc_id, CAST(position - (e - tokens) AS BIGINT) AS at FROM p JOIN s ON p.lang = s.lang AND position >= e - tokens AND position < e")
def j16_s22_position_lookup(spark, sf_dir):
    """Which document holds the token at a position: ranges are met in buckets of positions, not by comparing all."""
    items = S.running(counted(spark, sf_dir), ["lang"], ["doc_id"], "tokens", span=F.floor(F.col("doc_id") / 4096))
    wide = 4096
    pieces = items.withColumn("bucket", F.explode(F.sequence(F.floor(F.col("start") / wide), F.floor((F.col("end") - 1) / wide))))
    asked = items.groupBy("lang").agg(F.max("end").alias("n")).select("lang", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("n") - 1, F.lit(997).cast("bigint"))).alias("position")).withColumn("bucket", F.floor(F.col("position") / wide))
    return asked.join(pieces, ["lang", "bucket"]).where("position >= start AND position < end").select("lang", "position", "doc_id", (F.col("position") - F.col("start")).alias("at"))


@query(_PACK + " SELECT doc_id, CASE WHEN sha1(CAST(doc_id AS VARCHAR)) < '2' THEN 'val' ELSE 'train' END AS split, CAST(greatest(0, least(tokens, 20000 - (c - tokens))) AS BIGINT) AS taken FROM (SELECT *, sum(tokens) OVER (PARTITION BY sha1(CAST(doc_id AS VARCHAR)) < '2' ORDER BY doc_id) AS c FROM s)")
def w5_k9_cropped_splits(spark, sf_dir):
    rows = counted(spark, sf_dir).withColumn("split", F.when(F.sha1(F.col("doc_id").cast("string").cast("binary")) < "2", "val").otherwise("train"))
    items = S.running(rows, ["split"], ["doc_id"], "tokens", span=F.floor(F.col("doc_id") / 4096))
    return items.select("doc_id", "split", F.greatest(F.lit(0), F.least("tokens", F.lit(20000) - F.col("start"))).cast("bigint").alias("taken"))


@query(r"""WITH w AS (SELECT doc_id, len(regexp_extract_all(text, '[\p{L}\p{N}_]+')) AS n FROM documents), s AS (SELECT doc_id, n, unnest(range(0, n, 64)) AS target_start FROM w WHERE n > 0)
SELECT doc_id, CAST(greatest(0, target_start + least(64, n - target_start) - 128) AS BIGINT) AS context_start, CAST(target_start AS BIGINT) AS target_start, CAST(least(n, target_start + 64) AS BIGINT) AS target_end FROM s""")
def w12_rolling_windows(spark, sf_dir):
    """Each word is a target once, with a full window of context before it where there is one."""
    rows = table(spark, sf_dir, "documents").select("doc_id", T.number_of(F.col("text"), T.WORD).alias("n")).where("n > 0")
    at = rows.select("doc_id", "n", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("n") - 1, F.lit(64).cast("bigint"))).alias("target_start"))
    end = F.least("n", F.col("target_start") + 64)
    return at.select("doc_id", F.greatest(F.lit(0), end - 128).cast("bigint").alias("context_start"), "target_start", end.alias("target_end"))


@query(r"""WITH w AS (SELECT doc_id, regexp_extract_all(text, '[\p{L}\p{N}_]+') AS w FROM documents), c AS (SELECT doc_id, doc_id % 2 AS lane, doc_id // 2 AS pair, unnest(range(0, len(w), 50)) // 50 AS chunk, len(w) AS n FROM w) SELECT pair, CAST(row_number() OVER (PARTITION BY pair ORDER BY chunk, lane) - 1 AS INTEGER) AS place, doc_id, CAST(chunk AS BIGINT) AS chunk FROM c""")
def c12_interleaved_chunks(spark, sf_dir):
    """Chunks of two documents in turn."""
    rows = table(spark, sf_dir, "documents").select("doc_id", (F.col("doc_id") % 2).alias("lane"), F.floor(F.col("doc_id") / 2).alias("pair"), T.number_of(F.col("text"), T.WORD).alias("n")).where("n > 0")
    chunks = rows.select("doc_id", "lane", "pair", F.explode(F.sequence(F.lit(0).cast("bigint"), F.floor((F.col("n") - 1) / 50))).alias("chunk"))
    return chunks.select("pair", (F.row_number().over(Window.partitionBy("pair").orderBy("chunk", "lane")) - 1).alias("place"), "doc_id", "chunk")


@query(r"""WITH w AS (SELECT doc_id, regexp_extract_all(text, '[\p{L}\p{N}_]+') AS w FROM documents), p AS (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS i FROM w) SELECT doc_id, CAST(i - 1 AS INTEGER) AS pos, w[i] AS token, CASE WHEN i < len(w) THEN w[i + 1] END AS label FROM p""")
def c14_w8_shifted_labels(spark, sf_dir):
    """The next token is the label, of all words of each document; only its last has none, so none crosses a document's end."""
    rows = table(spark, sf_dir, "documents").select("doc_id", T.found(F.col("text"), T.WORD).alias("w"))
    both = F.arrays_zip(F.col("w").alias("token"), F.slice("w", 2, F.greatest(F.size("w") - 1, F.lit(0))).alias("label"))
    return rows.select("doc_id", F.posexplode(both).alias("pos", "x")).select("doc_id", "pos", "x.token", "x.label")


@query(r"""WITH d AS (SELECT doc_id, len(regexp_extract_all(text, '[\p{L}\p{N}_]+')) + 1 AS n FROM documents), s AS (SELECT doc_id // 16 AS row_id, doc_id, n, sum(n) OVER (PARTITION BY doc_id // 16 ORDER BY doc_id) - n AS start FROM d)
SELECT row_id, CAST(row_number() OVER (PARTITION BY row_id ORDER BY doc_id) AS BIGINT) AS document, CAST(start AS BIGINT) AS first_token, CAST(start + n AS BIGINT) AS reset_at FROM s""")
def w8_reset_mask_documents(spark, sf_dir):
    """Rows of 16 documents as one stream of tokens; a token whose mask says reset begins the next document, so the document of a token is the number of resets up to it."""
    words = table(spark, sf_dir, "documents").select("doc_id", F.floor(F.col("doc_id") / 16).alias("row_id"), (T.number_of(F.col("text"), T.WORD) + 1).alias("n"))
    start = S.running(words, ["row_id"], ["doc_id"], "n")
    tokens = start.select("row_id", "start", "end", F.explode(F.sequence("start", F.col("end") - 1)).alias("at")).select("row_id", "at", (F.col("at") == F.col("start")).cast("bigint").alias("reset"))
    told = tokens.withColumn("document", F.sum("reset").over(Window.partitionBy("row_id").orderBy("at")))
    return told.groupBy("row_id", "document").agg(F.min("at").alias("first_token"), (F.max("at") + 1).alias("reset_at"))


@query(r"""WITH d AS (SELECT source, {t} AS tokens, n_chars >= 2000 AS long FROM documents) SELECT source, sum(tokens) AS total, sum(CASE WHEN long THEN tokens ELSE 0 END) AS long_total, CAST(count(*) FILTER (long) AS BIGINT) AS long_docs FROM d GROUP BY source""".replace("{t}", _TOK))
def a28_a29_token_totals(spark, sf_dir):
    rows = counted(spark, sf_dir).join(table(spark, sf_dir, "documents").select("doc_id", (F.col("n_chars") >= 2000).alias("long")), "doc_id")
    return rows.groupBy("source").agg(F.sum("tokens").alias("total"), F.sum(F.when(F.col("long"), F.col("tokens")).otherwise(0)).alias("long_total"), F.count(F.when(F.col("long"), 1)).alias("long_docs"))


@query(rf"""SELECT source, lang, sum({_TOK}) AS tokens, count(*) AS docs FROM documents GROUP BY ROLLUP (source, lang)""")
def a31_a33_rollup(spark, sf_dir):
    return counted(spark, sf_dir).rollup("source", "lang").agg(F.sum("tokens").alias("tokens"), F.count("*").alias("docs"))


@query(r"""WITH a AS (SELECT doc_id FROM documents WHERE doc_id % 7 <> 0), b AS (SELECT doc_id FROM labels) SELECT doc_id, 'missing' AS side FROM a WHERE doc_id NOT IN (SELECT doc_id FROM b) UNION ALL SELECT doc_id, 'unexpected' FROM b WHERE doc_id NOT IN (SELECT doc_id FROM a)""")
def o2_coverage(spark, sf_dir):
    a, b = table(spark, sf_dir, "documents").where("doc_id % 7 <> 0").select("doc_id"), table(spark, sf_dir, "labels").select("doc_id")
    return a.exceptAll(b).withColumn("side", F.lit("missing")).unionByName(b.exceptAll(a).withColumn("side", F.lit("unexpected")))


@query(r"SELECT CAST(count(*) AS BIGINT) AS shared FROM (SELECT doc_id FROM documents WHERE doc_id % 5 = 0 INTERSECT SELECT doc_id FROM documents WHERE doc_id % 5 = 1)")
def o4_disjoint_windows(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id")
    return d.where("doc_id % 5 = 0").intersect(d.where("doc_id % 5 = 1")).agg(F.count("*").alias("shared"))


@query(r"SELECT doc_id FROM documents WHERE doc_id % 3 = 0 UNION SELECT doc_id FROM labels WHERE quality = 0")
def o1_o3_unions(spark, sf_dir):
    return table(spark, sf_dir, "documents").where("doc_id % 3 = 0").select("doc_id").unionByName(table(spark, sf_dir, "labels").where("quality = 0").select("doc_id")).distinct()


@query(r"""WITH d AS (SELECT doc_id, n_chars, text, sha256(CASE WHEN doc_id % 11 = 0 THEN text || '!' ELSE text END) AS content_sha256 FROM documents) SELECT doc_id, sha256(text) = content_sha256 AND length(text) = n_chars AS sound FROM d""")
def s8_verified_scan(spark, sf_dir):
    """A projected scan whose texts are held against digests written beside them; those of every eleventh document are of another text."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "n_chars")
    told = docs.select("doc_id", "text", "n_chars", H.sha256(F.when(F.col("doc_id") % 11 == 0, F.concat("text", F.lit("!"))).otherwise(F.col("text"))).alias("content_sha256"))
    return told.select("doc_id", ((H.sha256(F.col("text")) == F.col("content_sha256")) & (F.length("text") == F.col("n_chars"))).alias("sound"))


@query(r"""SELECT d.doc_id, d.text AS text FROM documents d WHERE d.doc_id IN (SELECT doc_id FROM labels WHERE quality = 1)""")
def j13_late_materialization(spark, sf_dir):
    """The plan is made on keys; texts are joined last."""
    chosen = table(spark, sf_dir, "labels").where("quality = 1").select("doc_id").distinct()
    return table(spark, sf_dir, "documents").join(chosen, "doc_id", "left_semi").select("doc_id", "text")
