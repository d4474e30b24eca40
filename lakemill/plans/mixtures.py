"""Mixture and replacement plans, target reports, context selection, token ids of conversations, and measures of training."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import mixture as M
from ..operators import select as S
from ..operators import training as G
from ..operators import web as W
from .registry import query, table
from .webchat import _FITS, _RULES, _URL, opt_out

_TOK = r"CAST(len(regexp_extract_all(text, '[\p{L}\p{N}_]+')) + 1 AS BIGINT)"


def _counted(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", "lang", "source", (T.number_of(F.col("text"), T.WORD) + 1).alias("tokens"))


# plans and what there is


@query(r"""WITH g(id, members, donors, self_reserve) AS (VALUES ('a', ['AFRICA', 'ASIA', 'NOWHERE'], ['AMERICA', 'MARS'], false), ('b', ['ASIA'], CAST([] AS VARCHAR[]), true), ('c', CAST([] AS VARCHAR[]), ['EUROPE'], false), ('d', ['EUROPE'], ['AFRICA'], false)),
s AS (SELECT r_name AS name, CASE WHEN r_regionkey % 2 = 0 THEN 'even' ELSE 'odd' END AS category, r_regionkey < 4 AS fresh, r_regionkey = 0 AS reserve FROM region), m AS (SELECT id AS grp, self_reserve, donors, unnest(members) AS name FROM g), d AS (SELECT id AS grp, unnest(donors) AS name FROM g),
k AS (SELECT m.*, category, fresh, reserve FROM m JOIN s ON m.name = s.name), fits AS (SELECT DISTINCT k.name FROM (SELECT name, category, fresh, unnest(donors) AS donor FROM k) k JOIN s o ON o.name = donor AND donor <> k.name AND o.category = k.category AND o.fresh = k.fresh)
SELECT 'unknown_member' AS error, name, grp AS "group" FROM m WHERE name NOT IN (SELECT name FROM s) UNION ALL SELECT 'repeated_member', name, max(grp) FROM m GROUP BY name HAVING count(*) > 1 UNION ALL SELECT 'unknown_donor', name, grp FROM d WHERE name NOT IN (SELECT name FROM s)
UNION ALL SELECT 'no_members', NULL, id FROM g WHERE len(members) = 0 UNION ALL SELECT 'no_donors', NULL, id FROM g WHERE len(donors) = 0 UNION ALL SELECT 'missing_reserve', name, grp FROM k WHERE self_reserve AND NOT reserve UNION ALL SELECT 'no_compatible_donor', name, grp FROM k WHERE NOT self_reserve AND name NOT IN (SELECT name FROM fits) UNION ALL SELECT 'omitted', name, NULL FROM s WHERE name NOT IN (SELECT name FROM m)""")
def a51_replacement_errors(spark, sf_dir):
    """What is wrong with a policy of groups of sources and donors."""
    rows = [("a", ["AFRICA", "ASIA", "NOWHERE"], ["AMERICA", "MARS"], False), ("b", ["ASIA"], [], True), ("c", [], ["EUROPE"], False), ("d", ["EUROPE"], ["AFRICA"], False)]
    groups = spark.createDataFrame(rows, "id string, members array<string>, donors array<string>, self_reserve boolean")
    i = F.col("r_regionkey")
    sources = table(spark, sf_dir, "region").select(F.col("r_name").alias("id"), F.when(i % 2 == 0, "even").otherwise("odd").alias("category"), (i < 4).alias("fresh"), (i == 0).alias("reserve"))
    return M.replacement_errors(groups, sources)


@query("""WITH o AS (SELECT o_orderkey, 's' || o_custkey % 7 AS source_id, o_orderkey % 3 = 0 AS wrapped, o_orderkey % 10 = 1 AS idx, o_orderkey % 4 AS m FROM orders),
top AS (SELECT source_id, CASE m WHEN 0 THEN 100 + o_orderkey % 9 WHEN 1 THEN 50 WHEN 2 THEN (1000 + o_orderkey) // 4 END AS tokens, CASE m WHEN 0 THEN 'candidate_token_estimate' WHEN 1 THEN 'estimated_tokens' ELSE 'text_bytes' END AS estimator FROM o WHERE NOT idx),
leaf AS (SELECT o.source_id, l_partkey // 4 AS tokens, 'text_bytes' AS estimator FROM o JOIN lineitem ON l_orderkey = o_orderkey WHERE NOT idx AND NOT (wrapped AND m <> 3))
SELECT source_id, estimator, count(*) AS outputs, CAST(sum(tokens) AS BIGINT) AS tokens FROM (SELECT * FROM top WHERE tokens IS NOT NULL UNION ALL SELECT * FROM leaf) GROUP BY ALL""")
def a59_candidate_estimates(spark, sf_dir):
    """Orders as receipts with files: explicit estimates, estimated tokens, bytes, none; indexes and wrapped data sets among them."""
    o, m = F.col("o_orderkey"), F.col("o_orderkey") % 4
    none = lambda kind, name: F.lit(None).cast(kind).alias(name)
    source = F.concat(F.lit("s"), (F.col("o_custkey") % 7).cast("string"))
    files = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.collect_list("l_partkey").alias("parts"))
    rows = table(spark, sf_dir, "orders").join(files, "o_orderkey", "left")
    leaf = lambda p: F.struct(none("string", "kind"), none("string", "payload_role"), source.alias("source_id"), none("bigint", "candidate_token_estimate"), none("bigint", "estimated_tokens"), p.alias("text_bytes"))
    receipts = rows.select(
        F.when(o % 3 == 0, "materialized_dataset").alias("kind"), F.when(o % 10 == 1, "metadata_index").alias("payload_role"), source.alias("source_id"), F.when(m == 0, 100 + o % 9).alias("candidate_token_estimate"),
        F.when(m <= 1, 50).cast("bigint").alias("estimated_tokens"), F.when(m <= 2, 1000 + o).alias("text_bytes"), F.transform(F.coalesce("parts", F.array().cast("array<bigint>")), leaf).alias("files"),
    )
    return M.candidate_estimates(receipts).groupBy("source_id", "estimator").agg(F.count("*").alias("outputs"), F.sum("tokens").alias("tokens"))


@query(_URL + f", o AS (SELECT DISTINCT p.page_id FROM p JOIN {_RULES} ON (p.h = rule_host OR ends_with(p.h, '.' || rule_host)) AND {_FITS}), r AS (SELECT page_id % 5 AS source, greatest(1, octet_length(encode(html)) // 4) AS n, page_id IN (SELECT page_id FROM o) AS gone FROM p) SELECT source, CAST(sum(CASE WHEN gone THEN 0 ELSE n END) AS BIGINT) AS kept_tokens, CAST(sum(CASE WHEN gone THEN n ELSE 0 END) AS BIGINT) AS removed_tokens, count(*) FILTER (gone) AS removed_records FROM r GROUP BY source")
def a60_opt_out_recount(spark, sf_dir):
    """What the final opt-out policy leaves of each source."""
    pages = table(spark, sf_dir, "pages").withColumn("source", F.col("page_id") % 5)
    return M.recount(pages, W.opt_out_reasons(pages, opt_out(spark), "page_id"), "page_id", "html", "source")


_TARGETS = f"WITH a AS (SELECT source, sum({_TOK}) AS tokens FROM documents WHERE doc_id % 3 <> 0 GROUP BY source), t AS (SELECT DISTINCT source, 'c' || ascii(right(source, 1)) % 3 AS category, CAST(1500 AS BIGINT) AS target FROM documents), e AS (SELECT t.source, category, target, CAST(coalesce(tokens, 0) AS BIGINT) AS tokens FROM t LEFT JOIN a ON t.source = a.source)"


def _targets(spark, sf_dir):
    actual = _counted(spark, sf_dir).where("doc_id % 3 <> 0").groupBy("source").agg(F.sum("tokens").alias("tokens"))
    targets = table(spark, sf_dir, "documents").select("source").distinct().select("source", F.concat(F.lit("c"), (F.ascii(F.right("source", F.lit(1))) % 3).cast("string")).alias("category"), F.lit(1500).cast("bigint").alias("target"))
    return M.target_report(targets, actual)


@query(_TARGETS + " SELECT source, category, target, tokens, tokens >= target AS target_met FROM e")
def a61_source_targets(spark, sf_dir):
    return _targets(spark, sf_dir)[0].select("source", "category", "target", "tokens", "target_met")


@query(_TARGETS + " SELECT category, CAST(sum(target) AS BIGINT) AS target, CAST(sum(tokens) AS BIGINT) AS tokens, sum(tokens) >= sum(target) AS target_met FROM e GROUP BY category")
def a61_category_targets(spark, sf_dir):
    return _targets(spark, sf_dir)[1]


@query(r"""WITH s AS (SELECT lang AS bucket, source, count(*) AS tokens, 'set' || ascii(right(source, 1)) % 4 AS dataset FROM documents GROUP BY ALL), b AS (SELECT bucket, sum(tokens) + CASE WHEN bucket = 'de' THEN 5 ELSE 0 END AS tokens, bucket <> 'fr' AS same_bucket_only FROM s GROUP BY bucket), n AS (SELECT count(*) AS n FROM documents)
SELECT 'bucket_sum' AS error, b.bucket AS name, CAST(f.found AS BIGINT) AS found, CAST(b.tokens AS BIGINT) AS wanted FROM b JOIN (SELECT bucket, sum(tokens) AS found FROM s GROUP BY bucket) f ON b.bucket = f.bucket WHERE f.found <> b.tokens UNION ALL SELECT 'target', 'all', CAST(sum(tokens) AS BIGINT), CAST(any_value(n) AS BIGINT) FROM b, n HAVING sum(tokens) <> any_value(n) UNION ALL SELECT 'fallback', bucket, 0, 1 FROM b WHERE NOT same_bucket_only
UNION ALL SELECT 'share', dataset, CAST(sum(tokens) AS BIGINT), CAST(floor(any_value(n) * CAST(0.25 AS DOUBLE)) AS BIGINT) FROM s, n GROUP BY dataset HAVING sum(tokens) > any_value(n) * (CAST(0.25 AS DOUBLE) + 1e-9)""")
def a67_plan_errors(spark, sf_dir):
    """Sums of buckets and sources against the target, fallbacks, and the largest share of a data set."""
    docs = table(spark, sf_dir, "documents")
    sources = docs.groupBy(F.col("lang").alias("bucket"), "source").agg(F.count("*").alias("tokens")).withColumn("dataset", F.concat(F.lit("set"), (F.ascii(F.right("source", F.lit(1))) % 4).cast("string")))
    buckets = sources.groupBy("bucket").agg(F.sum("tokens").alias("tokens")).withColumn("tokens", F.col("tokens") + F.when(F.col("bucket") == "de", 5).otherwise(0)).withColumn("same_bucket_only", F.col("bucket") != "fr")
    return M.plan_errors(sources, buckets, docs.count(), 0.25)


@query("WITH w(lang, share) AS (VALUES ('de', 40), ('en', 25), ('es', 20), ('fr', 15)), r AS (SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY doc_id) AS r FROM documents) SELECT doc_id, r.lang FROM r JOIN w ON r.lang = w.lang WHERE r <= share")
def a66_l6_weighted_mixture(spark, sf_dir):
    """A mixture of 100 documents, the feature being the number: planned counts by float weights, each source's first documents."""
    weights = {"de": 0.8, "en": 0.5, "es": 0.4, "fr": 0.3}
    return M.weighted_mixture(table(spark, sf_dir, "documents").select("doc_id", "lang"), weights, 100, {}, "lang", span=F.floor(F.col("doc_id") / 4096))


@query()
def a66_bucket_fallback(spark, sf_dir):
    """As many of every source as it has, of one bucket; what a source lacks comes from the others in order. Over one row a source; tested by hand."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "source")
    n = docs.count()
    names = [r["source"] for r in docs.select("source").distinct().orderBy("source").collect()]
    weights = {s: 5.0 if i == 0 else 1.0 for i, s in enumerate(names)}
    return M.weighted_mixture(docs, weights, n // 2, dict.fromkeys(names, "all"), span=F.floor(F.col("doc_id") / 4096))


@query("SELECT source, count(*) AS n FROM (SELECT source FROM documents ORDER BY doc_id LIMIT 300) GROUP BY source")
def a68_first_sample(spark, sf_dir):
    """The first 300 documents, the feature being the sample, counted by source."""
    return table(spark, sf_dir, "documents").select("doc_id", "source").orderBy("doc_id").limit(300).groupBy("source").agg(F.count("*").alias("n"))


# context selection

_CTX = f"WITH d AS (SELECT doc_id, source, {_TOK} AS tokens, doc_id % 6 AS score FROM documents), q AS (SELECT source, sum(tokens) // 8 AS ql, sum(tokens) // 5 AS qs FROM d GROUP BY source), a AS (SELECT d.*, ql, qs, tokens >= 200 AND score >= 2 AS long FROM d JOIN q ON d.source = q.source), b AS (SELECT *, sum(CASE WHEN long THEN tokens ELSE 0 END) OVER w AS e FROM a WINDOW w AS (PARTITION BY source ORDER BY doc_id)), c AS (SELECT *, CASE WHEN long THEN greatest(0, least(e, ql) - least(e - tokens, ql)) ELSE 0 END AS l FROM b), f AS (SELECT *, sum(tokens - l) OVER w AS g FROM c WINDOW w AS (PARTITION BY source ORDER BY doc_id)), h AS (SELECT *, greatest(0, least(g, qs) - least(g - (tokens - l), qs)) AS s FROM f), i AS (SELECT *, long AND tokens - l - s >= 64 AS ok FROM h), k AS (SELECT *, sum(CASE WHEN ok THEN 1 ELSE 0 END) OVER (PARTITION BY source ORDER BY doc_id) AS r FROM i), x AS (SELECT doc_id, source, 'long' AS lane, 0 AS token_start, l AS token_count FROM k UNION ALL SELECT doc_id, source, 'short', l, s FROM k UNION ALL SELECT doc_id, source, 'evaluation', l + s, CASE WHEN ok AND r <= 2 THEN 64 ELSE 0 END FROM k)"


def _selected(spark, sf_dir):
    docs = _counted(spark, sf_dir).withColumn("score", F.col("doc_id") % 6)
    total = docs.groupBy("source").agg(F.sum("tokens").alias("t"))
    quotas = total.select("source", F.explode(F.array(F.struct(F.lit("long").alias("lane"), F.floor(F.col("t") / 8).alias("tokens")), F.struct(F.lit("short").alias("lane"), F.floor(F.col("t") / 5).alias("tokens")))).alias("q")).select("source", "q.*")
    return M.context_selection(docs, quotas, 200, 2, 2, 64, span=F.floor(F.col("doc_id") / 4096)), docs


@query(_CTX + " SELECT doc_id, source, lane, CAST(token_start AS BIGINT) AS token_start, CAST(token_count AS BIGINT) AS token_count FROM x WHERE token_count > 0")
def c11_context_selection(spark, sf_dir):
    """Long and short lanes filled in order of documents, and evaluation slices of what is left; no task sorts a source."""
    return _selected(spark, sf_dir)[0]


@query("SELECT unnest(['inside', 'disjoint', 'exact', 'distinct']) AS check, CAST(0 AS BIGINT) AS failures")
def c13_pack_checks(spark, sf_dir):
    """Chosen slices stay inside their documents, never overlap, and evaluation slices are whole and distinct."""
    slices, docs = _selected(spark, sf_dir)
    return M.pack_checks(slices, docs, 64)


@query(_CTX + ", y AS (SELECT source, doc_id, token_start, token_count FROM x WHERE token_count > 0 AND lane <> 'evaluation') SELECT source, doc_id, CAST(token_start AS BIGINT) AS token_start, NOT coalesce(lag(doc_id) OVER w = doc_id AND lag(token_start + token_count) OVER w = token_start, false) AS begins FROM y WINDOW w AS (PARTITION BY source ORDER BY doc_id, token_start)")
def c12_natural_chunks(spark, sf_dir):
    """Where slices of a stream begin a sequence: those that don't go on where the one before stopped."""
    slices = _selected(spark, sf_dir)[0].where("lane <> 'evaluation'")
    return M.chunk_starts(slices, "source", "doc_id").select("source", "doc_id", "token_start", "begins")


@query(r"""WITH t AS (SELECT r_regionkey AS gate, n_name AS source, CAST(1000 + n_nationkey * 37 AS BIGINT) AS tokens FROM nation JOIN region ON n_regionkey = r_regionkey), g AS (SELECT gate, sum(tokens) AS total FROM t GROUP BY gate), m(lane, w) AS (VALUES ('constructed', 20), ('natural_long', 70), ('short_replay', 10)),
a AS (SELECT gate, lane, total * w // 100 AS f, total * w % 100 AS r, total FROM g, m), la AS (SELECT gate, lane, f + CASE WHEN row_number() OVER (PARTITION BY gate ORDER BY r DESC, lane) <= total - sum(f) OVER (PARTITION BY gate) THEN 1 ELSE 0 END AS n FROM a),
b AS (SELECT la.gate, lane, source, n, CAST(n AS HUGEINT) * tokens // total AS f, CAST(n AS HUGEINT) * tokens % total AS r FROM la JOIN t ON la.gate = t.gate JOIN g ON la.gate = g.gate)
SELECT gate, lane, source, CAST(f + CASE WHEN row_number() OVER (PARTITION BY gate, lane ORDER BY r DESC, source) <= n - sum(f) OVER (PARTITION BY gate, lane) THEN 1 ELSE 0 END AS BIGINT) AS tokens FROM b""")
def c10_lane_quotas(spark, sf_dir):
    """Each gate's tokens in lanes, each lane's in sources, exactly; over one row a source."""
    gates = table(spark, sf_dir, "nation").select(F.col("n_regionkey").alias("gate"), F.col("n_name").alias("source"), (1000 + F.col("n_nationkey") * 37).alias("tokens"))
    return M.lane_quotas(gates, {"constructed": 20, "natural_long": 70, "short_replay": 10})


@query("WITH c AS (SELECT n_regionkey AS gate, CASE WHEN n_nationkey % 2 = 0 THEN 'x' ELSE 'y' END AS lane, sum(n_nationkey) AS capacity FROM nation GROUP BY ALL), d AS (SELECT n_regionkey AS gate, CASE WHEN n_nationkey % 2 = 0 THEN 'x' ELSE 'y' END AS lane, sum(CASE WHEN n_nationkey = 7 THEN 8 ELSE n_nationkey END) AS demand FROM nation WHERE n_nationkey <> 4 GROUP BY ALL) SELECT coalesce(c.gate, d.gate) AS gate, coalesce(c.lane, d.lane) AS lane, CAST(coalesce(capacity, 0) AS BIGINT) AS capacity, CAST(coalesce(demand, 0) AS BIGINT) AS demand FROM c FULL OUTER JOIN d ON c.gate = d.gate AND c.lane = d.lane WHERE coalesce(capacity, 0) <> coalesce(demand, 0)")
def c10_reconciled_routes(spark, sf_dir):
    """Routes of which the pack's capacity is not what the selection will put there."""
    n = F.col("n_nationkey")
    routes = table(spark, sf_dir, "nation").select(F.col("n_regionkey").alias("gate"), F.when(n % 2 == 0, "x").otherwise("y").alias("lane"), n.alias("tokens"))
    return M.reconciled(routes, routes.where("tokens <> 4").withColumn("tokens", F.when(F.col("tokens") == 7, 8).otherwise(F.col("tokens"))), ["gate", "lane"])


@query("WITH c AS (SELECT user_id AS object_id, count(*) AS n FROM events GROUP BY user_id), ok AS (SELECT object_id FROM c WHERE object_id % 4 <> 0 AND object_id % 5 <> 0) SELECT user_id AS object_id, event_id AS chunk_index FROM events WHERE user_id IN (SELECT object_id FROM ok)")
def r7_eligible_chunks(spark, sf_dir):
    """Chunks published before their object's end, some twice; objects without an end, or with another number of chunks, are not eligible."""
    chunks = table(spark, sf_dir, "events").select(F.col("user_id").alias("object_id"), F.col("event_id").alias("chunk_index"))
    ends = chunks.groupBy("object_id").agg(F.count("*").alias("chunks")).where("object_id % 4 <> 0").withColumn("chunks", F.col("chunks") + F.when(F.col("object_id") % 5 == 0, 1).otherwise(0))
    return M.eligible_chunks(chunks.unionByName(chunks.where("chunk_index % 3 = 0")), ends)


# conversations and training


def _vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


@query()
def a57_chat_ids(spark, sf_dir):
    """Conversations as ids and labels: only the assistant's tokens are learnt; by a public vocabulary, tested against the library."""
    turns = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))), lambda m: F.struct(m["role"].alias("role"), m["text"].alias("content"))).alias("messages"))
    prefixes = {"system": "System", "user": "User", "assistant": "Assistant"}
    return G.chat_ids(turns.withColumn("messages", F.filter("messages", lambda m: m["role"].isin(*prefixes))), _vocabulary(), prefixes, None, 50256, 4096)


_EDGE = f"'^[{T.BLANKS}{T.LINE_ENDS}]+|[{T.BLANKS}{T.LINE_ENDS}]+$', '', 'g'"
_STRIP = lambda x: f"regexp_replace({x}, {_EDGE})"
_TIDY = lambda x: f"regexp_replace({_STRIP(x)}, '\\n{{3,}}', chr(10) || chr(10), 'g')"
_STOCK = G.NO_THOUGHT


@query(f"""WITH f AS (SELECT conv_id, list(text ORDER BY turn)[1:2] AS m FROM conversations GROUP BY conv_id HAVING count(*) >= 2), b AS (SELECT conv_id, {_STRIP('m[1]')} AS u, {_STRIP("'<think>' || left(m[2], 25) || '</think>' || substr(m[2], 26)")} AS a FROM f WHERE {_STRIP('m[1]')} <> ''),
p AS (SELECT conv_id, {_STRIP('left(u, 500)')} AS user, {_TIDY("regexp_extract(a, '(?is)<think>(.*?)</think>', 1)")} AS t, {_TIDY("regexp_replace(a, '(?is)<think>(.*?)</think>', '', 'g')")} AS s FROM b), c AS (SELECT conv_id, user, {_STRIP('left(t, 700)')} AS t, {_STRIP('left(s, 300)')} AS s FROM p WHERE s <> '')
SELECT conv_id, user, {_STRIP(f"'Thought:' || chr(10) || CASE WHEN t = '' THEN '{_STOCK}' ELSE t END || chr(10) || chr(10) || 'Solution:' || chr(10) || s")} AS reply FROM c""")
def a58_a69_reasoning_examples(spark, sf_dir):
    """The first two turns of each conversation as an example, in sections; the second gets a think block."""
    ranked = table(spark, sf_dir, "conversations")
    second = ranked.groupBy("conv_id").agg(F.get(F.array_sort(F.collect_list("turn")), F.lit(1)).alias("second"))
    told = ranked.join(second, "conv_id", "left").withColumn("text", F.when(F.col("turn") == F.col("second"), F.concat(F.lit("<think>"), F.substring("text", 1, 25), F.lit("</think>"), F.substr("text", F.lit(26)))).otherwise(F.col("text")))
    return G.reasoning_examples(told.select("conv_id", "turn", "text"))


@query(f"WITH p AS (SELECT lang AS phase, sum({_TOK}) AS tokens FROM documents GROUP BY lang), t AS (SELECT phase, CAST(tokens AS BIGINT) AS tokens, CAST(sum(tokens) OVER (ORDER BY phase) - tokens AS BIGINT) AS start, CAST(sum(tokens) OVER () AS BIGINT) AS total FROM p), b AS (SELECT *, CAST(CAST(20000 AS HUGEINT) * tokens // total AS BIGINT) // 64 AS blocks FROM t), k AS (SELECT *, greatest(1, (tokens // 64) // blocks) AS stride, coalesce(sum(blocks) OVER (ORDER BY start ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM b WHERE blocks > 0) SELECT CAST(before + i AS BIGINT) AS step, phase, CAST(start + i * stride * 64 AS BIGINT) AS cursor FROM (SELECT *, unnest(range(0, blocks)) AS i FROM k)")
def a62_strided_blocks(spark, sf_dir):
    """A sample of 20,000 tokens in blocks of 64, the feature being the sample, spread over each phase."""
    from pyspark.sql.window import Window

    sums = _counted(spark, sf_dir).groupBy(F.col("lang").alias("phase")).agg(F.sum("tokens").alias("tokens"))
    phases = sums.withColumn("start", F.sum("tokens").over(Window.orderBy("phase")) - F.col("tokens"))
    return G.strided_blocks(phases, 20000, 64)


_LOSS = """WITH e AS (SELECT user_id AS row, event_id AS pos, user_id % 3 AS doc, event_type = 'error' OR event_id % 17 = 0 AS changed, value FROM events), r AS (SELECT unnest([0, 1]) AS repeat), l AS (SELECT e.*, repeat, value + repeat * (pos % 5) * 0.001 AS before, value * CASE WHEN changed THEN 0.9 ELSE 0.999 END AS after FROM e, r),
t AS (SELECT row, pos, doc, avg(before) - avg(after) AS gain, max(before) - min(before) + max(after) - min(after) AS spread, bool_or(changed) AS changed FROM l GROUP BY row, pos, doc), f AS (SELECT row, doc, min(pos) AS first FROM t WHERE changed GROUP BY row, doc), k AS (SELECT t.*, CASE WHEN changed THEN 'changed' WHEN t.pos > f.first THEN 'downstream' ELSE 'unaffected' END AS region FROM t LEFT JOIN f ON t.row = f.row AND t.doc = f.doc),
z AS (SELECT greatest(0.01, 3 * coalesce(max(abs(gain)), 0), 3 * coalesce(max(spread), 0)) AS noise FROM k WHERE region = 'unaffected'), a AS (SELECT * FROM k UNION ALL SELECT * REPLACE ('total' AS region) FROM k), s AS (SELECT region, repeat, sum(before) AS b, sum(after) AS c FROM l JOIN a ON l.row = a.row AND l.pos = a.pos AND l.doc = a.doc GROUP BY ALL), w AS (SELECT region, max(b) - min(b) + max(c) - min(c) AS repeat_range FROM s GROUP BY region)"""


@query(_LOSS + " SELECT a.region, count(*) AS tokens, round(sum(gain), 2) AS loss_sum_gain, round(avg(gain), 6) AS mean_loss_gain, count(*) FILTER (abs(gain) > noise) AS tokens_above, round(max(abs(gain)), 6) AS most_change, round(any_value(repeat_range), 2) AS repeat_range FROM a JOIN w ON a.region = w.region, z GROUP BY a.region")
def a63_effect_summary(spark, sf_dir):
    """Gains of changed places, of those behind them in their documents, of the rest and of all, against the noise of the unaffected."""
    e, i = table(spark, sf_dir, "events"), F.col("event_id")
    rows = e.select(F.col("user_id").alias("row"), i.alias("pos"), (F.col("user_id") % 3).alias("doc"), ((F.col("event_type") == "error") | (i % 17 == 0)).alias("changed"), "value", F.explode(F.array(F.lit(0), F.lit(1))).alias("repeat"))
    losses = rows.withColumn("before", F.col("value") + F.col("repeat") * (F.col("pos") % 5) * 0.001).withColumn("after", F.col("value") * F.when(F.col("changed"), 0.9).otherwise(0.999))
    out = G.effect_summary(losses, 0.01)
    return out.select("region", "tokens", F.round("loss_sum_gain", 2).alias("loss_sum_gain"), F.round("mean_loss_gain", 6).alias("mean_loss_gain"), "tokens_above", F.round("most_change", 6).alias("most_change"), F.round("repeat_range", 2).alias("repeat_range"))


_GROUP = "WITH r AS (SELECT o_custkey AS prompt, o_orderkey AS id, CASE WHEN o_orderkey % 4 = 0 THEN 1.0 ELSE 0.0 END AS c, CAST(floor(o_totalprice / 1000) + 1 AS DOUBLE) AS n, o_custkey % 3 = 1 AS thinks, CASE WHEN o_orderkey % 7 = 0 THEN 0.5 ELSE 1.0 END AS compliance FROM orders), g AS (SELECT *, avg(c) OVER p AS rate, sum(n * c) OVER p / greatest(sum(c) OVER p, 1) AS mean FROM r WINDOW p AS (PARTITION BY prompt)), b AS (SELECT *, rate * mean + (1 - rate) * 1000 AS budget FROM g), o AS (SELECT *, least(2.0, greatest(0.0, (abs(n - budget) / greatest(budget, 1) - CAST(0.1 AS DOUBLE)) / CAST(0.9 AS DOUBLE))) AS outside FROM b)"


def _candidates(spark, sf_dir):
    o = F.col("o_orderkey")
    return table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("prompt"), o.alias("id"), F.when(o % 4 == 0, 1.0).otherwise(0.0).alias("correct"), (F.floor(F.col("o_totalprice") / 1000) + 1).alias("length"), (F.col("o_custkey") % 3 == 1).alias("thinks"), F.when(o % 7 == 0, 0.5).otherwise(1.0).alias("compliance"), F.lit(1000.0).alias("most_length"))


@query(_GROUP + " SELECT id, round(rate, 9) AS pass_rate, round(mean, 6) AS mean_correct_length, round(CASE WHEN thinks THEN c + CASE WHEN c > 0 THEN (1 - outside) * CAST(0.05 AS DOUBLE) ELSE 0 END ELSE c END - CAST(0.2 AS DOUBLE) * (1 - compliance), 9) AS reward FROM o")
def a64_group_rewards(spark, sf_dir):
    """Pass rates and rewards of the answers to each prompt."""
    out = G.group_rewards(_candidates(spark, sf_dir), 0.2)
    return out.select("id", F.round("pass_rate", 9).alias("pass_rate"), F.round("mean_correct_length", 6).alias("mean_correct_length"), F.round("reward", 9).alias("reward"))


@query(_GROUP + " SELECT id, round(budget, 6) AS budget, round(c + CASE WHEN c > 0 THEN (1 - outside) * CAST(0.05 AS DOUBLE) ELSE 0 END, 9) AS reward FROM o")
def u21_length_reward(spark, sf_dir):
    """Right answers earn up to 0.05 more or less as they keep near a budget that grows with the task's difficulty; wrong ones earn nothing for length."""
    rows = G.group_rewards(_candidates(spark, sf_dir), 0.2)
    budget = G.length_budget(F.col("pass_rate"), F.col("mean_correct_length"), F.col("most_length"))
    return rows.select("id", F.round(budget, 6).alias("budget"), F.round(G.length_reward(F.col("correct"), F.col("length").cast("double"), budget), 9).alias("reward"))


_PREFIX = "WITH w AS (SELECT conv_id, turn, list_transform(regexp_extract_all(text, '[a-z]'), lambda x: ascii(x)) AS ids FROM conversations WHERE role = 'user'), f AS (SELECT conv_id, turn, sha256(concat_ws(chr(0), 'prompt/v1', 'prompt_input_ids', CAST(len(ids[1:turn % 3 + 1]) AS VARCHAR), array_to_string(ids[1:turn % 3 + 1], ','))) AS fingerprint FROM w)"


@query(_PREFIX + ", a AS (SELECT fingerprint, count(*) AS train_rows FROM f WHERE conv_id % 5 <> 0 GROUP BY fingerprint), b AS (SELECT fingerprint, count(*) AS eval_rows FROM f WHERE conv_id % 5 = 0 GROUP BY fingerprint) SELECT a.fingerprint, train_rows, eval_rows FROM a JOIN b ON a.fingerprint = b.fingerprint")
def a65_prompt_fingerprints(spark, sf_dir):
    """Prompts that training and evaluation share, by the fingerprint of their first ids (letters, here one to three of them)."""
    ids = F.transform(T.found(F.col("text"), "[a-z]"), lambda x: F.ascii(x))
    rows = table(spark, sf_dir, "conversations").where("role = 'user'").select("conv_id", ids.alias("ids"), (F.col("turn") % 3 + 1).cast("int").alias("n"))
    told = G.prompt_fingerprints(rows, "ids", "n")
    return G.overlap(told.where("conv_id % 5 <> 0"), told.where("conv_id % 5 = 0"))


@query("WITH i AS (SELECT l_orderkey AS queue, l_linenumber, sum(CAST(l_quantity AS BIGINT)) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS e, CAST(l_quantity AS BIGINT) AS n, l_partkey FROM lineitem), t AS (SELECT queue, max(e) AS t FROM i GROUP BY queue), q AS (SELECT queue, k, k * (t // 3) AS a, (k + 1) * (t // 3) AS b FROM t, (SELECT unnest([0, 1, 2]) AS k)) SELECT i.queue, l_linenumber, l_partkey, k, CAST(least(e, b) - greatest(e - n, a) AS BIGINT) AS taken FROM i JOIN q ON i.queue = q.queue WHERE greatest(e - n, a) < least(e, b)")
def w13_quota_cursors(spark, sf_dir):
    """Lines and three quotas of each order as two queues, emptied in order: intervals of running sums that overlap."""
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("queue"), "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", F.col("l_quantity").cast("bigint").alias("n"))
    items = S.running(lines, ["queue"], ["l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"], "n")
    third = items.groupBy("queue").agg(F.floor(F.max("end") / 3).alias("t"))
    quotas = third.select("queue", "t", F.explode(F.array(F.lit(0), F.lit(1), F.lit(2))).alias("k")).select("queue", "k", (F.col("k") * F.col("t")).alias("start"), ((F.col("k") + 1) * F.col("t")).alias("end"))
    return S.overlaps(items, quotas, ["queue"]).select("queue", "l_linenumber", "l_partkey", "k", F.col("cut_length").cast("bigint").alias("taken"))
