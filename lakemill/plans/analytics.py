"""Accounting, gates, percentiles, sampling statistics, and the event stream's tables."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..operators import analytics as A
from .registry import query, table


@query("SELECT user_id, count(*) AS events, max(ts) AS last_event, arg_max(event_type, struct_pack(a := ts, b := event_id)) AS latest FROM events GROUP BY user_id")
def a26_activity_upsert(spark, sf_dir):
    return A.activity(table(spark, sf_dir, "events"), "user_id")


@query("WITH a AS (SELECT user_id, count(*) AS events FROM events GROUP BY user_id) SELECT user_id, events FROM a ORDER BY events DESC, user_id LIMIT 25")
def l21_most_active(spark, sf_dir):
    """A top-k report: 25 users."""
    return table(spark, sf_dir, "events").groupBy("user_id").agg(F.count("*").alias("events")).orderBy(F.desc("events"), "user_id").limit(25)


@query("WITH i AS (SELECT user_id, event_id, event_type = 'error' AS rejected, ts FROM events) SELECT user_id, bool_or(rejected) AS rejected, coalesce(arg_min(event_id, struct_pack(a := ts, b := event_id)) FILTER (rejected), arg_min(event_id, struct_pack(a := ts, b := event_id))) AS evidence FROM i GROUP BY user_id")
def a27_f18_identity_merge(spark, sf_dir):
    """Rejected evidence beats clean; of one class the first observed."""
    bad = F.col("event_type") == "error"
    order = F.struct("ts", "event_id")
    return table(spark, sf_dir, "events").groupBy("user_id").agg(F.bool_or(bad).alias("rejected"), F.coalesce(F.min_by(F.when(bad, F.col("event_id")), F.when(bad, order)), F.min_by("event_id", order)).alias("evidence"))


@query("SELECT l_returnflag, l_linestatus, quantile_cont(l_extendedprice, 0.5) AS median, quantile_cont(l_extendedprice, 0.95) AS p95, round(stddev_samp(l_discount), 9) AS spread FROM lineitem GROUP BY ALL")
def a39_a41_percentiles(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").groupBy("l_returnflag", "l_linestatus").agg(F.percentile("l_extendedprice", F.lit(0.5)).alias("median"), F.percentile("l_extendedprice", F.lit(0.95)).alias("p95"), F.round(F.stddev_samp("l_discount"), 9).alias("spread"))


@query("SELECT l_shipdate < TIMESTAMP '1995-01-01' AS early, round(corr(l_quantity, l_extendedprice), 9) AS pearson, count(*) AS n FROM lineitem GROUP BY ALL")
def a40_pearson(spark, sf_dir):
    """By sufficient statistics, which add up across tasks."""
    return A.pearson(table(spark, sf_dir, "lineitem").withColumn("early", F.col("l_shipdate") < F.lit("1995-01-01").cast("timestamp")), ["early"], "l_quantity", "l_extendedprice")


@query("SELECT CAST(least(9, floor(l_discount * 100)) AS BIGINT) AS x, CAST(least(9, floor(l_tax * 100)) AS BIGINT) AS y, count(*) AS n FROM lineitem GROUP BY ALL")
def a40_joint_histogram(spark, sf_dir):
    bin_ = lambda c: F.least(F.lit(9), F.floor(F.col(c) * 100)).cast("bigint")
    return table(spark, sf_dir, "lineitem").groupBy(bin_("l_discount").alias("x"), bin_("l_tax").alias("y")).agg(F.count("*").alias("n"))


@query("WITH s AS (SELECT o_custkey, list_distinct(list(o_orderpriority)) AS a, list_distinct(list(o_orderstatus || '-' || left(o_orderpriority, 1))) AS b FROM orders GROUP BY o_custkey) SELECT x.o_custkey, round(len(list_intersect(x.a, y.a)) / len(list_distinct(x.a || y.a)), 9) AS jaccard FROM s x JOIN s y ON y.o_custkey = x.o_custkey + 1")
def a40_jaccard(spark, sf_dir):
    sets = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.collect_set("o_orderpriority").alias("a"))
    other = sets.select((F.col("o_custkey") - 1).alias("o_custkey"), F.col("a").alias("b"))
    return sets.join(other, "o_custkey").select("o_custkey", F.round(F.size(F.array_intersect("a", "b")) / F.size(F.array_union("a", "b")), 9).alias("jaccard"))


@query("WITH r AS (SELECT o_custkey AS task, o_orderkey % 4 = 0 AS correct, o_totalprice AS thinking FROM orders) SELECT task, count(*) AS k, round(avg(CASE WHEN correct THEN 1.0 ELSE 0 END), 9) AS pass_rate, round(avg(thinking) FILTER (correct), 4) AS thinking_when_correct, avg(CASE WHEN correct THEN 1.0 ELSE 0 END) > 0.1 AND avg(CASE WHEN correct THEN 1.0 ELSE 0 END) < 0.9 AS useful FROM r GROUP BY task")
def a36_a37_f20_pass_rates(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("task"), (F.col("o_orderkey") % 4 == 0).alias("correct"), F.col("o_totalprice").alias("thinking"))
    return A.pass_rates(rows)


@query("""WITH m AS (SELECT l_returnflag AS suite, avg(l_discount) AS value, avg(l_tax) AS baseline FROM lineitem GROUP BY ALL), r(kind, bound) AS (VALUES ('minimum', 0.04), ('maximum', 0.06), ('no_regression', 0.02), ('improve', 0.0))
SELECT suite, kind, CASE kind WHEN 'minimum' THEN value >= bound WHEN 'maximum' THEN value <= bound WHEN 'no_regression' THEN value >= baseline - bound ELSE value > baseline + bound END AS passed FROM m, r""")
def a38_metric_gates(spark, sf_dir):
    metrics = table(spark, sf_dir, "lineitem").groupBy(F.col("l_returnflag").alias("suite")).agg(F.avg("l_discount").alias("value"), F.avg("l_tax").alias("baseline"))
    return A.gates(metrics, [("minimum", 0.04), ("maximum", 0.06), ("no_regression", 0.02), ("improve", 0.0)]).select("suite", "kind", "passed")


@query("WITH s AS (SELECT n_name AS task, round(avg(c_acctbal), 4) AS score FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY n_name) SELECT n_name AS task, round(score * 100, 2) AS score, score IS NOT NULL AS covered FROM nation LEFT JOIN s ON n_name = task")
def a42_benchmark_table(spark, sf_dir):
    nation = table(spark, sf_dir, "nation")
    scores = table(spark, sf_dir, "customer").groupBy(F.col("c_nationkey").alias("n_nationkey")).agg(F.round(F.avg("c_acctbal"), 4).alias("s"))
    return nation.join(scores, "n_nationkey", "left").select(F.col("n_name").alias("task"), F.round(F.col("s") * 100, 2).alias("score"), F.col("s").isNotNull().alias("covered"))


@query("SELECT event_type, count(*) AS total, count(*) FILTER (value > 50) AS rejected, count(*) FILTER (value <= 50 AND user_id % 2 = 0) AS quarantined, count(*) FILTER (value <= 50 AND user_id % 2 <> 0) AS accepted FROM events GROUP BY event_type")
def a32_a33_a53_funnel(spark, sf_dir):
    """Branches add up to the input."""
    return A.funnel(table(spark, sf_dir, "events"), ["event_type"], {"rejected": F.col("value") > 50, "quarantined": F.col("user_id") % 2 == 0})


@query("SELECT DISTINCT l_orderkey AS repo, l_partkey AS path FROM lineitem")
def a43_request_dedup(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("repo"), F.col("l_partkey").alias("path")).distinct()


@query("SELECT l_orderkey AS repo, count(*) AS requests, sha256(string_agg(l_linenumber || ':' || l_partkey, ',' ORDER BY l_linenumber, l_partkey)) AS signature FROM lineitem GROUP BY l_orderkey")
def a44_request_signature(spark, sf_dir):
    line = F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey")))
    shown = F.array_join(F.transform(line, lambda x: F.concat(x["l_linenumber"].cast("string"), F.lit(":"), x["l_partkey"].cast("string"))), ",")
    return table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("repo")).agg(F.count("*").alias("requests"), F.sha2(shown.cast("binary"), 256).alias("signature"))


@query("SELECT o_orderkey, CAST(floor(coalesce(sum(CAST(floor(o_totalprice) AS BIGINT)) OVER (PARTITION BY o_custkey ORDER BY o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) / 500000) AS BIGINT) AS batch FROM orders")
def a46_batch_cut(spark, sf_dir):
    w = Window.partitionBy("o_custkey").orderBy("o_orderkey").rowsBetween(Window.unboundedPreceding, -1)
    return table(spark, sf_dir, "orders").select("o_orderkey", F.floor(F.coalesce(F.sum(F.floor("o_totalprice")).over(w), F.lit(0)) / 500000).alias("batch"))


@query("SELECT c_mktsegment AS source, CAST(ceil(sum(CAST(floor(c_acctbal) AS BIGINT)) * 1.5 + 1000) AS BIGINT) AS candidate_tokens, CAST(ceil((sum(CAST(floor(c_acctbal) AS BIGINT)) * 1.5 + 1000) * 4.1) AS BIGINT) AS candidate_bytes FROM customer GROUP BY c_mktsegment")
def a48_candidate_plan(spark, sf_dir):
    """Decimal arithmetic: tokens times a multiplier plus a reserve, times bytes a token."""
    tokens = F.sum(F.floor("c_acctbal")).cast("decimal(28,0)") * F.lit("1.5").cast("decimal(3,1)") + F.lit("1000").cast("decimal(6,0)")
    return table(spark, sf_dir, "customer").groupBy(F.col("c_mktsegment").alias("source")).agg(tokens.alias("t")).select("source", F.ceil("t").cast("bigint").alias("candidate_tokens"), F.ceil(F.col("t") * F.lit("4.1").cast("decimal(3,1)")).cast("bigint").alias("candidate_bytes"))


@query("WITH need AS (SELECT n_regionkey AS lane, count(*) * 70 AS demand FROM nation WHERE n_regionkey <> 4 GROUP BY ALL), have AS (SELECT n_regionkey AS lane, count(*) AS capacity FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE n_regionkey <> 0 GROUP BY ALL) SELECT coalesce(need.lane, have.lane) AS lane, coalesce(demand, 0) AS demand, coalesce(capacity, 0) AS capacity, coalesce(capacity, 0) >= coalesce(demand, 0) AS covered FROM need FULL OUTER JOIN have ON need.lane = have.lane")
def a54_c10_routing_coverage(spark, sf_dir):
    nation = table(spark, sf_dir, "nation").select("n_nationkey", F.col("n_regionkey").alias("lane"))
    need = nation.where("lane <> 4").groupBy("lane").agg((F.count("*") * 70).alias("demand"))
    have = table(spark, sf_dir, "customer").join(nation, F.col("c_nationkey") == F.col("n_nationkey")).where("lane <> 0").groupBy("lane").agg(F.count("*").alias("capacity"))
    return A.coverage(need, have, "lane", "demand", "capacity")


@query("SELECT r_name AS config, split, r_name || '/' || split AS job FROM region, (SELECT unnest(['train', 'validation', 'test']) AS split)")
def a55_a52_job_expansion(spark, sf_dir):
    return table(spark, sf_dir, "region").select(F.col("r_name").alias("config"), F.explode(F.array(*map(F.lit, ["train", "validation", "test"]))).alias("split")).withColumn("job", F.concat_ws("/", "config", "split"))


@query("SELECT p_partkey, regexp_matches(p_type, '^(STANDARD|PROMO).*BRASS$') AS allowed FROM part")
def a52_globs(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", A.glob(F.col("p_type"), ["STANDARD*BRASS", "PROMO*BRASS"]).alias("allowed"))


@query("SELECT source, total, phase_a + phase_b = total AS sound, CAST(coalesce(sum(total) OVER (ORDER BY source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start FROM (SELECT l_returnflag AS source, CAST(count(*) AS BIGINT) AS total, count(*) FILTER (l_linenumber <= 3) AS phase_a, count(*) FILTER (l_linenumber > 3) AS phase_b FROM lineitem GROUP BY ALL)")
def a49_a50_manifest_checks(spark, sf_dir):
    """Phases add up and starts follow each other; the window sees one row a source."""
    sums = table(spark, sf_dir, "lineitem").groupBy(F.col("l_returnflag").alias("source")).agg(F.count("*").alias("total"), F.count(F.when(F.col("l_linenumber") <= 3, 1)).alias("phase_a"), F.count(F.when(F.col("l_linenumber") > 3, 1)).alias("phase_b"))
    w = Window.orderBy("source").rowsBetween(Window.unboundedPreceding, -1)
    return sums.select("source", "total", (F.col("phase_a") + F.col("phase_b") == F.col("total")).alias("sound"), F.coalesce(F.sum("total").over(w), F.lit(0)).alias("start"))


@query("SELECT unnest(generate_series(TIMESTAMP '2024-01-01', TIMESTAMP '2024-01-03 23:00:00', INTERVAL 1 HOUR)) AS hour")
def s12_archive_hours(spark, sf_dir):
    return spark.range(1).select(F.explode(F.sequence(F.lit("2024-01-01").cast("timestamp"), F.lit("2024-01-03 23:00:00").cast("timestamp"), F.expr("interval 1 hour"))).alias("hour")).select(F.col("hour").cast("timestamp_ntz").alias("hour"))


@query("SELECT date_trunc('hour', ts) AS hour, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def s11_hourly_events(spark, sf_dir):
    return table(spark, sf_dir, "events").groupBy(F.date_trunc("hour", "ts").cast("timestamp_ntz").alias("hour"), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))


@query("WITH e AS (SELECT user_id, event_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) <= INTERVAL 6 HOUR THEN 0 ELSE 1 END AS new FROM events), s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS session FROM e) SELECT user_id, CAST(session AS BIGINT) AS session, min(ts) AS start, count(*) AS events FROM s GROUP BY user_id, session")
def w3_sessions(spark, sf_dir):
    """Runs of neighbours told by the row before, then numbered by a running sum."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    gap = F.unix_micros(F.col("ts").cast("timestamp")) - F.unix_micros(F.lag("ts").over(w).cast("timestamp"))
    rows = table(spark, sf_dir, "events").withColumn("new", F.when(gap <= 6 * 3600 * 10**6, 0).otherwise(1)).withColumn("session", F.sum("new").over(w))
    return rows.groupBy("user_id", "session").agg(F.min("ts").alias("start"), F.count("*").alias("events"))


@query("SELECT l_returnflag, l_linestatus, sum(l_quantity) AS sum_qty, round(sum(l_extendedprice), 2) AS sum_base_price, round(sum(l_extendedprice * (1 - l_discount)), 2) AS sum_disc_price, round(avg(l_quantity), 6) AS avg_qty, count(*) AS count_order FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY ALL")
def a28_pricing_summary(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem").where(F.col("l_shipdate") <= F.lit("1998-09-02").cast("timestamp"))
    return li.groupBy("l_returnflag", "l_linestatus").agg(F.sum("l_quantity").alias("sum_qty"), F.round(F.sum("l_extendedprice"), 2).alias("sum_base_price"), F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("sum_disc_price"), F.round(F.avg("l_quantity"), 6).alias("avg_qty"), F.count("*").alias("count_order"))


@query("SELECT n_name, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue FROM customer JOIN orders ON c_custkey = o_custkey JOIN lineitem ON l_orderkey = o_orderkey JOIN supplier ON l_suppkey = s_suppkey AND c_nationkey = s_nationkey JOIN nation ON s_nationkey = n_nationkey GROUP BY n_name")
def j10_j12_manifest_joins(spark, sf_dir):
    """Small dimensions are broadcast by their size, the large sides meet on their keys."""
    t = lambda n: table(spark, sf_dir, n)
    out = t("customer").join(t("orders"), F.col("c_custkey") == F.col("o_custkey")).join(t("lineitem"), F.col("l_orderkey") == F.col("o_orderkey")).join(t("supplier"), (F.col("l_suppkey") == F.col("s_suppkey")) & (F.col("c_nationkey") == F.col("s_nationkey"))).join(t("nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    return out.groupBy("n_name").agg(F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue"))


@query("SELECT c.c_custkey FROM customer c LEFT JOIN orders o ON c.c_custkey = o.o_custkey WHERE o.o_orderkey IS NULL")
def j11_left_join_is_null(spark, sf_dir):
    return table(spark, sf_dir, "customer").join(table(spark, sf_dir, "orders"), F.col("c_custkey") == F.col("o_custkey"), "left_anti").select("c_custkey")


@query("SELECT e.event_id, e.user_id, c.c_mktsegment AS policy FROM events e LEFT JOIN customer c ON c.c_custkey = e.user_id * 3")
def j9_policy_lookup(spark, sf_dir):
    policy = table(spark, sf_dir, "customer").select((F.col("c_custkey")).alias("k"), F.col("c_mktsegment").alias("policy"))
    return table(spark, sf_dir, "events").withColumn("k", F.col("user_id") * 3).join(policy, "k", "left").select("event_id", "user_id", "policy")


@query("WITH q AS (SELECT o_orderkey, o_custkey, o_orderdate FROM orders WHERE o_orderkey % 3 = 0), p AS (SELECT o_custkey, o_orderdate, o_orderkey FROM orders WHERE o_orderkey % 3 <> 0) SELECT q.o_orderkey, arg_max(p.o_orderkey, struct_pack(a := p.o_orderdate, b := p.o_orderkey)) AS before FROM q LEFT JOIN p ON p.o_custkey = q.o_custkey AND p.o_orderdate <= q.o_orderdate GROUP BY q.o_orderkey")
def j16_as_of(spark, sf_dir):
    """The last price at or before: both sides in one ordered window, no range join."""
    return A.as_of(table(spark, sf_dir, "orders").where("o_orderkey % 3 = 0"), table(spark, sf_dir, "orders").where("o_orderkey % 3 <> 0"), "o_custkey", "o_orderdate", "o_orderkey")


@query("SELECT o_orderkey FROM orders ORDER BY (o_orderkey % 5 = 0) DESC, o_totalprice DESC, o_orderkey LIMIT 40")
def l20_schedule_order(spark, sf_dir):
    """Resumable first, then by priority, then by id; a report of 40."""
    return table(spark, sf_dir, "orders").orderBy(F.desc(F.col("o_orderkey") % 5 == 0), F.desc("o_totalprice"), "o_orderkey").limit(40).select("o_orderkey")


@query("SELECT s_suppkey, CAST(ceil(CAST(s_suppkey * 11 AS DOUBLE) / 10) + 10 AS BIGINT) AS next_threshold, round(least(1.0, 1.10 * (s_suppkey * 100.0) / (s_suppkey * 100 + 5000)), 9) AS share FROM supplier")
def l19_thresholds(spark, sf_dir):
    k = F.col("s_suppkey")
    return table(spark, sf_dir, "supplier").select("s_suppkey", (F.ceil(k * 11 / 10) + 10).alias("next_threshold"), F.round(F.least(F.lit(1.0), 1.10 * (k * 100.0) / (k * 100 + 5000)), 9).alias("share"))


@query("WITH r AS (SELECT l_orderkey, l_linenumber, sha256(l_orderkey || '-' || l_linenumber) AS h FROM lineitem) SELECT l_orderkey, l_linenumber FROM r WHERE h < '08' ")
def l7_hash_sample(spark, sf_dir):
    h = F.sha2(F.concat_ws("-", "l_orderkey", "l_linenumber").cast("binary"), 256)
    return table(spark, sf_dir, "lineitem").where(h < "08").select("l_orderkey", "l_linenumber")


@query("SELECT source, quota, CAST(least(quota, have) AS BIGINT) AS own, CAST(greatest(quota - have, 0) AS BIGINT) AS deficit FROM (SELECT source, count(*) AS have, 55 AS quota FROM documents GROUP BY source)")
def l8_bucket_deficits(spark, sf_dir):
    have = table(spark, sf_dir, "documents").groupBy("source").agg(F.count("*").alias("have")).withColumn("quota", F.lit(55))
    return have.select("source", "quota", F.least("quota", "have").cast("bigint").alias("own"), F.greatest(F.col("quota") - F.col("have"), F.lit(0)).cast("bigint").alias("deficit"))
