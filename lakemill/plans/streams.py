"""Windows over events, incremental winners, and files written and read back."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import functions as F

from ..functions import hashing as H
from ..sources import readers, sinks
from ..streaming import journal as J
from .corpus import keyed
from .registry import query, table


def _scratch(spark) -> str:
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="lakemill-")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/lakemill/{uuid.uuid4().hex}"


def _events(spark, sf_dir):
    return table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))


@query("SELECT time_bucket(INTERVAL 1 HOUR, ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def r_tumbling_windows(spark, sf_dir):
    return J.tumbling(_events(spark, sf_dir)).select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "n", F.round("total", 4).alias("total"))


@query("WITH s AS (SELECT time_bucket(INTERVAL 1 HOUR, ts) - i * INTERVAL 1 HOUR AS start FROM events, (SELECT unnest(range(0, 3)) AS i)) SELECT start, count(*) AS n FROM s GROUP BY start")
def r_sliding_windows(spark, sf_dir):
    return J.sliding(_events(spark, sf_dir), "3 hours", "1 hour").select(F.col("start").cast("timestamp_ntz").alias("start"), "n")


@query("WITH e AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 8 HOUR THEN 0 ELSE 1 END AS new FROM events), s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts) AS s FROM e) SELECT user_id, min(ts) AS start, max(ts) + INTERVAL 8 HOUR AS \"end\", count(*) AS n FROM s GROUP BY user_id, s")
def r_session_windows(spark, sf_dir):
    return J.sessions(_events(spark, sf_dir), "8 hours").select("user_id", F.col("start").cast("timestamp_ntz").alias("start"), F.col("end").cast("timestamp_ntz").alias("end"), "n")


_CANON = r"trim(regexp_replace(lower(text), '[\s\x0b]+', ' ', 'g'))"


@query(f"WITH k AS (SELECT d.doc_id, sha256({_CANON}) AS dedup_hash, d.doc_id % 100 AS priority, CAST(coalesce(l.quality, -1) AS DOUBLE) AS quality_score FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id) SELECT dedup_hash, arg_min(doc_id, struct_pack(a := -priority, b := quality_score < 0, c := -quality_score, d := doc_id)) AS doc_id, count(*) AS occurrences FROM k GROUP BY dedup_hash")
def r3_r5_incremental_winners(spark, sf_dir):
    """Three batches, the second delivered twice: late arrivals replace winners, redeliveries count once."""
    rows = keyed(spark, sf_dir).select("dedup_hash", "doc_id", "priority", "quality_score")
    index = J.Index(spark, _scratch(spark), "dedup_hash", "doc_id", lambda: [-F.col("priority"), F.col("quality_score") < 0, -F.col("quality_score"), F.col("doc_id")])
    for i in (0, 1, 1, 2):
        index.ingest(rows.where(F.col("doc_id") % 3 == i), i)
    index.ingest(rows.where("doc_id % 3 = 1"), "again")
    return index.winners().select("dedup_hash", "doc_id", "occurrences")


@query("SELECT event_id, user_id, event_type FROM events")
def s17_s19_journal_stream(spark, sf_dir):
    """Events written as a journal, tailed as a stream into the index, read back."""
    path, target = _scratch(spark), _scratch(spark)
    body = F.to_json(F.struct("event_id", "event_type", "user_id"))
    table(spark, sf_dir, "events").select(body.alias("b")).select(F.to_json(F.struct(F.col("b").alias("body"), F.sha2(F.col("b").cast("binary"), 256).alias("event_sha256"))).alias("value")).write.text(path)
    schema = "event_id bigint, event_type string, user_id bigint"
    index = J.Index(spark, target, "event_id", "user_id", lambda: [F.col("user_id")])
    index.feed(J.tail(spark, path, schema, files=4), _scratch(spark)).awaitTermination()
    return index.winners().select("event_id", "user_id", "event_type")


@query("SELECT doc_id, source, sha256(text) AS digest FROM documents")
def s1_s4_k1_json_round_trip(spark, sf_dir):
    """Written as compressed JSON shards and read back strictly."""
    path = _scratch(spark)
    sinks.write_json_shards(table(spark, sf_dir, "documents").select("doc_id", "source", "text"), path, rows=5000)
    back = readers.read_json_lines(spark, path, "doc_id bigint, source string, text string", strict=True)
    return back.select("doc_id", "source", H.sha256(F.col("text")).alias("digest"))


@query("SELECT lang, count(*) AS rows, min(doc_id) AS first, max(doc_id) AS last FROM documents GROUP BY lang")
def k2_k6_sharded_parquet(spark, sf_dir):
    """One folder a shard, rows in order; what was written is read back."""
    path = _scratch(spark)
    sinks.write_shards(table(spark, sf_dir, "documents").select("doc_id", "lang"), path, "lang", ["doc_id"])
    return spark.read.parquet(path).groupBy("lang").agg(F.count("*").alias("rows"), F.min("doc_id").alias("first"), F.max("doc_id").alias("last"))


@query("SELECT 'accepted' AS decision, count(*) AS n FROM documents WHERE length(text) >= 400 UNION ALL SELECT 'rejected', count(*) FROM documents WHERE length(text) < 400")
def k4_k5_quarantine(spark, sf_dir):
    a, b = _scratch(spark), _scratch(spark)
    sinks.split_decisions(table(spark, sf_dir, "documents"), F.when(F.length("text") < 400, F.lit("short")), a, b)
    return spark.read.parquet(a).agg(F.lit("accepted").alias("decision"), F.count("*").alias("n")).unionByName(spark.read.parquet(b).agg(F.lit("rejected").alias("decision"), F.count("*").alias("n")))
