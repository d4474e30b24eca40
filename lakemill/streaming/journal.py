"""Incremental ingest: journals, idempotent batches, late winners, windows."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.dedup import merged

EVENT = "event_id bigint, ts timestamp, user_id bigint, event_type string, value double, props string"


def line(event: dict) -> str:
    """A journal line: canonical JSON with its own digest."""
    body = json.dumps(event, sort_keys=True, separators=(",", ":"))
    return json.dumps({"body": body, "event_sha256": hashlib.sha256(body.encode()).hexdigest()})


def sound(lines: DataFrame, schema: str) -> DataFrame:
    """Events of lines whose digest holds; a torn last line has none."""
    parsed = lines.select(F.from_json("value", "body string, event_sha256 string").alias("r"))
    return parsed.where(F.sha2(F.col("r.body").cast("binary"), 256) == F.col("r.event_sha256")).select(F.from_json("r.body", schema).alias("e")).select("e.*")


def tail(spark: SparkSession, path: str, schema: str, files: int = 100) -> DataFrame:
    """A journal folder as a stream; offsets are in the query's checkpoint, so each file is read exactly once."""
    return sound(spark.readStream.option("maxFilesPerTrigger", files).text(path), schema)


def read(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return sound(spark.read.text(path), schema)


def _content(batch: DataFrame) -> tuple:
    """Number of rows, and sums of two hashes of them: a sum tells equal rows from none, as an exclusive-or would not."""
    given = [x for c in batch.columns for x in (F.col(c).isNull(), F.col(c))]
    sums = [F.sum(F.xxhash64(F.lit(seed), *given).cast("decimal(38,0)")) for seed in (1, 2)]
    return tuple(batch.agg(F.count("*"), *sums).first())


class Index:
    """Occurrences in a table of batches: a batch that was committed is not ingested again, a redelivered occurrence counts once.

    Each batch is a folder named by its id, written whole; the view over all of them gives winners. Text is never deleted.
    """

    def __init__(self, spark: SparkSession, path: str, by: str, identity: str, order: Callable[[], Sequence[Column]]):
        self.spark, self.path, self.by, self.identity, self.order = spark, path.rstrip("/"), by, identity, order

    def _exists(self, path: str) -> bool:
        jvm = self.spark._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(p)

    def ingest(self, batch: DataFrame, batch_id: int | str) -> bool:
        """False if the batch was there already; an error if it was there with other rows."""
        target = f"{self.path}/batch={batch_id}"
        digest = _content(batch)
        if self._exists(f"{target}/_SUCCESS"):
            old = self.spark.read.schema(batch.schema).parquet(target)
            if _content(old) != digest:
                raise ValueError(f"batch {batch_id} was committed with other rows")
            return False
        batch.write.mode("overwrite").parquet(target)
        return True

    def deliveries(self) -> DataFrame:
        return self.spark.read.parquet(self.path)

    def occurrences(self) -> DataFrame:
        """Each occurrence once; of redeliveries that differ the first in the order of winners, then of all columns."""
        rows = self.deliveries().drop("batch")
        return merged(None, rows, [self.by], self.order(), [self.by, self.identity])

    def winners(self) -> DataFrame:
        rows, order = self.occurrences(), F.struct(*[o.alias(f"o{i}") for i, o in enumerate(self.order())])
        rest = [c for c in rows.columns if c != self.by]
        return rows.groupBy(self.by).agg(F.min_by(F.struct(*rest), order).alias("w"), F.count("*").alias("occurrences")).select(self.by, "w.*", "occurrences")

    def compact(self, into: str) -> "Index":
        """The same occurrences in one batch of a new index; readers of the old one are not disturbed."""
        out = Index(self.spark, into, self.by, self.identity, self.order)
        out.ingest(self.occurrences(), "compacted")
        return out

    def feed(self, stream: DataFrame, checkpoint: str):
        """Each micro-batch is a batch of the index; a replay after a failure finds it committed."""
        return stream.writeStream.foreachBatch(lambda df, i: self.ingest(df, i) and None).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def tumbling(events: DataFrame, width: str = "1 hour", late: str | None = None) -> DataFrame:
    rows = events.withWatermark("ts", late) if late else events
    return rows.groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("start"), "event_type", "n", "total")


def sliding(events: DataFrame, width: str, slide: str, late: str | None = None) -> DataFrame:
    rows = events.withWatermark("ts", late) if late else events
    return rows.groupBy(F.window("ts", width, slide).alias("w")).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), "n")


def sessions(events: DataFrame, gap: str, late: str | None = None) -> DataFrame:
    rows = events.withWatermark("ts", late) if late else events
    return rows.groupBy(F.session_window("ts", gap).alias("w"), "user_id").agg(F.count("*").alias("n")).select("user_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def deduplicated(events: DataFrame, key: str = "event_id", late: str = "1 day") -> DataFrame:
    """Redeliveries within the watermark leave the state behind it."""
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark([key])


def states(occurrences: DataFrame, stratum: str, least: int) -> DataFrame:
    """(stratum, admitted, ready): occurrences that did not fail, and whether there are enough to go on."""
    return occurrences.where("NOT failed").groupBy(stratum).agg(F.count("*").alias("admitted")).withColumn("ready", F.col("admitted") >= least)
