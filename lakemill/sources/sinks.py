"""Shards, decisions and manifests. Spark's commit protocol makes every write whole or absent."""

from __future__ import annotations

import hashlib
import json
import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def write_json_shards(df: DataFrame, path: str, rows: int = 100_000, codec: str = "gzip") -> None:
    """Rolling shards of at most `rows` rows."""
    df.write.mode("error").option("maxRecordsPerFile", rows).option("compression", codec).json(path)


def write_parquet(df: DataFrame, path: str, by: str | None = None) -> DataFrame:
    """zstd Parquet; returns the manifest of what was written, read back: a row a file with rows, smallest and largest key."""
    writer = df.write.mode("error").option("compression", "zstd")
    (writer.partitionBy(by) if by else writer).parquet(path)
    return manifest(df.sparkSession.read.parquet(path), df.columns[0])


def manifest(table: DataFrame, key: str) -> DataFrame:
    return table.groupBy(F.col("_metadata.file_name").alias("file")).agg(F.count("*").alias("rows"), F.min(key).alias("first"), F.max(key).alias("last"), F.first(F.col("_metadata.file_size")).alias("bytes"))


def split_decisions(df: DataFrame, reason: Column, accepted: str, rejected: str) -> None:
    """Accepted and quarantined rows, each to its table in one pass: a folder a decision."""
    out = df.withColumn("reason", reason)
    out.where("reason IS NULL").drop("reason").write.mode("error").parquet(accepted)
    out.where("reason IS NOT NULL").write.mode("error").parquet(rejected)


def write_shards(df: DataFrame, path: str, shard: str, order: list[str]) -> None:
    """One folder a shard, rows in order."""
    df.repartition(shard).sortWithinPartitions(shard, *order).write.mode("error").partitionBy(shard).parquet(path)


def sealed(receipt: dict) -> dict:
    """The receipt with the digest of its canonical form."""
    body = json.dumps(receipt, sort_keys=True, separators=(",", ":"), allow_nan=False)
    return receipt | {"receipt_sha256": hashlib.sha256(body.encode()).hexdigest()}


def is_sealed(receipt: dict) -> bool:
    rest = {k: v for k, v in receipt.items() if k != "receipt_sha256"}
    return sealed(rest) == receipt


def contract(inputs: dict, policy: dict, version: str) -> str:
    """A stage's key: it is computed again only if inputs, policy or version changed."""
    return sealed({"inputs": inputs, "policy": policy, "version": version})["receipt_sha256"]


def write_files(rows: DataFrame, path: str, name: str, data: str) -> int:
    """Each row's bytes as a file of its own under path, written by the executors; a file is moved into place when it is whole, so a task that runs
    again leaves one copy. Returns their number."""
    import pyarrow as pa

    def run(batches):
        from pyarrow import fs

        for batch in batches:
            n = 0
            for file, body in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                store, base = fs.FileSystem.from_uri(path)
                store.create_dir(base)
                part = f"{base}/_{uuid.uuid4().hex}"
                with store.open_output_stream(part, compression=None) as out:
                    out.write(body)
                store.move(part, f"{base}/{file}")
                n += 1
            yield pa.RecordBatch.from_arrays([pa.array([n])], names=["n"])

    return rows.select(name, data).mapInArrow(run, "n bigint").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]


def append_event(spark, path: str, event: dict, most_bytes: int = 1 << 20) -> str:
    """One event as a journal file of its own, sealed by its digest and moved into place whole; larger ones are refused."""
    from ..streaming.journal import line

    text = line(event)
    if len(text.encode()) + 1 > most_bytes:
        raise ValueError("the event is too large")
    name = hashlib.sha256(text.encode()).hexdigest()
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    target, part = jvm.org.apache.hadoop.fs.Path(f"{path}/{name}.jsonl"), jvm.org.apache.hadoop.fs.Path(f"{path}/_{uuid.uuid4().hex}")
    store = target.getFileSystem(conf)
    out = store.create(part, True)
    out.write(bytearray((text + "\n").encode()))
    out.close()
    store.rename(part, target)
    return name


def write_json(spark, path: str, value: dict) -> None:
    """A sealed receipt as a file that is whole or absent."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    target, part = jvm.org.apache.hadoop.fs.Path(path), jvm.org.apache.hadoop.fs.Path(f"{path}.{uuid.uuid4().hex}")
    store = target.getFileSystem(conf)
    out = store.create(part, True)
    out.write(bytearray(json.dumps(sealed(value), sort_keys=True).encode()))
    out.close()
    store.delete(target, False)
    store.rename(part, target)


def read_json(spark, path: str) -> dict | None:
    """The receipt, or none where there is none or its seal is broken."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p):
        return None
    value = json.loads(spark.read.text(path, wholetext=True).first()[0])
    return value if is_sealed(value) else None


def stage(spark, path: str, inputs: dict, policy: dict, version: str, make) -> tuple[DataFrame, bool]:
    """The table of a stage, made again only if its inputs, policy or version changed; and whether it was."""
    key = contract(inputs, policy, version)
    receipt = read_json(spark, f"{path}/{key}.json")
    if receipt is None:
        make().write.mode("overwrite").parquet(f"{path}/{key}")
        write_json(spark, f"{path}/{key}.json", {"contract": key, "rows": spark.read.parquet(f"{path}/{key}").count()})
    return spark.read.parquet(f"{path}/{key}"), receipt is None
