"""Connected components."""

from __future__ import annotations

import contextlib
import tempfile
import time
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shuffles(spark: SparkSession) -> set[str]:
    """Ids of the shuffles whose files are there."""
    return set(spark._jvm.org.apache.spark.SparkEnv.get().mapOutputTracker().shuffleStatuses().keys().mkString(",").split(",")) - {""}


def free(spark: SparkSession, before: set[str], seconds: float = 10) -> None:
    """Wait until the files of shuffles since `before` are gone, as those of a plan that is done.

    They go when the driver's collector finds that no plan holds them. The listeners' queues hold the plan by their last event, the end of its query, also once
    they have seen it; so asking the collector right after a write leaves the files until a later query. A job without tasks gives the queues other events,
    and they are waited for. Shuffles that other threads still use end the wait by its bound.
    """
    until = time.time() + seconds
    if not shuffles(spark) - before:
        return
    spark.sparkContext._jsc.emptyRDD().count()
    while shuffles(spark) - before:
        with contextlib.suppress(Py4JJavaError):  # listeners that are too far behind
            spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(int(seconds * 1000))
        spark._jvm.System.gc()
        for _ in range(10):
            if not shuffles(spark) - before or time.time() > until:
                return
            time.sleep(0.05)


def cut(df: DataFrame) -> DataFrame:
    """df as a table in the shared folder of spark.checkpoint.dir: what comes after does not depend on executors' disks, and its shuffle files go."""
    spark = df.sparkSession
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="lakemill-")
        spark.conf.set("spark.checkpoint.dir", base)
    path = f"{base.rstrip('/')}/lakemill/graph-{uuid.uuid4().hex}"
    before = shuffles(spark)
    df.write.option("compression", "zstd").parquet(path)
    free(spark, before)
    out = spark.read.schema(df.schema).parquet(path)
    out._cut_path = path
    return out


def forget(*tables: DataFrame) -> None:
    """Delete tables of cut() that no later result reads."""
    for df in tables:
        path = getattr(df, "_cut_path", None)
        if path:
            where = df.sparkSession._jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(where, True)


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, component) for each node of the edges (u, v): the smallest node it reaches.

    Labels travel along edges and each node also takes the label of its label, so rounds grow with the logarithm of a chain's length.
    """
    both = cut(edges.select("u", "v").union(edges.select("v", "u")).where("u <> v").distinct())
    labels = cut(both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("node"), F.least("u", "m").alias("label")))
    last = labels
    while True:
        near = both.join(labels.withColumnRenamed("node", "v"), "v").groupBy("u").agg(F.min("label").alias("near"))
        step = labels.join(near, labels["node"] == near["u"]).select("node", "label", F.least("label", "near").alias("new"))
        jump = step.join(step.select(F.col("node").alias("_n"), F.col("new").alias("_up")), F.col("new") == F.col("_n"), "left")
        after = cut(jump.select("node", F.least("new", F.coalesce("_up", "new")).alias("label"), F.col("label").alias("old")))
        changed = after.where("label <> old").limit(1).count()
        forget(last)
        labels, last = after.drop("old"), after
        if not changed:
            forget(both)
            return labels.withColumnRenamed("label", "component")
