"""Accounting and statistics that add up across tasks, gates and as-of lookups."""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def activity(events: DataFrame, by: str) -> DataFrame:
    """(by, events, last_event, latest): counts add, the latest known value stays."""
    return events.groupBy(by).agg(F.count("*").alias("events"), F.max("ts").alias("last_event"), F.max_by("event_type", F.struct("ts", "event_id")).alias("latest"))


def pearson(df: DataFrame, by: Sequence[str], x: str, y: str) -> DataFrame:
    a, b, n = F.col(x), F.col(y), F.count("*")
    cov = F.sum(a * b) - F.sum(a) * F.sum(b) / n
    spread = F.sqrt((F.sum(a * a) - F.sum(a) * F.sum(a) / n) * (F.sum(b * b) - F.sum(b) * F.sum(b) / n))
    return df.groupBy(*by).agg(F.round(F.try_divide(cov, spread), 9).alias("pearson"), n.alias("n"))


def pass_rates(rows: DataFrame, by: str = "task", low: float = 0.1, high: float = 0.9) -> DataFrame:
    rate = F.avg(F.col("correct").cast("double"))
    return rows.groupBy(by).agg(F.count("*").alias("k"), F.round(rate, 9).alias("pass_rate"), F.round(F.avg(F.when(F.col("correct"), F.col("thinking"))), 4).alias("thinking_when_correct"), ((rate > low) & (rate < high)).alias("useful"))


def gates(metrics: DataFrame, rules: Sequence[tuple[str, float]]) -> DataFrame:
    """Each suite's metric against each rule: minimum, maximum, no_regression (within a bound), improve (by more than it)."""
    each = metrics.withColumn("r", F.explode(F.array(*[F.struct(F.lit(k).alias("kind"), F.lit(float(b)).alias("bound")) for k, b in rules]))).select("*", "r.*").drop("r")
    v, b, base = F.col("value"), F.col("bound"), F.col("baseline")
    return each.withColumn("passed", F.when(F.col("kind") == "minimum", v >= b).when(F.col("kind") == "maximum", v <= b).when(F.col("kind") == "no_regression", v >= base - b).otherwise(v > base + b))


def funnel(df: DataFrame, by: Sequence[str], branches: Mapping[str, Column]) -> DataFrame:
    """Rows of each branch, the first that holds, and the accepted rest."""
    name = F.coalesce(*[F.when(c, F.lit(k)) for k, c in branches.items()], F.lit("accepted"))
    return df.groupBy(*by).agg(F.count("*").alias("total"), *[F.count(F.when(name == k, 1)).alias(k) for k in [*branches, "accepted"]])


def coverage(need: DataFrame, have: DataFrame, key: str, demand: str, capacity: str) -> DataFrame:
    out = need.join(have, key, "full_outer").select(key, F.coalesce(demand, F.lit(0)).alias(demand), F.coalesce(capacity, F.lit(0)).alias(capacity))
    return out.withColumn("covered", F.col(capacity) >= F.col(demand))


def glob(name: Column, patterns: Sequence[str]) -> Column:
    """True where one of the globs (* and ?) matches whole."""
    as_regex = lambda p: "".join(".*" if c == "*" else "." if c == "?" else re.escape(c) for c in p)
    return name.rlike("^(" + "|".join(map(as_regex, patterns)) + ")$")


def as_of(asked: DataFrame, known: DataFrame, by: str, at: str, value: str) -> DataFrame:
    """(value, before): for each asked row the known value with the last time at or before its own, ties to the larger value."""
    both = asked.select(by, at, value, F.lit(1).alias("_q")).unionByName(known.select(by, at, value, F.lit(0).alias("_q")))
    w = Window.partitionBy(by).orderBy(at, "_q", F.when(F.col("_q") == 0, F.col(value))).rowsBetween(Window.unboundedPreceding, -1)
    return both.withColumn("before", F.last(F.when(F.col("_q") == 0, F.col(value)), ignorenulls=True).over(w)).where("_q = 1").select(value, "before")
