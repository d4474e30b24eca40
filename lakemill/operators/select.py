"""Apportionment, quotas, sampling and interval packing."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def hamilton(weights: DataFrame, total: int, key: str, weight: str, by: Sequence[str] = ()) -> DataFrame:
    """Largest-remainder shares of total: floors, then one more for the largest remainders, ties by key. Weights are whole numbers, and so is
    all arithmetic. Few rows by nature."""
    whole = Window.partitionBy(*by)
    product = F.col(weight).cast("decimal(38,0)") * F.lit(total).cast("decimal(18,0)")
    cut = weights.withColumn("_p", product.cast("decimal(38,0)")).withColumn("_w", F.sum(F.col(weight).cast("decimal(28,0)")).over(whole).cast("decimal(38,0)"))
    cut = cut.withColumn("_f", F.expr("CAST(_p DIV _w AS BIGINT)")).withColumn("_r", F.expr("_p % _w"))
    rank = F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("_r"), key))
    return cut.withColumn("_n", rank).withColumn("_missing", total - F.sum("_f").over(whole)).withColumn("share", (F.col("_f") + F.when(F.col("_n") <= F.col("_missing"), 1).otherwise(0)).cast("bigint")).drop("_p", "_w", "_f", "_r", "_n", "_missing")


def running(df: DataFrame, by: Sequence[str], order: Sequence[Column | str], amount: str, start: str = "start", end: str = "end", span: Column | None = None) -> DataFrame:
    """Half-open intervals of a cumulative sum in a total order.

    With span, a column that never falls along the order, no task sorts a whole group: sums are taken within each span, on top
    of the sums of the spans before it, of which there is one row each.
    """
    if span is None:
        w = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
        return df.withColumn(end, F.sum(amount).over(w).cast("bigint")).withColumn(start, (F.col(end) - F.col(amount)).cast("bigint"))
    rows = df.withColumn("_span", span)
    sums = rows.groupBy(*by, "_span").agg(F.sum(amount).alias("_sum"))
    ahead = Window.partitionBy(*by).orderBy("_span").rowsBetween(Window.unboundedPreceding, -1)
    base = sums.select(*by, "_span", F.coalesce(F.sum("_sum").over(ahead), F.lit(0)).alias("_base"))
    inside = Window.partitionBy(*by, "_span").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    both = rows.withColumn("_in", F.sum(amount).over(inside)).join(base.hint("merge"), [*by, "_span"])
    return both.withColumn(end, (F.col("_base") + F.col("_in")).cast("bigint")).withColumn(start, (F.col(end) - F.col(amount)).cast("bigint")).drop("_span", "_base", "_in").select(*df.columns, end, start)


def overlaps(items: DataFrame, quotas: DataFrame, by: Sequence[str]) -> DataFrame:
    """Items cut at quota bounds: both sides have start and end; gives cut_start (inside the item) and cut_length."""
    q = quotas.withColumnRenamed("start", "_a").withColumnRenamed("end", "_b")
    out = items.join(q, list(by)).where((F.greatest("start", "_a")) < F.least("end", "_b"))
    return out.withColumn("cut_start", F.greatest("start", "_a") - F.col("start")).withColumn("cut_length", F.least("end", "_b") - F.greatest("start", "_a")).drop("_a", "_b")


def per_category(df: DataFrame, quotas: DataFrame, category: str, order: Sequence[str], capacity: int, most: int) -> DataFrame:
    """The first rows of each category up to its quota (at most `most`), then the first of the rest until the capacity is filled.

    Both come from bounded top-k lists: each task passes on `most` rows a category, and as many as can be chosen over all.
    """
    first = df.withColumn("_r", F.row_number().over(Window.partitionBy(category).orderBy(*order))).where(F.col("_r") <= most)
    chosen = first.join(F.broadcast(quotas), category).where("_r <= quota").drop("_r", "quota").withColumn("filled", F.lit(False))
    # if all own rows were among the first of all, so many more still fill the capacity
    rest = df.orderBy(*order).limit(2 * capacity).join(chosen.select(*order), list(order), "left_anti").withColumn("filled", F.lit(True))
    return chosen.unionByName(rest).orderBy("filled", *order).limit(capacity)


def until_target(df: DataFrame, by: Sequence[str], order: Sequence[Column | str], amount: str, target: int, span: Column | None = None) -> DataFrame:
    """Rows in order until the target is reached, the crossing one included; with span (see running), only the spans before it are sorted."""
    if span is None:
        w = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
        return df.withColumn("before", F.coalesce(F.sum(amount).over(w), F.lit(0)).cast("bigint")).where(F.col("before") < target)
    rows = df.withColumn("_span", span)
    ahead = Window.partitionBy(*by).orderBy("_span").rowsBetween(Window.unboundedPreceding, -1)
    base = rows.groupBy(*by, "_span").agg(F.sum(amount).alias("_sum")).select(*by, "_span", F.coalesce(F.sum("_sum").over(ahead), F.lit(0)).alias("_base")).where(F.col("_base") < target)
    inside = Window.partitionBy(*by, "_span").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    near = rows.join(base.hint("merge"), [*by, "_span"])
    return near.withColumn("before", (F.col("_base") + F.coalesce(F.sum(amount).over(inside), F.lit(0))).cast("bigint")).where(F.col("before") < target).drop("_span", "_base")


def balanced(total: Column, parts: int) -> Column:
    """total in `parts` whole numbers that differ by at most one, the larger first."""
    return F.transform(F.sequence(F.lit(0), F.lit(parts - 1)), lambda i: (F.floor(total / parts) + F.when(i < total % parts, 1).otherwise(0)).cast("bigint"))


def replace(available: dict[str, int], required: dict[str, int], donors: dict[str, list[str]]) -> list[tuple[str, str, int]]:
    """(target, donor, amount): each takes its own first; deficits are filled from its donors' surplus in order. Strict: raises if short."""
    left = {k: available.get(k, 0) for k in {*available, *required}}
    out = []
    for target in sorted(required):
        own = min(required[target], left[target])
        left[target] -= own
        out.append((target, target, own))
    for target in sorted(required):
        need = required[target] - next(n for t, d, n in out if t == d == target)
        for donor in donors.get(target, []):
            spare = min(need, max(0, left[donor]))
            if spare:
                left[donor] -= spare
                need -= spare
                out.append((target, donor, spare))
        if need:
            raise ValueError(f"{target} is short of {need}")
    return out


def greedy_whole(rows: list[tuple[str, int]], budget: int) -> list[str]:
    """Whole objects in the given order, leaving out those that don't fit. For control tables only: order decides, one after the other."""
    out = []
    for name, size in rows:
        if size <= budget:
            out.append(name)
            budget -= size
    return out
