"""Exact top-k inner products by ball-tree branch and bound.

Vectors are dealt into lanes by a hash, and a lane into shards, each with a ball tree. A block of queries meets a lane: nodes are visited from the largest upper
bound <q, centre> + |q| radius, and a query skips a node that cannot reach its current kth score. That score is shared by all shards of a lane and,
from the first lane, by all others: the first lane is searched alone, its kth scores go out with the queries, and later lanes return only what reaches them.
Sizes of blocks, lanes and shards are bounded, so no task holds more than a lane and a block; the few winners meet in a window per query.

Cases: vectors that are null, or hold null or non-finite components (scaled ones too), or whose id is null take no part; only vectors of equal
length are compared; each row is a vector of its own, so rows that share an id are each other's candidates, and a query row is not its own; ties go
to the smaller id; fewer than k candidates give fewer rows; an empty table gives none. Scores are exact whole numbers: of floats while products stay
below 2^53, of Python's whole numbers beyond, and scores past the ends of a long are those ends.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .shared import written

LANE, SHARD, LEAF, QUERIES = 8192, 2048, 128, 4096
#: Score of no candidate; scores are above it.
NONE = np.iinfo(np.int64).min


def tree(x: np.ndarray, rows: np.ndarray) -> tuple:
    """(centre, radius, rows, children)"""
    own = x[rows]
    centre = own.mean(axis=0) if own.shape[1] else np.zeros(0)
    far = np.sqrt(((own - centre) ** 2).sum(axis=1))
    radius = float(far.max(initial=0.0)) * (1 + 1e-9) + 1e-6
    if len(rows) <= LEAF or not far.max(initial=0.0):
        return centre, radius, rows, ()
    a = own[far.argmax()]
    b = own[((own - a) ** 2).sum(axis=1).argmax()]
    side = own @ (b - a)
    order = np.argsort(side, kind="stable")
    half = len(rows) // 2
    return centre, radius, rows, (tree(x, rows[order[:half]]), tree(x, rows[order[half:]]))


class Best:
    """The k best (score, id, row) of each query so far; `least` is a score known to be reached by k others."""

    def __init__(self, n: int, k: int, least: np.ndarray | None = None):
        self.score, self.id, self.row = np.full((n, k), NONE), np.full((n, k), np.iinfo(np.int64).max), np.full((n, k), -1)
        self.least = np.full(n, NONE) if least is None else least

    def kth(self, queries: np.ndarray) -> np.ndarray:
        return np.maximum(self.score[queries, -1], self.least[queries])

    def add(self, queries: np.ndarray, scores: np.ndarray, ids: np.ndarray, rows: np.ndarray) -> None:
        k = self.score.shape[1]
        s = np.concatenate([self.score[queries], scores], axis=1)
        i, r = (np.concatenate([old[queries], np.broadcast_to(new, scores.shape)], axis=1) for old, new in ((self.id, ids), (self.row, rows)))
        order = np.lexsort((r, i, ~s), axis=1)[:, :k]
        self.score[queries], self.id[queries], self.row[queries] = (np.take_along_axis(v, order, 1) for v in (s, i, r))


def whole_scores(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Inner products of whole numbers, within a long."""
    out = np.empty((len(q), len(x)), np.int64)
    plain = q.shape[1] * np.abs(q).max(axis=1, initial=0) * float(np.abs(x).max(initial=0)) < 2**53
    out[plain] = np.rint(q[plain] @ x.T).astype(np.int64)
    large = [[int(v) for v in row] for row in x] if not plain.all() else []
    for i in np.flatnonzero(~plain):
        row = [int(v) for v in q[i]]
        out[i] = [max(-(2**63) + 1, min(2**63 - 1, sum(a * b for a, b in zip(row, y)))) for y in large]
    return out


def visit(node: tuple, active: np.ndarray, q: np.ndarray, norm: np.ndarray, q_rows: np.ndarray, x: np.ndarray, ids: np.ndarray, x_rows: np.ndarray, best: Best) -> None:
    centre, radius, rows, children = node
    reach = np.sqrt((centre**2).sum()) + radius
    # a score below a long counts as its end, so a bound does too; one that is not a number skips nothing
    bound = np.maximum(q[active] @ centre + norm[active] * radius + 1e-9 * norm[active] * reach + 1e-6, float(NONE + 1))
    active = active[~(bound < best.kth(active))]
    if not len(active):
        return
    if not children:
        scores = whole_scores(q[active], x[rows])
        scores[q_rows[active][:, None] == x_rows[rows][None, :]] = NONE
        best.add(active, scores, ids[rows], x_rows[rows])
        return
    for child in sorted(children, key=lambda c: -float((q[active] @ c[0] + norm[active] * c[1]).mean())):
        visit(child, active, q, norm, q_rows, x, ids, x_rows, best)


def search(left: pa.Table, right: pa.Table, k: int, scale: float) -> pa.Table:
    """(q_row, query_id, row, vec_id, score) of the k best of each query, and of those only what reaches the query's `least`."""
    columns: list[np.ndarray] = [np.zeros(0, np.int64)] * 5
    if left.num_rows and right.num_rows:
        with np.errstate(over="ignore", invalid="ignore"):
            q, x = (np.floor(scale * np.stack(t["v"].to_numpy())) for t in (left, right))
            least = left["least"].fill_null(int(NONE)).to_numpy()
            q_rows, x_rows, ids = left["row"].to_numpy(), right["row"].to_numpy(), right["id"].to_numpy()
            best, norm = Best(len(q), k, least), np.sqrt((q**2).sum(axis=1)) * (1 + 1e-9)
            for at in range(0, len(x), SHARD):
                visit(tree(x, np.arange(at, min(at + SHARD, len(x)))), np.arange(len(q)), q, norm, q_rows, x, ids, x_rows, best)
        i, j = np.nonzero((best.score > NONE) & (best.score >= least[:, None]))
        columns = [q_rows[i], left["id"].to_numpy()[i], best.row[i, j], best.id[i, j], best.score[i, j]]
    return pa.table(dict(zip(("q_row", "query_id", "row", "vec_id", "score"), map(pa.array, columns))))


def top_k(vectors: DataFrame, is_query: Column, k: int = 5, scale: float = 256.0, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score) of the k largest inner products of the vectors, each component as floor(scale * x)."""
    v = F.col(vector).cast("array<double>")
    sound = F.col(vector).isNotNull() & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x * scale) != float("inf")))
    rows = vectors.where(F.col(key).isNotNull() & sound).select(F.col(key).cast("bigint").alias("id"), v.alias("v"), F.coalesce(is_query, F.lit(False)).alias("asks"), F.size(vector).alias("dim"))
    # rows get their numbers once, in a written table, so that retries agree
    rows = written(rows.withColumn("row", F.monotonically_increasing_id()), "vectors")
    n, n_q = rows.agg(F.count("*"), F.count(F.when(F.col("asks"), 1))).first()
    lanes, blocks = max(1, -(-n // LANE)), max(1, -(-n_q // QUERIES))
    # aliases, so that the two sides of a cogroup are told apart
    dealt = rows.select(*[F.col(c).alias(c) for c in ("id", "row", "v", "dim")], F.pmod(F.xxhash64("row"), F.lit(lanes)).cast("int").alias("lane"))
    candidates = dealt.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    asked = rows.where("asks").select(*[F.col(c).alias(c) for c in ("id", "row", "v", "dim")], F.pmod(F.xxhash64("row", F.lit(1)), F.lit(blocks)).cast("int").alias("block"))
    on = ["dim", "block", "lane"]

    def met(queries: DataFrame, others: DataFrame) -> DataFrame:
        return queries.groupBy(*on).cogroup(others.groupBy(*on)).applyInArrow(lambda a, b: search(a, b, k, scale), "q_row bigint, query_id bigint, row bigint, vec_id bigint, score bigint")

    found = met(asked.select("*", F.lit(0).alias("lane"), F.lit(None).cast("bigint").alias("least")), candidates.where("lane = 0"))
    if lanes > 1:
        found = written(found, "first-lane")
        kth = found.groupBy("q_row").agg(F.count("*").alias("n"), F.min("score").alias("least")).where(F.col("n") == k).select("q_row", "least")
        seeded = asked.join(kth.hint("merge"), F.col("row") == F.col("q_row"), "left").select("id", "row", "v", "dim", "block", "least")
        others = seeded.withColumn("lane", F.explode(F.sequence(F.lit(1), F.lit(lanes - 1))))
        found = found.unionByName(met(others, candidates.where("lane > 0")))
    best = Window.partitionBy("q_row").orderBy(F.desc("score"), "vec_id", "row")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
