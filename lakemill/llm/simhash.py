"""SimHash near-duplicates by tiled exact comparison.

Fingerprints that differ in at most `radius` bits differ by at most that much in the sum, over four blocks of 16 bits, of the
differences of their bit counts. So distinct fingerprints are laid into tiles by their four bit counts, cut into blocks of about
`block` fingerprints, and only pairs of tiles within the radius are compared, whole, with numpy exclusive-or and bit counts. Each
compared pair of blocks gives a spanning forest of its links, not all of them. The nodes of that graph are fingerprints, so rows that
share a doc_id are linked by nothing but their texts.

`similar_groups` is the form for a similarity of shingle sets: links within the radius are candidates whose sets are compared, and the pairs
whose fingerprints differ in more bits are found by operators.similar, so that no similar pair is lost.

Cases: a null text, or one without words, has fingerprint zero and is linked like any other; copies share a fingerprint and meet
once; rows that share a doc_id, null or not, are judged each; a null doc_id is never a component's name unless all of the component are null; an
empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import product

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lakemill.operators.similar import groups

from .shared import components, drop, slices, written

#: Shingles whose bits are counted at once.
_AT_ONCE = 1 << 15


def fingerprint(text: str | None, size: int = 3) -> int:
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    size = min(size, len(words))
    digest = xxhash.xxh64_intdigest
    ones, n = np.zeros(64, np.int64), len(words) - size + 1
    starts, ends = starts[:n].tolist(), ends[size - 1 :].tolist()
    for at in range(0, n, _AT_ONCE):
        h = np.array([digest(joined[s:e], 42) for s, e in zip(starts[at : at + _AT_ONCE], ends[at : at + _AT_ONCE])], "<u8")
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view("<u8")[0])


def fingerprints(documents: DataFrame, size: int = 3, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, fp): fp as a signed long of the same bits."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            fp = np.array([fingerprint(t, size) for t in batch.column(1).to_pylist()], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fp)], names=["doc_id", "fp"])

    return documents.select(key, text).mapInArrow(run, f"doc_id {documents.schema[key].dataType.simpleString()}, fp bigint")


def forest(a: np.ndarray, b: np.ndarray, radius: int, same: bool) -> list[tuple[int, int]]:
    """Links of a spanning forest of the fingerprints of a and b within the radius."""
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        while (up := parent.get(x, x)) != x:
            parent[x] = parent.get(up, up)
            x = up
        return x

    out, ua, ub = [], a.view(np.uint64), b.view(np.uint64)
    for at in range(0, len(a), 256):
        i, j = np.nonzero(np.bitwise_count(ua[at : at + 256, None] ^ ub[None, :]) <= radius)
        if same:
            i, j = i[i + at < j], j[i + at < j]
        for x, y in zip(a[i + at].tolist(), b[j].tolist()):
            p, q = root(x), root(y)
            if p != q:
                parent[p] = q
                out.append((x, y))
    return out


def links(fps: DataFrame, radius: int = 2, block: int = 1024) -> DataFrame:
    """(a, b): links that connect the distinct fingerprints of column fp exactly as all links within the radius do."""
    counts: list[Column] = [F.bit_count(F.shiftrightunsigned("fp", 16 * k).bitwiseAND(F.lit(0xFFFF).cast("bigint"))) for k in range(4)]
    laid = written(fps.select("fp").distinct().select("fp", sum((c * 17**k for k, c in enumerate(counts)), F.lit(0)).cast("int").alias("tile")), "tiles")
    # at most 17 ** 4 tiles whatever the input, so their sizes may be broadcast
    tiles = F.broadcast(laid.groupBy("tile").agg(F.ceil(F.count("*") / block).cast("int").alias("blocks")))
    blocks = written(laid.join(tiles, "tile").groupBy("tile", F.pmod(F.xxhash64("fp"), F.col("blocks")).cast("int").alias("block")).agg(F.sort_array(F.collect_list("fp")).alias("fps")), "blocks")
    near = [d for d in product(range(-radius, radius + 1), repeat=4) if sum(map(abs, d)) <= radius and d >= (0, 0, 0, 0)]
    digits = [F.floor(F.col("tile") / 17**k).cast("int") % 17 for k in range(4)]
    inside = [(F.lit(True) if d == (0, 0, 0, 0) else sum((F.when((x + e >= 0) & (x + e <= 16), 0).otherwise(1) for x, e in zip(digits, d)), F.lit(0)) == 0) for d in near]
    to = F.array_compact(F.array(*[F.when(ok, F.col("tile") + sum(e * 17**k for k, e in enumerate(d))) for d, ok in zip(near, inside)]))
    sent = blocks.select("tile", "block", F.col("fps").alias("a"), F.explode(to).alias("other")).join(tiles.select(F.col("tile").alias("other"), "blocks"), "other")
    sent = sent.select("tile", "block", "a", "other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other_block")).where("tile <> other or block <= other_block")
    pairs = sent.join(blocks.select(F.col("tile").alias("other"), F.col("block").alias("other_block"), F.col("fps").alias("b")), ["other", "other_block"])
    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            found: list[tuple[int, int]] = []
            for same, a, b in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2)):
                found += forest(a.values.to_numpy(), b.values.to_numpy(), radius, same)
            yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in found], pa.int64()) for k in (0, 1)], names=["a", "b"])

    return pairs.select((F.col("tile") == F.col("other")).__and__(F.col("block") == F.col("other_block")).alias("same"), "a", "b").mapInArrow(compare, "a bigint, b bigint")


def fingerprint_components(fps: DataFrame, radius: int = 2, block: int = 1024) -> DataFrame:
    """(node, root) of the fingerprints that have links: root is one of the component's, the same for all."""
    return components(links(fps, radius, block).toDF("u", "v"))


def near_duplicates(documents: DataFrame, radius: int = 2, size: int = 3, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, fingerprint, component_id) of each row: component_id is the smallest doc_id that links reach."""
    docs = written(fingerprints(documents, size, key, text), "fingerprints")
    first = written(docs.groupBy("fp").agg(F.min("doc_id").alias("first")), "first")
    rooted = written(first.join(fingerprint_components(first, radius).hint("merge"), F.col("fp") == F.col("node"), "left").select("fp", "first", F.coalesce("root", "fp").alias("root")), "roots")
    least = rooted.groupBy("root").agg(F.min("first").alias("component_id"))
    of_fp = rooted.select("fp", "root").join(least.hint("merge"), "root").select("fp", "component_id")
    return docs.join(of_fp.hint("merge"), "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def similar_groups(documents: DataFrame, size: int = 5, num: int = 4, den: int = 5, radius: int = 2, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(ra, rb, n, kept): for each row key how many rows have it, and if it is the one that stays of its group.

    Groups join rows whose sets of shingles of `size` words have a similarity of num / den or more; the smallest key, then row key, stays.
    """

    def near(fps: DataFrame) -> DataFrame:
        """Candidate pairs (a, b) of the sets (d, fp): each with the first of its fingerprint, and first ones along the links."""
        first = written(fps.groupBy("fp").agg(F.min("d").alias("m")), "first-of-fingerprints")
        same = fps.join(first.hint("merge"), "fp").where("d <> m").select(F.col("d").alias("a"), F.col("m").alias("b"))
        linked = links(first, radius).toDF("x", "y")
        ends = first.select(F.col("fp").alias("x"), F.col("m").alias("a")).hint("merge"), first.select(F.col("fp").alias("y"), F.col("m").alias("b")).hint("merge")
        return same.unionByName(linked.join(ends[0], "x").join(ends[1], "y").select("a", "b"))

    return groups(documents, written, components, drop, size, num, den, key, text, near=near)
