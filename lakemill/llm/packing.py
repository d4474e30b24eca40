"""Best-fit packing with large-item matching.

Documents over the capacity are cut into whole pieces and a last one. Pieces over one third of the capacity are placed at most two to
a sequence by greedy matching (each largest piece takes the largest other large one that still fits); smaller pieces go, from
the longest, to the sequence with the smallest gap that holds them.

Only lengths decide, so the plan is made on counts of lengths (at most as many as the capacity, whatever the input): equal sequences
are planned together, and each piece finds its place by its rank among the pieces of its length. No group is gathered; ranks come from
windows over (length, bucket), with as many buckets as keep each small.

Cases: a null text is empty, and an empty document is one piece (its end id); repeated doc_ids are separate documents when
`key` values differ only by row; an empty table gives an empty result; equal lengths are ranked by key and piece.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .shared import slices, written
from .tokens import encoder

#: Rows to a bucket of one length, about.
BUCKET_ROWS = 50_000


def plan(counts: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int, int]]:
    """(length, first rank, number, first sequence, pieces to a sequence, offset): where the pieces of each length go."""
    out: list[tuple[int, int, int, int, int, int]] = []
    taken = dict.fromkeys(counts, 0)
    groups: dict[int, list[tuple[int, int]]] = {}  # gap -> [(first sequence, number of sequences)]
    gaps: list[int] = []
    n_seq = 0

    def keep(gap: int, first: int, number: int) -> None:
        if gap > 0 and number:
            if gap not in groups:
                groups[gap] = []
                insort(gaps, gap)
            groups[gap].append((first, number))

    def place(length: int, number: int, first: int, each: int, offset: int) -> None:
        out.append((length, taken[length], number, first, each, offset))
        taken[length] += number

    large = sorted((x for x in counts if 3 * x > capacity), reverse=True)
    left = {x: counts[x] for x in large}
    open_lengths = sorted(large)
    while open_lengths:
        a = open_lengths[-1]
        at = bisect_left(open_lengths, capacity - a + 1) - 1  # the longest that fits beside a
        b = open_lengths[at] if at >= 0 else None
        number = left[a] if b is None else left[a] // 2 if a == b else min(left[a], left[b])
        if a == b and left[a] == 1:  # alone of its length: the next shorter one
            b = open_lengths[at - 1] if at > 0 else None
            number = 1
        place(a, number * (1 + (a == b)), n_seq, 1 + (a == b), 0)
        left[a] -= number * (1 + (a == b))
        if b is not None and a != b:
            place(b, number, n_seq, 1, a)
            left[b] -= number
        keep(capacity - a - (b or 0), n_seq, number)
        n_seq += number
        open_lengths = [x for x in open_lengths if left[x]]

    for length in sorted((x for x in counts if 3 * x <= capacity), reverse=True):
        need = counts[length]
        while need:
            at = bisect_left(gaps, length)
            if at == len(gaps):
                each = capacity // length
                full, rest = divmod(need, each)
                if full:
                    place(length, full * each, n_seq, each, 0)
                    keep(capacity - each * length, n_seq, full)
                    n_seq += full
                if rest:
                    place(length, rest, n_seq, rest, 0)
                    keep(capacity - rest * length, n_seq, 1)
                    n_seq += 1
                break
            gap = gaps[at]
            first, number = groups[gap].pop()
            if not groups[gap]:
                del groups[gap]
                gaps.pop(at)
            each = gap // length
            full = min(number, need // each)
            if full:
                place(length, full * each, first, each, capacity - gap)
                keep(gap - each * length, first, full)
                need -= full * each
            if full < number:
                rest = need if full * each == 0 or need < each else 0
                if rest:
                    place(length, rest, first + full, rest, capacity - gap)
                    keep(gap - rest * length, first + full, 1)
                    need = 0
                keep(gap, first + full + bool(rest), number - full - bool(rest))
    return out


def token_pieces(documents: DataFrame, path: str, capacity: int = 2048, end_id: int = 0, key: str = "doc_id", text: str = "text", with_ids: bool = False) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32[, ids]) of every piece of every document."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens, end = encoder(path), np.array([end_id], "<u4").tobytes()
        for batch in slices(batches, 1024):
            rows: list[tuple] = []
            for k, ids in zip(batch.column(0).to_pylist(), tokens.encode(batch.column(1).to_pylist())):
                ids += end
                for piece, at in enumerate(range(0, len(ids), 4 * capacity)):
                    part = ids[at : at + 4 * capacity]
                    rows.append((k, piece, at // 4, len(part) // 4, zlib.crc32(part), part if with_ids else None))
            columns = list(zip(*rows)) or [[]] * 6
            kinds = (batch.schema.field(0).type, pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)][: 5 + with_ids], names=["doc_id", "piece", "start", "length", "ids_crc32", "ids"][: 5 + with_ids])

    return documents.select(F.col(key).alias("doc_id"), F.col(text).alias("text")).mapInArrow(cut, f"doc_id {documents.schema[key].dataType.simpleString()}, piece int, start bigint, length bigint, ids_crc32 bigint" + ", ids binary" * with_ids)


def pack(pieces: DataFrame, capacity: int = 2048, key: str = "doc_id") -> DataFrame:
    """pieces with sequence_id and offset: each gets its place, gapless from 0, in as few sequences as the method finds."""
    spark = pieces.sparkSession
    pieces = written(pieces, "pieces")
    counts = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}
    if counts and max(counts) > capacity:
        raise ValueError("a piece is longer than the capacity")
    lines = plan(counts, capacity)
    by_length: dict[int, list[tuple]] = {}
    for line in lines:
        by_length.setdefault(line[0], []).append(line[1:])
    sent = spark.sparkContext.broadcast({k: np.array(v, np.int64) for k, v in by_length.items()})
    buckets = max(16, -(-max(counts.values(), default=0) // BUCKET_ROWS))
    dealt = pieces.withColumn("_bucket", F.pmod(F.xxhash64(key, "piece"), F.lit(buckets)))
    ranked = dealt.withColumn("_rank", F.row_number().over(Window.partitionBy("length", "_bucket").orderBy(key, "piece")) - 1)
    sizes = dealt.groupBy("length", "_bucket").agg(F.count("*").alias("n"))
    base = sizes.select("length", "_bucket", F.coalesce(F.sum("n").over(Window.partitionBy("length").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_base"))
    placed = ranked.join(base, ["length", "_bucket"]).withColumn("_rank", (F.col("_rank") + F.col("_base")).cast("bigint")).drop("_bucket", "_base")

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        where = sent.value
        for batch in batches:
            length, rank = batch.column("length").to_numpy(), batch.column("_rank").to_numpy()
            sequence, offset = np.zeros(len(length), np.int64), np.zeros(len(length), np.int64)
            order = np.argsort(length, kind="stable")
            for own in np.split(order, np.flatnonzero(np.diff(length[order])) + 1) if len(order) else []:
                n = int(length[own[0]])
                rows = where[n]
                line = rows[np.searchsorted(rows[:, 0], rank[own], "right") - 1]
                at = rank[own] - line[:, 0]
                sequence[own] = line[:, 2] + at // line[:, 3]
                offset[own] = line[:, 4] + at % line[:, 3] * n
            rest = batch.drop_columns(["_rank"])
            yield pa.RecordBatch.from_arrays([*rest.columns, pa.array(sequence), pa.array(offset)], names=[*rest.schema.names, "sequence_id", "offset"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in placed.schema if f.name != "_rank")
    return placed.mapInArrow(find, f"{fields}, sequence_id bigint, offset bigint").select(*pieces.columns, "sequence_id", "offset")


def best_fit_packing(documents: DataFrame, path: str, capacity: int = 2048, end_id: int = 0) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, sequence_id, offset)."""
    return pack(token_pieces(documents, path, capacity, end_id), capacity)
