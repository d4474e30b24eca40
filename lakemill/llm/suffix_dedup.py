"""Suffix-array dedup: bytes covered by a string of `length` bytes that starts anywhere else too.

The collection is sorted column by column, one symbol a document segment each round, with its Burrows-Wheeler order and common
prefixes updated from the round before. Sorting all suffixes of all documents that way takes as many rounds as the longest document has
bytes, each a pass over everything; so it is done on segments that are aligned first:

1. Anchors. In each string of `length` bytes the K-gram with the smallest hash is an anchor (winnowing). Equal strings have the same
   anchors at the same places, so any two equal strings meet at an equal anchor, in the same column.
2. Only anchors that occur twice or more go on. Around each lies its segment: all bytes that a string of `length` bytes which holds the
   anchor can reach. A segment that occurs twice, alike in all bytes and in its distance from the document's start, is covered whole.
3. For the other distinct segments of an anchor, rounds run from the last column to the first. A round puts one symbol before each
   segment's suffix: stable sorting of the previous order by that symbol is the new order, and the common prefix of neighbours is one more than the
   least common prefix between their old places. Neighbours in that order that share `length` symbols or more are equal strings.
   All segments of a round have the same column, so the order of the whole collection's suffixes falls into one small order a column,
   and the rounds number at most 2 * length. Their columns stay in memory: a block is bounded (`most` segments), so
   no external files are needed.
4. An anchor with more than `most` distinct segments (many contexts around one common passage) would fill a task, so it is split, without gathering it:
   its columns fall into bands of BAND starts. All strings that start in a band have the bytes between its last start and its first end in common, so
   segments are counted by (band, those bytes), and those alike in all bytes of the band are covered there. Only bands in which alike
   common bytes have different surroundings go on, string by string. Counts are aggregates with partial sums over 128-bit hashes; the result is the same.

All joins are sort-merge joins, because every table here grows with the corpus; none is broadcast.

Exact but for hash equality: segments are compared by 128 bits (anchor and segment hash), step 4 by 128 bits more, everything in step 3 by bytes.

Cases: a null text is empty; a text under `length` bytes loses nothing; copies in one document count, overlaps too; strings are judged on the
input. Rows are told apart by key and text, so rows that share a key, or have none, lose only bytes of their own; rows alike in both are copies
of each other. Extra columns are carried along if asked for, whatever their names; others are not read. Parts of a character left by a cut are dropped from `text` only: the digest is that of the bytes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from .shared import drop, partitions, row_key, slices, written

K = 32
#: Bytes of a text that are hashed at once.
_AT_ONCE = 1 << 20
_TABLE = np.random.default_rng(4).integers(1 << 63, size=256, dtype=np.uint64)


def _least(x: np.ndarray, width: int, pick: np.ufunc) -> np.ndarray:
    """pick over every window of width values, by doubling."""
    step, out = 1, x
    while 2 * step <= width:
        out = pick(out[:-step], out[step:])
        step *= 2
    rest = width - step
    return pick(out[:-rest], out[rest:]) if rest else out


def anchors(data: bytes, length: int) -> tuple[np.ndarray, np.ndarray]:
    """(places, hashes) of the K-grams that are the least of some string of `length` bytes."""
    width, places, hashes = length - K + 1, [], []
    for at in range(0, max(1, len(data) - length + 1), _AT_ONCE):
        b = np.frombuffer(data, np.uint8, min(len(data) - at, _AT_ONCE + length - 1), at)
        if len(b) < length:
            break
        h, step, base = _TABLE[b], 1, 0x9E3779B97F4A7C15
        while step < K:
            h = h[:-step] * np.uint64(base) + h[step:]
            step, base = 2 * step, base * base & 0xFFFFFFFFFFFFFFFF
        h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
        h ^= h >> np.uint64(29)
        low = _least(h, width, np.minimum)
        edge = np.zeros(width - 1, np.uint64)
        found = np.flatnonzero(_least(np.concatenate((edge, low, edge)), width, np.maximum) == h)
        places.append(found + at)
        hashes.append(h[found])
    if not places:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    p, first = np.unique(np.concatenate(places), return_index=True)
    return p, np.concatenate(hashes)[first]


def segment(data: bytes, place: int, length: int) -> tuple[int, bytes]:
    """(bytes before the anchor, segment)."""
    left = min(place, length - K)
    return left, data[place - left : place + length]


def covered(group: np.ndarray, columns: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """columns: a row of symbols for each segment, -1 where there is none; rows of one group are contiguous. (from, to) of the columns that
    lie in a string shared with another segment of the group; to is 0 where none does."""
    m, width = columns.shape
    start, end = np.zeros(m, np.int64), np.zeros(m, np.int64)
    order, lcp, place = np.arange(m), np.zeros(m + 1, np.int32), np.arange(m)
    group = group.astype(np.int64) * 512
    for c in range(width - 1, -1, -1):
        symbol = columns[order, c]
        key = group[order] + (symbol + 1)
        if bool((key[1:] >= key[:-1]).all()):
            same = np.flatnonzero((key[1:] == key[:-1]) & (symbol[1:] >= 0)) + 1
            new = np.zeros(m + 1, np.int32)
            new[same] = lcp[same] + 1
        else:
            moved = np.argsort(key, kind="stable")
            key, symbol = key[moved], symbol[moved]
            same = np.flatnonzero((key[1:] == key[:-1]) & (symbol[1:] >= 0)) + 1
            new = np.zeros(m + 1, np.int32)
            if len(same):
                i, j = moved[same - 1] + 1, moved[same] + 1
                new[same] = np.minimum.reduceat(lcp, np.stack((i, j), axis=1).ravel())[::2] + 1
            order = order[moved]
        lcp = new
        if c <= length - K:
            hit = lcp >= length
            hit = order[hit[:m] | hit[1:]]
            start[hit] = c
            end[hit[end[hit] == 0]] = c + length
    del place
    return start, end


def _judge(batches: Iterator[pa.RecordBatch], length: int, block: int) -> Iterator[pa.RecordBatch]:
    """Rows sorted by h come as (h, s, before, bytes); whole groups are judged together, several to a block."""
    pad, width = length - K, 2 * length - K
    rows: list[tuple] = []

    def done(rows: list[tuple]) -> pa.RecordBatch:
        columns = np.full((len(rows), width), -1, np.int16)
        for i, (_, _, before, data) in enumerate(rows):
            columns[i, pad - before : pad - before + len(data)] = np.frombuffer(data, np.uint8)
        h = np.array([r[0] for r in rows], np.int64)
        group = np.concatenate(([0], np.cumsum(h[1:] != h[:-1])))
        start, end = covered(group, columns, length)
        hit = np.flatnonzero(end)
        return pa.RecordBatch.from_arrays([pa.array(h[hit]), pa.array([rows[i][1] for i in hit], pa.int64()), pa.array((start[hit] - pad).astype(np.int32)), pa.array((end[hit] - pad).astype(np.int32))], names=["h", "s", "lo", "hi"])

    for batch in slices(batches, 2048):
        for row in zip(*(batch.column(i).to_pylist() for i in range(4))):
            if len(rows) >= block and row[0] != rows[-1][0]:
                yield done(rows)
                rows = []
            rows.append(row)
    if rows:
        yield done(rows)


#: Starts to a band.
BAND = 13


def _split(segments: DataFrame, length: int) -> DataFrame:
    """(h, s, lo, hi) of the covered bytes of segments (h, s, before, bytes) of anchors with many of them; places are relative to the anchor."""
    first = K - length
    bands = [(b, min(b + BAND - 1, 0)) for b in range(first, 1, BAND)]

    def rows(found: list[tuple], names: dict[str, pa.DataType]) -> pa.RecordBatch:
        columns = list(zip(*found)) or [[]] * len(names)
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, names.values())], names=list(names))

    def halves(data: bytes) -> tuple[int, int]:
        d = xxhash.xxh3_128_digest(data)
        return int.from_bytes(d[:8], "big", signed=True), int.from_bytes(d[8:], "big", signed=True)

    def clip(band: tuple[int, int], before: int, size: int) -> tuple[int, int]:
        return max(band[0], -before), min(band[1], size - before - length)

    long, whole = pa.int64(), pa.int32()

    def by_band(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 1024):
            out = []
            for h, s, before, data in zip(*(batch.column(i).to_pylist() for i in range(4))):
                for k, band in enumerate(bands):
                    lo, hi = clip(band, before, len(data))
                    if lo <= hi:
                        # a chance meeting of these 64 bits only sends a band on to the strings
                        common = xxhash.xxh3_64_intdigest(data[band[1] + before : band[0] + before + length]) - (1 << 63)
                        out.append((h, s, k, common, *halves(data[lo + before : hi + before + length]), lo, hi + length))
            yield rows(out, {"h": long, "s": long, "k": whole, "c": long, "na": long, "nb": long, "lo": whole, "hi": whole})

    each = written(segments.mapInArrow(by_band, "h bigint, s bigint, k int, c bigint, na bigint, nb bigint, lo int, hi int"), "bands")
    common, own = ["h", "k", "c"], ["h", "k", "c", "lo", "hi", "na", "nb"]
    kinds = written(each.groupBy(*own).agg(F.count("*").alias("n"), F.min("s").alias("s")), "kinds")
    alike = each.join(kinds.where("n > 1").select(*own).hint("merge"), own, "left_semi").select("h", "s", "lo", "hi")
    mixed = kinds.groupBy(*common).agg(F.count("*").alias("m")).where("m > 1").select(*common)
    # one segment of each kind stands for it
    asked = kinds.join(mixed.hint("merge"), common, "left_semi").groupBy("h", "s").agg(F.collect_list("k").alias("ks"))

    def by_string(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 1024):
            out = []
            for h, s, before, data, ks in zip(*(batch.column(i).to_pylist() for i in range(5))):
                for k in ks:
                    lo, hi = clip(bands[k], before, len(data))
                    out += [(h, s, at, *halves(data[at + before : at + before + length])) for at in range(lo, hi + 1)]
            yield rows(out, {"h": long, "s": long, "lo": whole, "a": long, "b": long})

    met = segments.join(asked.hint("merge"), ["h", "s"]).select("h", "s", "before", "bytes", "ks")
    strings = written(met.mapInArrow(by_string, "h bigint, s bigint, lo int, a bigint, b bigint"), "strings")
    twice = strings.groupBy("h", "lo", "a", "b").agg(F.count("*").alias("n")).where("n > 1").drop("n")
    single = strings.join(twice.hint("merge"), ["h", "lo", "a", "b"], "left_semi").select("h", "s", "lo", (F.col("lo") + length).alias("hi"))
    # all of these strings hold the anchor, so together they cover one stretch
    return alike.unionByName(single).groupBy("h", "s").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"))


def repeats(documents: DataFrame, length: int = 200, most: int = 50_000, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(ra, rb, spans): row key and places [from, to) of covered bytes, neither sorted nor joined; rows without any are left out."""
    if length < 2 * K:
        raise ValueError(f"length is at least {2 * K}")
    spark = documents.sparkSession
    ra, rb = row_key(key, text)
    source = documents.select(ra.alias("ra"), rb.alias("rb"), F.col(text).alias("text")).where(F.octet_length("text") >= length)

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        digest, gap = xxhash.xxh3_64_intdigest, length - K
        for batch in slices(batches):
            out: list[tuple] = []
            for a, b, t in zip(*(batch.column(i).to_pylist() for i in range(3))):
                data = t.encode("utf-8", "surrogatepass")
                places, hashes = anchors(data, length)
                ss = np.array([digest(data[max(0, p - gap) : p + length], min(p, gap)) for p in places.tolist()], np.uint64).view(np.int64)
                out.append((np.full(len(ss), a, np.int64), np.full(len(ss), b, np.int64), places.astype(np.int32), hashes.view(np.int64), ss))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([o[i] for o in out])) for i in range(5)], names=["ra", "rb", "pos", "h", "s"])

    every = written(source.mapInArrow(find, "ra bigint, rb bigint, pos int, h bigint, s bigint"), "anchors")
    # a table of its own, so that adaptive execution can split the rows of a hot anchor in the join
    twice = written(every.groupBy("h").agg(F.count("*").alias("n")).where("n > 1").select("h"), "repeated-hashes")
    found = written(every.join(twice.hint("merge"), "h", "left_semi"), "repeated-anchors")
    drop(every)
    segments = written(found.groupBy("h", "s").agg(F.count("*").alias("n"), F.min(F.struct("ra", "rb", "pos")).alias("at")), "segments")
    mixed = written(segments.groupBy("h").agg(F.count("*").alias("kinds")).where("kinds > 1"), "mixed")
    wanted = segments.join(mixed.hint("merge"), "h").select("h", "s", "n", "kinds", "at.ra", "at.rb", "at.pos")
    per_row = wanted.groupBy("ra", "rb").agg(F.collect_list(F.struct("pos", "h", "s", (F.col("kinds") > most).alias("hot"))).alias("wanted"))
    # rows alike in key and text bring a segment twice; it has n > 1, so it is covered whole anyway, and it meets the others as one does
    with_text = source.join(per_row.hint("merge"), ["ra", "rb"]).select("text", "wanted")

    def bring(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            out: list[tuple] = []
            for t, wanted in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                data = t.encode("utf-8", "surrogatepass")
                for w in wanted:
                    left, own = segment(data, w["pos"], length)
                    out.append((w["h"], w["s"], left, own, w["hot"]))
            columns = list(zip(*out)) or [[]] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, (pa.int64(), pa.int64(), pa.int32(), pa.binary(), pa.bool_()))], names=["h", "s", "before", "bytes", "hot"])

    brought = written(with_text.mapInArrow(bring, "h bigint, s bigint, before int, bytes binary, hot boolean"), "segment-bytes")
    even = brought.where("not hot").select("h", "s", "before", "bytes").repartition(partitions(spark), "h").sortWithinPartitions("h")
    judged = even.mapInArrow(lambda b: _judge(b, length, 4096), "h bigint, s bigint, lo int, hi int")

    hot = brought.where("hot").select("h", "s", "before", "bytes")
    if not hot.isEmpty():
        judged = judged.unionByName(_split(hot, length))
    whole = segments.where("n > 1").select("h", "s", F.lit(-(length - K)).alias("lo"), F.lit(length).alias("hi"))
    once = segments.where("n = 1").select("h", "s")
    verdicts = written(whole.unionByName(judged.join(once.hint("merge"), ["h", "s"], "left_semi")), "verdicts")
    spans = found.join(verdicts.hint("merge"), ["h", "s"]).select("ra", "rb", F.greatest(F.col("pos") + F.col("lo"), F.lit(0)).alias("lo"), (F.col("pos") + F.col("hi")).alias("hi"))
    out = written(spans.groupBy("ra", "rb").agg(F.collect_set(F.struct("lo", "hi")).alias("spans")), "spans")
    drop(twice, found, segments, mixed, brought, verdicts)
    return out


def suffix_dedup(documents: DataFrame, length: int = 200, most: int = 50_000, key: str = "doc_id", text: str = "text", carry: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256, text, and a struct `carried` of the columns to carry along): text without the covered bytes."""
    spans = repeats(documents, length, most, key, text)
    ra, rb = row_key(key, text)
    rows = documents.select(F.col(key).alias("doc_id"), F.col(text).alias("text"), F.struct(*([F.col(f"`{c}`") for c in carry] or [F.lit(0).alias("none")])).alias("carried"), ra.alias("ra"), rb.alias("rb"))
    joined = rows.join(spans.hint("merge"), ["ra", "rb"], "left").select("doc_id", "text", "spans", "carried")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            out: list[tuple] = []
            for t, spans in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                data, parts, at, removed, n = (t or "").encode("utf-8", "surrogatepass"), [], 0, 0, 0
                reach = -1
                for lo, hi in sorted((s["lo"], min(s["hi"], len(data))) for s in spans or ()):
                    if lo > reach:
                        n += 1
                        parts.append(data[at:lo])
                        reach = at = lo
                    if hi > reach:
                        removed += hi - reach
                        reach = at = hi
                parts.append(data[at:])
                left = b"".join(parts)
                out.append((len(data), removed, n, hashlib.sha256(left).hexdigest(), t if t is None else left.decode("utf-8", "ignore")))
            columns = list(zip(*out)) or [[]] * 5
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, k) for c, k in zip(columns, (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string()))), batch.column(3)], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "text", "carried"])

    made = [StructField(c, LongType()) for c in ("n_bytes", "n_removed", "n_spans")] + [StructField(c, StringType()) for c in ("kept_sha256", "text")]
    return joined.mapInArrow(cut, StructType([joined.schema["doc_id"], *made, joined.schema["carried"]]))
