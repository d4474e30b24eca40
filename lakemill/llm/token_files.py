"""Token ids on disk: frequency-ranked ids in byte-aligned variable-length coding with separate control bytes.

A block holds documents in ascending doc_id order: for each its doc_id and number of ids, then the ranks of all ids, coded by four to
a control byte (two bits each: 1 to 4 data bytes) with the data bytes apart, little-endian. Rank 0 is the most frequent id. A folder holds
blocks, as rows of a Parquet table, and ranks, the id of each rank; Spark's commit protocol guards both against lost executors, and any session reads them back.

Cases: null and empty texts hold the end id alone; rows that share a doc_id follow each other in the order of a hash of their texts, rows alike
in both in any; a null doc_id comes first; an empty table gives empty files.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import drop, partitions, row_key, scratch_dir, slices, written
from .tokens import encoder

#: Ids to a block, more only where one document has more.
BLOCK = 1 << 18
BLOCKS = "part int, before bigint, keys array<bigint>, sizes array<bigint>, control binary, data binary"
_LENGTHS = np.array([[(c >> 2 * k & 3) + 1 for k in range(4)] for c in range(256)], np.uint8)


def pack_ranks(ranks: np.ndarray) -> tuple[bytes, bytes]:
    """(control bytes, data bytes) of unsigned 32-bit ranks."""
    ranks = np.ascontiguousarray(ranks, "<u4")
    n, most = len(ranks), int(ranks.max(initial=0))
    code = np.zeros(-(-n // 4) * 4, np.uint8)
    for bound in (0xFF, 0xFFFF, 0xFFFFFF):
        if most > bound:
            code[:n] += ranks > bound
    ends = np.cumsum(code[:n], dtype=np.int64) + np.arange(1, n + 1)
    at, each = ends - code[:n] - 1, ranks.view(np.uint8).reshape(-1, 4)
    data = np.empty(int(ends[-1]) if n else 0, np.uint8)
    data[at] = each[:, 0]
    for k in range(1, 4):
        more = np.flatnonzero(code[:n] >= k)
        if not len(more):
            break
        data[at[more] + k] = each[more, k]
    quads = code.reshape(-1, 4)
    control = quads[:, 0] | quads[:, 1] << 2 | quads[:, 2] << 4 | quads[:, 3] << 6
    return control.tobytes(), data.tobytes()


def unpack_ranks(control: bytes, data: bytes, n: int) -> np.ndarray:
    """The ranks again: lengths by a table of control bytes, then one gather of up to four bytes each."""
    size = _LENGTHS[np.frombuffer(control, np.uint8)].reshape(-1)[:n]
    start = np.cumsum(size, dtype=np.int64) - size
    raw = np.frombuffer(data, np.uint8)
    out = raw[start].astype(np.uint32)
    for k in range(1, 4):
        more = np.flatnonzero(size > k)
        if not len(more):
            break
        out[more] |= raw[start[more] + k].astype(np.uint32) << np.uint32(8 * k)
    return out


def write_token_files(documents: DataFrame, path: str, end_id: int, folder: str | None = None, key: str = "doc_id", text: str = "text") -> str:
    """Writes blocks in ascending order of key, and ranks; returns their folder, one of the shared scratch folder's own if none is given.

    The documents are dealt out by ranges of the key, so only texts cross the network, once; ids are counted over the whole
    corpus (one row a distinct id and task), and the ranking, as long as the vocabulary, is broadcast.
    """
    spark = documents.sparkSession

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens, end = encoder(path), np.array([end_id], "<u4").tobytes()
        for batch in slices(batches, 1024):
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([x + end for x in tokens.encode(batch.column(1).to_pylist())], pa.large_binary())], names=["k", "ids"])

    def narrow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Blocks of raw ids; part and before say which range of keys and how many ids of it come first."""
        part, keys, parts, n, before = TaskContext.get().partitionId(), [], [], 0, 0

        def block():
            ids = np.frombuffer(b"".join(parts), "<u4")
            wide = bool(len(ids)) and int(ids.max()) > 0xFFFF
            # ids of the block and how often each occurs: for the ranking, without reading the block again
            if wide:
                own, times = np.unique(ids, return_counts=True)
            else:
                times = np.bincount(ids)
                own = np.flatnonzero(times)
                times = times[own]
            columns = [pa.array([part], pa.int32()), pa.array([before], pa.int64()), pa.array([keys], pa.list_(pa.int64())), pa.array([[len(p) // 4 for p in parts]], pa.list_(pa.int64())), pa.array([wide]), pa.array([(ids if wide else ids.astype("<u2")).tobytes()], pa.binary())]
            return pa.RecordBatch.from_arrays([*columns, pa.array([own.astype(np.int64)], pa.list_(pa.int64())), pa.array([times.astype(np.int64)], pa.list_(pa.int64()))], names=["part", "before", "keys", "sizes", "wide", "raw", "own", "times"])

        for batch in encode(batches):
            for k, ids in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                keys.append(k)
                parts.append(ids)
                n += len(ids) // 4
                if n >= BLOCK:
                    yield block()
                    keys, parts, n, before = [], [], 0, before + n
        if keys:
            yield block()

    # the text's hash orders rows that share a key, and parts them into ranges
    ordered = documents.select(F.col(key).cast("long").alias("k"), F.col(text).alias("t"), row_key(text)[0].alias("tie")).repartitionByRange(partitions(spark), "k", "tie").sortWithinPartitions("k", "tie")
    raw = written(ordered.mapInArrow(narrow, "part int, before bigint, keys array<bigint>, sizes array<bigint>, wide boolean, raw binary, own array<bigint>, times array<bigint>"), "ids")
    counts = raw.select(F.explode(F.arrays_zip("own", "times")).alias("x")).groupBy(F.col("x.own").alias("id")).agg(F.sum("x.times").alias("n"))
    by_rank = np.array([r.id for r in counts.orderBy(F.desc("n"), "id").select("id").collect()], np.uint32)
    rank = np.zeros(int(by_rank.max()) + 1 if len(by_rank) else 1, np.uint32)
    rank[by_rank] = np.arange(len(by_rank), dtype=np.uint32)
    sent = spark.sparkContext.broadcast(rank)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 8):
            packed = [pack_ranks(sent.value[np.frombuffer(ids, "<u4" if wide else "<u2")]) for wide, ids in zip(batch.column(4).to_pylist(), batch.column(5).to_pylist())]
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], pa.array([x[0] for x in packed], pa.binary()), pa.array([x[1] for x in packed], pa.binary())], names=["part", "before", "keys", "sizes", "control", "data"])

    folder = folder or f"{scratch_dir(spark)}/token-files-{uuid.uuid4().hex}"
    raw.drop("own", "times").mapInArrow(pack, BLOCKS).write.option("compression", "zstd").parquet(f"{folder}/blocks")
    table = pa.table({"rank": pa.array(np.arange(len(by_rank))), "id": pa.array(by_rank.astype(np.int64))})
    spark.createDataFrame(table).coalesce(1).write.parquet(f"{folder}/ranks")
    drop(raw)
    return folder


def open_token_files(spark: SparkSession, folder: str) -> tuple[DataFrame, np.ndarray]:
    """(blocks, id of each rank). There are as many ranks as the vocabulary has ids at most, so the driver may hold them."""
    ranks = spark.read.schema("rank bigint, id bigint").parquet(f"{folder}/ranks").toArrow()
    by_rank = np.zeros(ranks.num_rows, np.uint32)
    by_rank[ranks["rank"].to_numpy()] = ranks["id"].to_numpy()
    return spark.read.schema(BLOCKS).parquet(f"{folder}/blocks"), by_rank


def read_token_files(spark: SparkSession, folder: str) -> DataFrame:
    """(doc_id, n_tokens, ids) of each document, ids as little-endian unsigned 32-bit integers."""
    files, by_rank = open_token_files(spark, folder)
    sent = spark.sparkContext.broadcast(by_rank)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 8):
            for keys, sizes, control, data in zip(*(batch.column(i).to_pylist() for i in range(4))):
                ids = sent.value[unpack_ranks(control, data, sum(sizes))].astype("<u4")
                ends = np.cumsum(sizes).tolist()
                yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(sizes, pa.int64()), pa.array([ids[e - n : e].tobytes() for e, n in zip(ends, sizes)], pa.binary())], names=["doc_id", "n_tokens", "ids"])

    return files.select("keys", "sizes", "control", "data").mapInArrow(read, "doc_id bigint, n_tokens bigint, ids binary")


def token_digests(documents: DataFrame, path: str, end_id: int = 1) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) read back from the files; start counts the ids of all documents before it.

    A block says how many ids of its range of keys come first; the driver adds up one number a range.
    """
    spark: SparkSession = documents.sparkSession
    files, by_rank = open_token_files(spark, write_token_files(documents, path, end_id))
    ranges = files.groupBy("part").agg(F.sum(F.aggregate("sizes", F.lit(0).cast("bigint"), lambda a, x: a + x)).alias("n")).orderBy("part").collect()
    base, at = {}, 0
    for r in ranges:
        base[r.part] = at
        at += r.n
    sent = spark.sparkContext.broadcast((base, by_rank))

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base, by_rank = sent.value
        for batch in slices(batches, 8):
            for part, before, keys, sizes, control, data in zip(*(batch.column(i).to_pylist() for i in range(6))):
                ids = by_rank[unpack_ranks(control, data, sum(sizes))].astype("<u4")
                ends = np.cumsum(sizes)
                starts = ends - sizes
                crc = [zlib.crc32(ids[a:b].tobytes()) for a, b in zip(starts.tolist(), ends.tolist())]
                yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(starts + before + base[part], pa.int64()), pa.array(sizes, pa.int64()), pa.array(crc, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    return files.mapInArrow(digest, "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint")
