"""Token counts and ids by a tokenizer file, with an end token and a digest for audits."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_loaded: dict = {}


def _tokenizer(path: str):
    if path not in _loaded:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        _loaded[path] = Tokenizer.from_file(path)
    return _loaded[path]


#: Rows, and bytes of text where they are more than one row, that are encoded at once.
ROWS, BYTES = 64, 1 << 18


def slices(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """Runs of up to ROWS rows and BYTES bytes of the texts in the second column, or one row."""
    sizes = [x or 0 for x in pc.binary_length(batch.column(1)).to_pylist()]
    start = held = 0
    for at, n in enumerate(sizes):
        if at > start and (at - start == ROWS or held + n > BYTES):
            yield batch.slice(start, at - start)
            start, held = at, 0
        held += n
    if start < batch.num_rows:
        yield batch.slice(start)


def token_counts(docs: DataFrame, path: str, end_id: int, key: str = "doc_id", text: str = "text", with_ids: bool = False) -> DataFrame:
    """(key, token_count, token_sha256[, ids]): ids of the text and the end id."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok = _tokenizer(path)
        for batch in batches:
            # encodings take many times the bytes of their texts, so few texts are encoded at once, whatever a batch holds
            for part in slices(batch):
                counts, digests, each = [], [], []
                for e in tok.encode_batch([t or "" for t in part.column(1).to_pylist()], add_special_tokens=False):
                    ids = np.array([*e.ids, end_id], "<u4")
                    counts.append(len(ids))
                    digests.append(hashlib.sha256(ids.tobytes()).hexdigest())
                    if with_ids:
                        each.append(ids.astype(np.int64))
                more = {"ids": pa.array(each, pa.list_(pa.int64()))} if with_ids else {}
                yield pa.RecordBatch.from_pydict({key: part.column(0), "token_count": pa.array(counts, pa.int64()), "token_sha256": pa.array(digests, pa.string()), **more})

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(key, text).mapInArrow(run, f"{key} {kind}, token_count bigint, token_sha256 string" + ", ids array<bigint>" * with_ids)


def cached_counts(docs: DataFrame, cache: DataFrame | None, path: str, end_id: int, key: str = "doc_id", text: str = "text") -> tuple[DataFrame, DataFrame]:
    """(counts of all documents, new cache rows): only contents that the cache lacks are encoded, each once."""
    keyed = docs.select(key, F.sha2(F.col(text).cast("binary"), 256).alias("content"), F.col(text).alias("_t"))
    missing = keyed if cache is None else keyed.join(cache.select("content"), "content", "left_anti")
    once = missing.groupBy("content").agg(F.first("_t").alias("_t"))
    new = token_counts(once, path, end_id, key="content", text="_t")
    known = new if cache is None else cache.unionByName(new)
    return keyed.select(key, "content").join(known, "content").drop("content"), new


def token_shards(counts: DataFrame, capacity: int, key: str = "doc_id") -> DataFrame:
    """(shard, offset, key, start, length): documents one after the other in order of key, cut at shard bounds.

    Starts come from sums per range of keys first, so that no single task orders all documents.
    """
    from pyspark.sql.window import Window

    ranged = counts.withColumn("_range", F.floor(F.col(key) / 4096))
    sizes = ranged.groupBy("_range").agg(F.sum("token_count").alias("n"))
    base = sizes.select("_range", F.coalesce(F.sum("n").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_base"))
    inside = F.sum("token_count").over(Window.partitionBy("_range").orderBy(key).rowsBetween(Window.unboundedPreceding, 0))
    spans = ranged.withColumn("_in", inside).join(base, "_range").select(key, (F.col("_base") + F.col("_in") - F.col("token_count")).alias("a"), (F.col("_base") + F.col("_in")).alias("b"))
    each = spans.withColumn("shard", F.explode(F.sequence(F.floor(F.col("a") / capacity), F.floor((F.col("b") - 1) / capacity))))
    lo, hi = F.greatest("a", F.col("shard") * capacity), F.least("b", (F.col("shard") + 1) * capacity)
    return each.select("shard", (lo - F.col("shard") * capacity).alias("offset"), key, (lo - F.col("a")).alias("start"), (hi - lo).alias("length"))


def write_binary_shards(rows: DataFrame, capacity: int, path: str, key: str = "doc_id", ids: str = "ids") -> DataFrame:
    """Ids below 65,536 one document after the other in binary files of `capacity` 16-bit little-endian numbers; returns the index of spans
    (shard, offset, key, start, length). A file is made from the slices of its shard, so no task holds more than that."""
    from ..sources.sinks import write_files
    from .graph import cut

    index = cut(token_shards(rows.select(key, F.size(ids).cast("bigint").alias("token_count")), capacity, key))
    slices = index.join(rows.select(key, ids).hint("merge"), key).select("shard", "offset", F.slice(ids, F.col("start").cast("int") + 1, F.col("length").cast("int")).alias("part"))

    def join(part: pd.DataFrame) -> pd.DataFrame:
        own = part.sort_values("offset")
        whole = np.concatenate([np.asarray(x) for x in own["part"]])
        if len(whole) and not 0 <= int(whole.min()) <= int(whole.max()) <= 0xFFFF:
            raise ValueError("an id does not fit 16 bits")
        return pd.DataFrame([(f"{int(own['shard'].iloc[0]):08d}.bin", whole.astype("<u2").tobytes())], columns=["name", "data"])

    write_files(slices.groupBy("shard").applyInPandas(join, "name string, data binary"), path, "name", "data")
    return index


def read_binary_shards(spark, path: str, index: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, ids) of every document from its spans in the shards; a shard that is shorter than its spans say is an error."""
    files = spark.read.format("binaryFile").load(path).select(F.element_at(F.split(F.regexp_replace("path", r"\.bin$", ""), "/"), -1).cast("bigint").alias("shard"), "content")
    met = index.join(files.hint("merge"), "shard").select(key, "start", "offset", "length", "content")

    def cut_out(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            out = []
            for k, start, offset, n, data in part.itertuples(index=False):
                own = np.frombuffer(data, "<u2")[offset : offset + n]
                if len(own) < n:
                    raise ValueError("a shard is shorter than its index says")
                out.append((k, start, own.tolist()))
            yield pd.DataFrame(out, columns=[key, "start", "part"])

    kind = index.schema[key].dataType.simpleString()
    slices = met.mapInPandas(cut_out, f"{key} {kind}, start bigint, part array<int>")
    return slices.groupBy(key).agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("start", "part"))), lambda x: x["part"])).alias("ids"))
