"""Hashes, stable fractions, splits and signatures as Column expressions."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pyspark.sql.types import ArrayType, LongType

from .text import bound


def sha256(text: Column) -> Column:
    return F.sha2(text.cast("binary"), 256)


def keyed(*parts: Column) -> Column:
    """SHA-256 of the parts with NUL between them."""
    return F.sha2(F.concat_ws("\x00", *[p.cast("string") for p in parts]).cast("binary"), 256)


def row_key(*columns: str | Column) -> tuple[Column, Column]:
    """128 bits that name a row by these columns, as two longs of XXH64 with different seeds.

    Rows that share an id, or have none, are told apart by their texts; only rows alike in all of these columns share a key. The key
    depends on values alone, so that any scan or retry gives the same.
    """
    named = [F.col(c) if isinstance(c, str) else c for c in columns]
    given = [x for c in named for x in (c.isNull(), c)]
    return F.xxhash64(F.lit(1), *given), F.xxhash64(F.lit(2), *given)


def stable_fraction(*parts: Column) -> Column:
    """In [0, 1): the first 13 hex digits of the keyed hash."""
    return F.conv(F.substring(keyed(*parts), 1, 13), 16, 10).cast("double") / float(16**13)


def split_name(key: Column, val_ratio: float) -> Column:
    part = F.conv(F.substring(F.sha1(key.cast("string").cast("binary")), 1, 8), 16, 10).cast("double") / 4294967295.0
    return F.when(part < val_ratio, "val").otherwise("train")


def bucket(digest: Column, n: int) -> Column:
    """The leading 15 hex digits modulo n."""
    return F.pmod(F.conv(F.substring(digest, 1, 15), 16, 10).cast("bigint"), F.lit(n))


def hamming(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b)).cast("bigint")


def md5_minhash(shingles: Column, seeds: int) -> Column:
    """For each seed the least md5 of seed:shingle; no signature without shingles."""
    return bound(shingles, lambda x: F.when(F.size(x) > 0, F.transform(F.sequence(F.lit(0), F.lit(seeds - 1)), lambda k: F.array_min(F.transform(x, lambda s: F.md5(F.concat(k.cast("string"), F.lit(":"), s).cast("binary")))))).otherwise(F.array().cast("array<string>")))


def short_hash(text: Column) -> Column:
    """The leading 32 bits of md5 as a whole number."""
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 8), 16, 10).cast("bigint")


def affine_minhash(size: int = 5, permutations: int = 128, seed: int = 16062026):
    """A UDF from arrays of words to `permutations` minima of (a h + b, modulo 2^64) modulo 2^61 - 1 over shingles of `size` words; empty without shingles.

    A shingle's hash h is the 64-bit BLAKE2b of its words, each behind its length in 8 bytes; coefficients come from the legacy generator of the seed,
    so that signatures are those of existing indexes.
    """
    prime = (1 << 61) - 1
    rng = np.random.RandomState(seed)
    a = rng.randint(1, prime, size=permutations, dtype=np.uint64)
    b = rng.randint(0, prime, size=permutations, dtype=np.uint64)

    @F.pandas_udf(ArrayType(LongType()))
    def signature(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        import hashlib

        def one(words):
            coded = [len(w).to_bytes(8, "little") + w for w in (x.encode("utf-8", "surrogatepass") for x in (words if words is not None else ()))]
            hashes = [int.from_bytes(hashlib.blake2b(b"".join(coded[i : i + size]), digest_size=8).digest(), "little") for i in range(len(coded) - size + 1)]
            if not hashes:
                return []
            least, h = np.full(permutations, np.iinfo(np.uint64).max, np.uint64), np.array(hashes, np.uint64)
            for at in range(0, len(h), 4096):
                least = np.minimum(least, ((h[at : at + 4096, None] * a + b) % np.uint64(prime)).min(axis=0))
            return least.astype(np.int64).tolist()

        for part in parts:
            yield part.map(one)

    return signature


def md5_simhash(shingles: Column, bits: int = 64) -> Column:
    """Majority of the bits of the leading 16 hex digits of each shingle's md5, as a bit string."""

    def digits(s: Column) -> Column:
        half = lambda at: F.lpad(F.conv(F.substring(F.md5(s.cast("binary")), at, 8), 16, 2), 32, "0")
        return F.concat(half(1), half(9))

    def vote(x: Column) -> Column:
        ones = lambda k: F.size(F.filter(x, lambda d: F.substr(d, k, F.lit(1)) == "1"))
        return F.array_join(F.transform(F.sequence(F.lit(1), F.lit(bits)), lambda k: F.when(ones(k) * 2 > F.size(x), "1").otherwise("0")), "")

    return bound(F.transform(shingles, digits), vote)


def word_simhashes(rows: DataFrame, size: int, key: str, words: str) -> DataFrame:
    """(key, bits): md5_simhash of the distinct runs of `size` words, of words in one text with a space between them; all zero where there are fewer."""

    def one(text: str | None) -> str:
        from hashlib import md5

        joined = (text or "").encode("utf-8", "surrogatepass")
        ends = np.append(np.flatnonzero(np.frombuffer(joined, np.uint8) == 32), len(joined))
        starts = np.concatenate(([0], ends[:-1] + 1))[: max(0, len(ends) - size + 1)].tolist()
        runs = list({joined[s:e] for s, e in zip(starts, ends[size - 1 :].tolist())})
        ones = np.zeros(64, np.int64)
        for at in range(0, len(runs), 1 << 15):
            lead = b"".join([md5(x).digest()[:8] for x in runs[at : at + (1 << 15)]])
            ones += np.unpackbits(np.frombuffer(lead, np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
        return (48 + (2 * ones > len(runs))).astype(np.uint8).tobytes().decode()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([one(t) for t in part.column(1).to_pylist()], pa.string())], names=[key, "bits"])

    return rows.select(key, words).mapInArrow(run, f"{key} {rows.schema[key].dataType.simpleString()}, bits string")
