"""Language identification: multinomial naive Bayes over hashed character n-grams.

The model learns from a bounded sample of the labelled rows (`per_language` of each language, chosen by a hash of the id): counts of n-grams of
one to `order` characters of the lower-cased text in `buckets` hash buckets, add-one smoothed. Its matrix of log probabilities, languages by buckets,
is broadcast; its size is checked. A text is scored as the sparse vector of its bucket counts times that matrix.

Cases: a text that is null or has no letter is `und` with score 0; texts are scored whole, whatever their length; ties go to the
first language in alphabetical order; without any labelled row every text is `und`; repeated rows are scored each. The score is the
posterior probability of the predicted language.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import slices

#: Languages that a model may have; the matrix has this many rows at most.
MOST_LANGUAGES = 1000
#: Bytes of the matrix.
MOST_BYTES = 1 << 28
_MIX = [np.uint32(x) for x in (0x9E3779B1, 0x85EBCA6B, 0xC2B2AE35, 0x27D4EB2F, 0x165667B1)]
#: Characters that are hashed at once.
_AT_ONCE = 1 << 20


def buckets_of(text: str, order: int, bits: int) -> Iterator[np.ndarray]:
    """The bucket of every n-gram, n from 1 to order."""
    c = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), "<u4")
    for at in range(0, len(c), _AT_ONCE):
        part = c[at : at + _AT_ONCE + order - 1]
        own = min(len(c) - at, _AT_ONCE)
        h = part * _MIX[0]
        for n in range(1, order + 1):
            if n > 1:
                h = (h[:-1] ^ (h[:-1] >> np.uint32(15))) * _MIX[n % len(_MIX)] + part[n - 1 :] * _MIX[0]
            yield ((h[:own] ^ (h[:own] >> np.uint32(13))) * _MIX[1]) >> np.uint32(32 - bits)


def counts_of(text: str, order: int, bits: int) -> np.ndarray:
    total = np.zeros(1 << bits, np.int64)
    for b in buckets_of(text, order, bits):
        total += np.bincount(b, minlength=1 << bits)
    return total


@dataclass
class Model:
    languages: list[str]
    prior: np.ndarray
    log_p: np.ndarray  # buckets x languages
    order: int
    bits: int

    def score(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        """The texts are rows of a sparse matrix of bucket counts, one entry an n-gram; it is multiplied by log_p in pieces of bounded size."""
        known = [i for i, t in enumerate(texts) if self.languages and t and any(map(str.isalpha, t))]
        logs = np.tile(self.prior, (len(known), 1))
        most, rows, columns, held = max(1 << 12, (1 << 22) // max(1, len(self.languages))), [], [], 0

        def multiply() -> None:
            """Entries of a row lie together: gather their lines of log_p, and add up each row's."""
            row, column = np.concatenate(rows), np.concatenate(columns)
            for at in range(0, len(row), most):
                r, c = row[at : at + most], column[at : at + most]
                first = np.flatnonzero(np.concatenate(([True], r[1:] != r[:-1])))
                logs[r[first]] += np.add.reduceat(self.log_p[c], first, axis=0)

        for j, i in enumerate(known):
            for b in buckets_of(texts[i], self.order, self.bits):
                rows.append(np.full(len(b), j, np.int32))
                columns.append(b)
                held += len(b)
                if held >= most:
                    multiply()
                    rows, columns, held = [], [], 0
        if held:
            multiply()
        names, scores = ["und"] * len(texts), [0.0] * len(texts)
        if known:
            best = logs.argmax(axis=1)
            for i, x, p in zip(known, best.tolist(), (1 / np.exp(logs - logs.max(axis=1, keepdims=True)).sum(axis=1)).tolist()):
                names[i], scores[i] = self.languages[x], p
        return names, scores


def fit(documents: DataFrame, learns: Column, order: int = 3, bits: int = 15, per_language: int = 3000, key: str = "doc_id", text: str = "text", lang: str = "lang") -> Model:
    """A model of the rows where `learns` holds and text and language are known; about per_language rows of each language."""
    rows = documents.where(learns & F.col(lang).isNotNull() & F.col(text).isNotNull()).select(F.col(lang).alias("lang"), F.col(text).alias("text"), F.pmod(F.xxhash64(F.col(key).cast("string")), F.lit(1 << 30)).alias("h"))
    sizes = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count("*").alias("n")).orderBy("lang").limit(MOST_LANGUAGES + 1).collect()}
    if len(sizes) > MOST_LANGUAGES:
        raise ValueError(f"more than {MOST_LANGUAGES} languages")
    if len(sizes) << bits + 3 > MOST_BYTES:
        raise ValueError("the matrix is too large for the driver and to broadcast")
    if not sizes:
        return Model([], np.zeros(0), np.zeros((1 << bits, 0)), order, bits)
    languages = sorted(sizes)
    share = F.create_map(*[F.lit(x) for name in languages for x in (name, min(1 << 30, -(-per_language * (1 << 30) // sizes[name])))])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[str, np.ndarray] = {}
        for batch in slices(batches):
            for name, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                n = counts_of(t, order, bits)
                total[name] = total[name] + n if name in total else n
        for name, n in total.items():
            at = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array([name] * len(at), pa.string()), pa.array(at, pa.int32()), pa.array(n[at], pa.int64())], names=["lang", "bucket", "n"])

    # at most MOST_LANGUAGES x 2 ** bits sums come to the driver
    sums = rows.where(F.col("h") < share[F.col("lang")]).select("lang", "text").mapInArrow(count, "lang string, bucket int, n bigint").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toPandas()
    table = np.zeros((1 << bits, len(languages)))
    table[sums["bucket"].to_numpy(np.int64), np.searchsorted(languages, sums["lang"].to_numpy(str)) if len(sums) else []] = sums["n"].to_numpy(float)
    total = sum(sizes.values())
    return Model(languages, np.log([sizes[x] / total for x in languages]), np.log((table + 1) / (table.sum(axis=0) + (1 << bits))), order, bits)


def predict(documents: DataFrame, model: Model, held_out: Column, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, held_out, lang_pred, score) of each document; only the text is scored."""
    if model.log_p.nbytes > MOST_BYTES:
        raise ValueError("the matrix is too large to broadcast")
    sent = documents.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            names, scores = sent.value.score(batch.column(2).to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(names, pa.string()), pa.array(scores, pa.float64())], names=["doc_id", "held_out", "lang_pred", "score"])

    kind = documents.schema[key].dataType.simpleString()
    return documents.select(F.col(key).alias("doc_id"), held_out.alias("held_out"), F.col(text).alias("text")).mapInArrow(run, f"doc_id {kind}, held_out boolean, lang_pred string, score double")
