"""Exact, span, block and near dedup, winners and incremental merges."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import text as T


def winners(df: DataFrame, by: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """One row a key, the first in a total order; an aggregate with partial results, so a hot key does not gather."""
    keys = [F.col(c) for c in by]
    best = F.min_by(F.struct(*[c for c in df.columns if c not in by]), F.struct(*[o.alias(f"o{i}") for i, o in enumerate(order)]))
    return df.groupBy(*keys).agg(best.alias("_w")).select(*by, "_w.*")


def winner_order(priority: str = "priority", quality: str = "quality_score", ids: Sequence[str] = ("doc_id",)) -> list[Column]:
    """Priority falling, known quality first (-1 is unknown), quality falling, then ids."""
    return [-F.col(priority), F.col(quality) < 0, -F.col(quality), *map(F.col, ids)]


def duplicates(df: DataFrame, by: str, order: Sequence[Column], key: str = "doc_id") -> DataFrame:
    """(key, winner) of every row that is not its group's winner."""
    best = df.groupBy(by).agg(F.min_by(key, F.struct(*[o.alias(f"o{i}") for i, o in enumerate(order)])).alias("winner"), F.count("*").alias("n")).where("n > 1").select(by, "winner")
    return df.select(key, by).join(best, by).where(~F.col(key).eqNullSafe(F.col("winner"))).select(key, "winner")


def remove(df: DataFrame, gone: DataFrame, key: str = "doc_id") -> DataFrame:
    return df.join(gone.select(key), key, "left_anti")


def span_digest(sentences: Column) -> Column:
    return F.sha2(F.array_join(F.transform(sentences, F.lower), "\x1e").cast("binary"), 256)


def span_signatures(docs: DataFrame, size: int = 3, least_words: int = 24, key: str = "doc_id", text: str = "text", *keep: Column) -> DataFrame:
    """(key, keep, pos, digest) of every window of `size` sentences with the least words."""
    rows = docs.select(key, *keep, T.sentences(F.col(text)).alias("_s"))
    names = [c for c in rows.columns if c != "_s"]
    spans = rows.select(*names, F.posexplode(T.windows(F.col("_s"), size)).alias("pos", "w")).where(T.number_of(F.array_join("w", " "), T.WORD) >= least_words)
    return spans.select(*names, "pos", span_digest(F.col("w")).alias("digest"))


def span_candidates(signatures: DataFrame, prefix: int = 32, key: str = "doc_id") -> DataFrame:
    """The signatures whose digest's prefix two documents or more hold; a collision of prefixes only lets more pass."""
    rows = signatures.withColumn("_p", F.substring("digest", 1, prefix))
    several = rows.groupBy("_p").agg(F.min(key).alias("a"), F.max(key).alias("b")).where("a <> b").select("_p")
    return rows.join(several, "_p", "left_semi").drop("_p")


def _span_hashes(docs: DataFrame, size: int, least_words: int, key: str, text: str, order: Column) -> DataFrame:
    """(key, _order, pos, h): 64-bit hashes of the windows with the least words; words are counted once a sentence."""
    told = docs.select(key, order.alias("_order"), T.sentences(F.col(text)).alias("_s"))
    rows = told.select(key, "_order", F.transform("_s", F.lower).alias("_l"), F.transform("_s", lambda s: T.number_of(s, T.WORD)).alias("_n"))
    words = lambda i: sum((F.get("_n", i + k) for k in range(1, size)), F.get("_n", i))
    spans = F.transform(F.sequence(F.lit(0), F.size("_l") - size), lambda i: F.struct(F.xxhash64(F.slice("_l", i + 1, size)).alias("h"), words(i).alias("w")))
    each = rows.select(key, "_order", F.posexplode(F.when(F.size("_l") >= size, spans)).alias("pos", "x"))
    return each.where(F.col("x.w") >= least_words).select(key, "_order", "pos", "x.h")


def shared_spans(docs: DataFrame, size: int = 3, least_words: int = 24, key: str = "doc_id", text: str = "text", order: Column | None = None) -> DataFrame:
    """(key, pos, digest, keeper): every window of `size` sentences that two documents or more hold, with the document that keeps it.

    Short hashes of all windows tell which may be shared; whole digests are made of those alone, from the texts of their documents.
    """
    from .graph import cut

    first = order if order is not None else F.col(key)
    hashes = cut(_span_hashes(docs, size, least_words, key, text, first))
    # two documents, not two places: compares the smallest and largest key, so nothing is gathered
    several = hashes.groupBy("h").agg(F.min(key).alias("a"), F.max(key).alias("b")).where("a <> b").select("h")
    places = hashes.join(several.hint("merge"), "h", "left_semi").groupBy(key).agg(F.collect_set("pos").alias("_p"))
    near = docs.join(places.withColumnRenamed(key, "_k").hint("merge"), F.col(key) == F.col("_k")).select(key, first.alias("_order"), T.sentences(F.col(text)).alias("_s"), "_p")
    spans = cut(near.select(key, "_order", "_s", F.explode("_p").alias("pos")).select(key, "_order", "pos", span_digest(F.slice("_s", F.col("pos") + 1, size)).alias("digest")))
    shared = spans.groupBy("digest").agg(F.min(key).alias("a"), F.max(key).alias("b"), F.min_by(key, F.struct("_order", key)).alias("keeper")).where("a <> b").select("digest", "keeper")
    return spans.join(shared, "digest").select(key, "pos", "digest", "keeper")


def verified_removals(docs: DataFrame, removals: DataFrame, size: int = 3, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_sentences, gone): the sentences to remove of each document with removals (key, pos, digest) whose digest is still that of its text."""
    told = removals.groupBy(key).agg(F.collect_list(F.struct("pos", "digest")).alias("_r"))
    rows = docs.select(key, T.sentences(F.col(text)).alias("_s")).join(told.hint("merge"), key)
    sound = F.filter("_r", lambda r: span_digest(F.slice(F.col("_s"), r["pos"] + 1, size)) == r["digest"])
    gone = F.array_sort(F.array_distinct(F.flatten(F.transform(sound, lambda r: F.sequence(r["pos"], r["pos"] + (size - 1))))))
    return rows.select(key, F.size("_s").alias("n_sentences"), gone.alias("gone"))


def sha_number(name: str) -> str:
    """The first 15 hexadecimal digits of a name's SHA-256."""
    return hashlib.sha256(name.encode()).hexdigest()[:15]


def strip_spans(docs: DataFrame, spans: DataFrame, size: int = 3, least_words: int = 50, least_sentences: int = 3, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_sentences, n_removed, kept_text, decision) after all non-keepers lose their shared spans."""
    gone = spans.where(F.col(key) != F.col("keeper")).groupBy(key).agg(F.collect_set("pos").alias("pos")).select(key, F.array_distinct(F.flatten(F.transform("pos", lambda p: F.sequence(p, p + (size - 1))))).alias("gone"))
    rows = docs.select(key, T.sentences(F.col(text)).alias("s")).join(gone, key, "left")
    left = rows.withColumn("at", F.when(F.size("s") > 0, F.array_except(F.sequence(F.lit(0), F.size("s") - 1), F.coalesce("gone", F.array().cast("array<int>")))).otherwise(F.array().cast("array<int>")))
    out = left.select(key, F.size("s").alias("n_sentences"), (F.size("s") - F.size("at")).alias("n_removed"), F.array_join(F.transform("at", lambda i: F.get("s", i)), " ").alias("kept_text"), F.size("at").alias("_left"))
    short = (F.col("n_removed") > 0) & ((T.number_of(F.col("kept_text"), T.WORD) < least_words) | (F.col("_left") < least_sentences))
    return out.withColumn("decision", F.when(short, "dropped").when(F.col("n_removed") > 0, "stripped").otherwise("kept")).drop("_left")


def block_duplicates(docs: DataFrame, tokens: Column, size: int = 96, share: float = 0.8, key: str = "doc_id") -> DataFrame:
    """(key, weight, duplicate_weight, removed): documents whose blocks of `size` tokens mostly stand in an earlier document."""
    rows = docs.select(key, tokens.alias("t")).where(F.size("t") >= size)
    blocks = rows.select(key, F.explode(F.transform(F.sequence(F.lit(1), F.size("t") - (size - 1), F.lit(size)), lambda i: F.slice("t", i, size))).alias("b")).groupBy(key, F.md5(F.array_join("b", " ").cast("binary")).alias("digest")).agg(F.count("*").alias("w"))
    first = blocks.groupBy("digest").agg(F.min(key).alias("first"))
    return blocks.join(first, "digest").groupBy(key).agg(F.sum("w").alias("weight"), F.sum(F.when(F.col("first") != F.col(key), F.col("w")).otherwise(0)).alias("duplicate_weight")).withColumn("removed", F.col("duplicate_weight") / F.col("weight") >= share)


def code_removals(units: DataFrame, order: Column, share: float = 0.8, key: str = "doc_id") -> DataFrame:
    """(key, total, copied, reason) of the files to remove, from (key, kind, digest, weight): each (digest, kind) stays with its first file by order; a file
    goes if its whole is another's, or if its copied units are `share` of the weight of all its units."""
    rows = units.withColumn("_order", order)
    keepers = rows.groupBy("digest", "kind").agg(F.min_by(key, F.struct("_order", key)).alias("keeper"), F.count("*").alias("n")).where("n > 1").select("digest", "kind", "keeper")
    lost = rows.join(keepers.hint("merge"), ["digest", "kind"], "left").withColumn("copy", F.coalesce(F.col("keeper") != F.col(key), F.lit(False)))
    unit = F.col("kind") != "file"
    sums = lost.groupBy(key).agg(F.bool_or(~unit & F.col("copy")).alias("file"), F.coalesce(F.sum(F.when(unit, F.col("weight"))), F.lit(0)).alias("total"), F.coalesce(F.sum(F.when(unit & F.col("copy"), F.col("weight"))), F.lit(0)).alias("copied"))
    reason = F.when(F.col("file"), "file_duplicate").when((F.col("total") > 0) & (F.col("copied") >= F.col("total") * share), "unit_duplicates")
    return sums.select(key, "total", "copied", reason.alias("reason")).where("reason IS NOT NULL")


def signatures(rows: DataFrame, hashes: str, permutations: int) -> DataFrame:
    """rows with the array of 32-bit hashes replaced by `permutations` minima of (a h + b) mod (2^31 - 1); rows without hashes are left out.

    Every hash is permuted in 64-bit arithmetic, which any engine has: a and b of permutation k are (k + 1) * 2654435761 mod 1073741789 and
    (k + 1) * 40503 * 65537 mod 1073741827.
    """
    k = np.arange(1, permutations + 1, dtype=object)
    a, b = (k * 2654435761 % 1073741789).astype(np.int64), (k * 40503 * 65537 % 1073741827).astype(np.int64)
    names = rows.columns
    at = names.index(hashes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for h in batch.column(at):
                x, least = np.asarray(h.values), np.full(permutations, np.iinfo(np.int64).max)
                for i in range(0, len(x), 4096):
                    least = np.minimum(least, ((x[i : i + 4096, None] * a + b) % 2147483647).min(axis=0))
                out.append(least)
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.list_(pa.int64())) if i == at else c for i, c in enumerate(batch.columns)], names=names)

    return rows.where(F.size(hashes) > 0).mapInArrow(run, rows.schema)


def band_keys(signature: Column, rows: int, scope: Column) -> Column:
    """A digest for each band of `rows` signature values."""
    return F.transform(F.sequence(F.lit(0), (F.size(signature) / rows).cast("int") - 1), lambda i: F.sha2(F.concat_ws("|", scope, i.cast("string"), F.array_join(F.slice(signature, i * rows + 1, rows), ",")).cast("binary"), 256))


def band_links(signed: DataFrame, bands: Column, key: str = "doc_id") -> DataFrame:
    """(u, v): each document of a band's bucket linked to the smallest one, which joins the bucket without all its pairs."""
    each = signed.select(key, F.explode(bands).alias("band"))
    least = each.groupBy("band").agg(F.min(key).alias("v"), F.max(key).alias("_m")).where("v <> _m").select("band", "v")
    return each.join(least, "band").where(F.col(key) != F.col("v")).select(F.col(key).alias("u"), "v").distinct()


def merged(index: DataFrame | None, batch: DataFrame, by: Sequence[str], order: Sequence[Column], identity: Sequence[str]) -> DataFrame:
    """The index after a batch: an occurrence (by and identity) counts once; of redeliveries that differ the first in the order stays, then
    the first by all columns, so the result does not depend on which came first."""
    rows = batch if index is None else index.unionByName(batch)
    keys = list(dict.fromkeys([*by, *identity]))
    rest = [c for c in rows.columns if c not in keys]
    if not rest:
        return rows.distinct()
    best = F.min_by(F.struct(*rest), F.struct(*[o.alias(f"o{i}") for i, o in enumerate(order)], *[F.col(c).alias(f"c{i}") for i, c in enumerate(rest)]))
    return rows.groupBy(*keys).agg(best.alias("_w")).select(*keys, "_w.*").select(*rows.columns)


def status(deliveries: DataFrame, by: str = "dedup_hash", identity: str = "occurrence_id") -> DataFrame:
    """input_rows, raw_occurrences, unique_winners, repeated_deliveries, duplicate_occurrences."""
    each = deliveries.groupBy(by, identity).agg(F.count("*").alias("n")).groupBy(by).agg(F.sum("n").alias("rows"), F.count("*").alias("occ"))
    return each.agg(F.sum("rows").cast("bigint").alias("input_rows"), F.sum("occ").cast("bigint").alias("raw_occurrences"), F.count("*").alias("unique_winners")).withColumn("repeated_deliveries", F.col("input_rows") - F.col("raw_occurrences")).withColumn("duplicate_occurrences", F.col("raw_occurrences") - F.col("unique_winners"))


def band_masks(varied: int, radius: int) -> list[int]:
    """The bits of varied dealt to radius + 2 bands, as masks of signed longs."""
    bits = [k for k in range(64) if varied >> k & 1]
    return np.array([sum(1 << k for k in bits[i :: radius + 2]) for i in range(radius + 2)], np.uint64).view(np.int64).tolist()


def greedy_simhash(docs: DataFrame, fp: str, radius: int = 3, key: str = "doc_id", block: int = 1024) -> DataFrame:
    """(a, b, distance): pairs of distinct fingerprints within the radius, each once, by their smallest keys; a keeps, as it comes first.

    The bits that are not the same in all fingerprints are dealt to radius + 2 bands, of which a pair within the radius has two alike at least. So fingerprints
    meet in the bucket of each two bands, and a pair counts in the bucket of the first two that it has alike. Bits that are the same everywhere would only make buckets of
    everything. Buckets are cut into blocks of about `block`, and blocks are compared whole, by exclusive-or.
    """
    from .graph import cut

    one = cut(docs.select(F.col(fp).cast("bigint").alias("fp"), F.col(key).alias("id")).groupBy("fp").agg(F.min("id").alias("id")).where("fp IS NOT NULL AND id IS NOT NULL"))
    either, all_of = one.agg(F.bit_or("fp"), F.bit_and("fp")).first()
    masks = band_masks(((either or 0) ^ (all_of or 0)) & (1 << 64) - 1, radius)
    chosen = list(combinations(range(radius + 2), 2))
    posts = one.select("fp", "id", F.explode(F.array(*[F.struct(F.lit(c).alias("c"), F.col("fp").bitwiseAND(F.lit(masks[i] | masks[j]).cast("bigint")).alias("v")) for c, (i, j) in enumerate(chosen)])).alias("at")).select("fp", "id", "at.*")
    sizes = posts.groupBy("c", "v").agg(F.count("*").alias("n")).where("n > 1").select("c", "v", F.ceil(F.col("n") / block).cast("int").alias("of"))
    placed = posts.join(sizes.hint("merge"), ["c", "v"]).withColumn("block", F.pmod(F.xxhash64("fp"), F.col("of")).cast("int"))
    blocks = cut(placed.groupBy("c", "v", "of", "block").agg(F.collect_list(F.struct("fp", "id")).alias("x")))
    sent = blocks.where("block + 1 < of").select("c", "v", "x", F.explode(F.sequence(F.col("block") + 1, F.col("of") - 1)).alias("block"))
    across = sent.join(blocks.where("block > 0").select("c", "v", "block", F.col("x").alias("y")).hint("merge"), ["c", "v", "block"]).select("c", "x", "y")
    pairs = blocks.select("c", "x", F.lit(None).cast(blocks.schema["x"].dataType).alias("y")).unionByName(across)

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found, rows = [], 0
            for at in range(batch.num_rows):
                i, j = chosen[batch.column(0)[at].as_py()]
                x = batch.column(1)[at].values
                y = batch.column(2)[at].values if batch.column(2)[at].is_valid else None
                fx = x.field("fp").to_numpy()
                fy = fx if y is None else y.field("fp").to_numpy()
                for lo in range(0, len(fx), 256):
                    left, right = np.nonzero(np.bitwise_count(fx[lo : lo + 256, None].view(np.uint64) ^ fy[None, :].view(np.uint64)) <= radius)
                    left += lo
                    if y is None:
                        left, right = left[left < right], right[left < right]
                    differ = fx[left] ^ fy[right]
                    first = np.ones(len(differ), bool)
                    for k in set(range(j)) - {i}:
                        first &= differ & masks[k] != 0
                    if first.any():
                        ends = x.field("id").take(pa.array(left[first])), (x if y is None else y).field("id").take(pa.array(right[first]))
                        found.append(pa.RecordBatch.from_arrays([*ends, pa.array(np.bitwise_count(differ[first].view(np.uint64)).astype(np.int64))], names=["x", "y", "distance"]))
                        rows += len(ends[0])
                    if rows >= 1 << 16:
                        yield from pa.Table.from_batches(found).combine_chunks().to_batches()
                        found, rows = [], 0
            if found:
                yield from pa.Table.from_batches(found).combine_chunks().to_batches()

    kind = one.schema["id"].dataType.simpleString()
    return pairs.mapInArrow(compare, f"x {kind}, y {kind}, distance bigint").where("x <> y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"), "distance")


def exact_and_near(rows: DataFrame, key: str, digest: str, fp: str, order: Sequence[Column], radius: int, components) -> DataFrame:
    """(key, reason): exact_lower_priority for what is not its digest's first by order, near_duplicate for what is not the first of a component of fingerprints
    within the radius (3 at most), null for what stays. components gives (node, component) of edges (u, v)."""
    first = F.struct(*[o.alias(f"o{i}") for i, o in enumerate(order)])
    ranked = rows.select(key, digest, fp, first.alias("_o"))
    kept = ranked.groupBy(digest).agg(F.min_by(F.struct(key, fp, "_o"), "_o").alias("w")).select("w.*")
    # fingerprints are nodes, so copies of one are a component by themselves
    pairs = greedy_simhash(kept.select(F.col(fp).alias("id"), F.col(fp).alias("fp")), "fp", radius, "id").select(F.col("a").alias("u"), F.col("b").alias("v"))
    found = components(pairs)
    named = kept.join(found, kept[fp] == found["node"], "left").withColumn("_c", F.coalesce("component", F.col(fp)))
    keepers = named.groupBy("_c").agg(F.min_by(key, "_o").alias("_k"))
    near = named.join(keepers, "_c").select(key, F.when(F.col(key) != F.col("_k"), "near_duplicate").alias("_r"), F.lit(True).alias("_w"))
    return rows.select(key).join(near, key, "left").select(key, F.when(F.col("_w").isNull(), "exact_lower_priority").otherwise(F.col("_r")).alias("reason"))


def first_of(df: DataFrame, by: Sequence[str], order: Sequence[Column]) -> DataFrame:
    return df.withColumn("_r", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where("_r = 1").drop("_r")
