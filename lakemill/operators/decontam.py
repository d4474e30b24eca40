"""Benchmark decontamination against holdout groups: exact, contiguous run, n-gram, code, skeleton and short n-gram rules.

A document's grams are hashed once, in order, and meet the postings of the holdouts in one join; only what matches is written, and all rules are
counted from that table. Postings are broadcast up to a checked number; beyond it the join shuffles.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import text as T
from .evidence import CODE_TOKEN, looks_like_code, skeleton
from .graph import cut

#: The postings are broadcast only up to this many; beyond it the join shuffles.
MOST_BROADCAST = 2_000_000
# Length of each family's grams, the least that have to match, holdouts that may share a gram, and the least run.
FAMILIES = {"ngram": (13, 2), "code_ngram": (12, 8), "code_skeleton_ngram": (16, 12), "short_ngram": (8, 2)}
MOST_GROUPS, LEAST_RUN, SHARE = 32, 8, 0.002
REASONS = ["exact", "contiguous_run", "ngram", "code_ngram", "code_skeleton_ngram", "short_ngram"]


def ngrams(text: Column, n: int) -> Column:
    """Digests of every run of n lower-cased words, in order."""
    words = F.transform(T.found(text, T.WORD), F.lower)
    return F.transform(T.windows(words, n), lambda w: F.md5(F.array_join(w, " ").cast("binary")))


def hashed(tokens: Column, n: int) -> Column:
    """64-bit hashes of every run of n tokens, in order."""
    return F.transform(T.windows(tokens, n), lambda w: F.xxhash64(w))


def grams(text: Column, families: Sequence[str]) -> dict[str, Column]:
    """The hashed grams of each family; code families have none where the text does not look like code."""
    words, code = F.transform(T.found(text, T.WORD), F.lower), looks_like_code(text)
    none = F.array().cast("array<bigint>")
    tokens = {"ngram": words, "short_ngram": words, "code_ngram": T.found(text, CODE_TOKEN), "code_skeleton_ngram": skeleton(text)}
    each = {f: hashed(tokens[f], FAMILIES[f][0]) for f in families}
    return {f: F.when(code, g).otherwise(none) if f.startswith("code") else g for f, g in each.items()}


def _exploded(rows: DataFrame, key: str, text: str, families: Sequence[str]) -> DataFrame:
    """(key, family, total, pos, gram): total is the number of distinct grams of the family."""
    kinds = F.array(*[F.struct(F.lit(f).alias("family"), g.alias("grams")) for f, g in grams(F.col(text), families).items()])
    some = rows.select(key, F.explode(kinds).alias("f")).where("size(f.grams) > 0")
    return some.select(key, "f.family", F.size(F.array_distinct("f.grams")).alias("total"), F.posexplode("f.grams").alias("pos", "gram"))


def index(holdouts: DataFrame, families: Sequence[str] = ("ngram",), most_groups: int = MOST_GROUPS, group: str = "item_id", text: str = "text") -> DataFrame:
    """(family, gram, group) of grams that at most most_groups holdouts hold, as a table."""
    each = _exploded(holdouts, group, text, families).select("family", "gram", F.col(group).alias("group")).distinct()
    common = each.groupBy("family", "gram").agg(F.count("*").alias("k")).where(F.col("k") <= most_groups).select("family", "gram")
    return cut(each.join(common, ["family", "gram"], "left_semi"))


def hits(docs: DataFrame, postings: DataFrame, families: Sequence[str] = ("ngram",), key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, family, total, pos, gram, group) of every gram that a document shares with a holdout group, as a table."""
    small = F.broadcast(postings) if postings.count() <= MOST_BROADCAST else postings
    return cut(_exploded(docs, key, text, families).join(small, ["family", "gram"]))


def matches(found: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, family, group, total, n_grams): distinct shared grams of each document and holdout group."""
    return found.groupBy(key, "family", "group", "total").agg(F.count_distinct("gram").alias("n_grams"))


def runs(found: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, group, run): the most grams in a row that a document shares with one holdout group."""
    places = found.where("family = 'ngram'").select(key, "group", "pos").distinct()
    island = F.col("pos") - F.row_number().over(Window.partitionBy(key, "group").orderBy("pos"))
    return places.withColumn("island", island).groupBy(key, "group", "island").agg(F.count("*").alias("n")).groupBy(key, "group").agg(F.max("n").alias("run"))


def contamination(docs: DataFrame, holdouts: DataFrame, families: Sequence[str] = tuple(FAMILIES), share: float = SHARE, least_run: int = LEAST_RUN, key: str = "doc_id", text: str = "text", group: str = "item_id") -> DataFrame:
    """(key, reason) of contaminated documents: the first of REASONS; a family counts if enough distinct grams are those of one holdout group, its least
    number or a share of the document's own. Families that are not given are not consulted; n-grams always are."""
    families = tuple(dict.fromkeys(("ngram", *families)))
    canonical = lambda: T.canonical(F.col(text))
    exact = docs.select(key, canonical().alias("c")).join(holdouts.select(canonical().alias("c")).where("c <> ''").distinct(), "c", "left_semi").select(key, F.lit(0).alias("rank"))
    found = hits(docs, index(holdouts, families, group=group, text=text), families, key, text)
    long = runs(found, key).where(F.col("run") >= least_run).select(key, F.lit(1).alias("rank"))
    least = F.create_map(*[F.lit(x) for f in families for x in (f, FAMILIES[f][1])])
    enough = matches(found, key).where(F.col("n_grams") >= F.greatest(least[F.col("family")], F.ceil(F.col("total") * share)))
    some = enough.select(key, (F.array_position(F.array(*map(F.lit, REASONS)), F.col("family")) - 1).cast("int").alias("rank"))
    return exact.union(long).union(some).groupBy(key).agg(F.min("rank").alias("rank")).select(key, F.get(F.array(*map(F.lit, REASONS)), F.col("rank")).alias("reason"))


def genealogy_key(name: Column) -> Column:
    return F.regexp_replace(F.lower(name), "[^a-z0-9]+", "")
