"""Line dedup: a suffix array over the lines of all documents by distributed prefix doubling, and its intervals of common prefixes.

A document is the sequence of its lines that hold a word (split at \\n); a line's ID is its hash of 128 bits (XXH64 with two seeds). Suffixes are
the places in those sequences, ordered by IDs:

1. Round 0 ranks places by their line, round k by their first 2^k lines: the pair of ranks that a place and the one 2^(k-1) lines on had
   in the round before. Ranks come from sorting the distinct pairs by ranges, so they are in order but not dense, and no task sorts all.
2. Places that share a rank are an interval of the suffix array whose common prefix is 2^k lines or more. Only intervals of two places or
   more go on, so a round holds the places whose 2^k lines occur elsewhere too, and rounds end when there are none: as many as the longest
   repeated run has doublings. For `min_lines` between two powers of two, one more grouping of overlapping pairs gives the intervals of just that length.
3. In each interval the first place (smallest key, then row key, then place) stays. Every other place is covered as far as its last round
   reached; a repeated run between two powers of two is covered by the window at its start and the one at its end, both later copies.
   So the union of the windows of `min_lines` lines or more is the union of all maximal repeated runs with an earlier copy; those lines are deleted.
   With `passage_words`, a line of so many words or more (parted by ASCII white space) counts as a run by itself.

DataFrame and SQL functions only; each round is a written table. Joins are sort-merge joins, because the tables grow with the corpus and their
compressed files look small enough to broadcast; places are dealt by row and place, so a long document is many keys, and adaptive
execution splits the places of a hot line. Counts are partial sums before each shuffle; only the windows of one document are gathered.

Cases: a null text stays null and has no lines; an empty text, or one of blank lines, stays as it is; blank lines are never deleted and
don't part a run; copies inside a document count; rows are told apart by key and text, so rows that share a key, or have none, are documents of their
own, in order of a hash of their texts, while rows alike in key and text are one document, whose copies stay or go together; documents
that lose all lines keep the blank ones, or become empty. Extra columns stay, whatever their names, but n_lines, n_removed and n_runs are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .shared import drop, row_key, written

_HAS = "rlike({}, '[^\\\\x20\\\\x09-\\\\x0D]')"
_LINES = f"filter(split(text, '\\\\n', -1), x -> {_HAS.format('x')})"
#: Words of a line that is a passage by itself, as the pipeline takes it.
PASSAGE_WORDS = 50
_ROW = ["ra", "rb"]


def line_names(documents: DataFrame, key: str = "doc_id", text: str = "text", passage_words: int | None = None) -> DataFrame:
    """(k, ra, rb, pos, a, b, alone): ID of every line with a word; alone if it has passage_words or more."""
    long = "false" if passage_words is None else f"size(filter(split(x, '[\\\\x20\\\\x09-\\\\x0D]+'), w -> w <> '')) >= {passage_words}"
    if passage_words is not None:
        # words are counted only in lines that have room for them
        long = f"IF(length(x) < {2 * passage_words - 1}, false, {long})"
    ra, rb = row_key(key, text)
    rows = documents.select(F.col(key).alias("k"), ra.alias("ra"), rb.alias("rb"), F.col(text).alias("text")).where("text IS NOT NULL")
    each = rows.select("k", "ra", "rb", F.expr(f"transform({_LINES}, x -> struct(xxhash64(1, x) AS a, xxhash64(2, x) AS b, {long} AS alone))").alias("l"))
    return each.select("k", "ra", "rb", F.posexplode("l").alias("pos", "x")).select("k", "ra", "rb", "pos", "x.a", "x.b", "x.alone")


def _place() -> Column:
    return F.struct("k", "ra", "rb", "pos")


def _intervals(places: DataFrame, on: list[str], name: str) -> DataFrame:
    """(*on, rank, first) of the values that come twice or more, ranks in their order."""
    found = places.groupBy(*on).agg(F.count("*").alias("n"), F.min(_place()).alias("first")).where("n > 1")
    # ordered by ranges: the numbers of partitions and rows are in the order of the pairs
    return written(found.repartitionByRange(*on).sortWithinPartitions(*on).select(*on, F.monotonically_increasing_id().alias("rank"), "first"), name)


def _ranked(places: DataFrame, intervals: DataFrame, on: list[str], *more: str) -> DataFrame:
    """places of the intervals: (k, ra, rb, pos, rank, later, *more)."""
    return places.join(intervals.hint("merge"), on).select("k", "ra", "rb", "pos", "rank", (~_place().eqNullSafe(F.col("first"))).alias("later"), *more)


def _pairs(ranks: DataFrame, ahead: int) -> DataFrame:
    """places with their rank r and that of the place `ahead` lines on, s; places without one there occur once as longer runs."""
    other = ranks.select("ra", "rb", (F.col("pos") - ahead).alias("pos"), F.col("rank").alias("s"))
    return ranks.withColumnRenamed("rank", "r").drop("later").join(other.hint("merge"), [*_ROW, "pos"])


def rounds(documents: DataFrame, min_lines: int = 2, key: str = "doc_id", text: str = "text", passage_words: int | None = None) -> list[tuple[int, DataFrame]]:
    """(length, places) by rising length: the places whose `length` lines occur elsewhere too, with rank and whether they are later copies.

    Lengths are the powers of two up to the longest repeated run's, and min_lines.
    """
    if min_lines < 1:
        raise ValueError("min_lines is at least 1")
    names = written(line_names(documents, key, text, passage_words), "line-names")
    lines = _intervals(names, ["a", "b"], "line-intervals")
    # rows alike in key and text are one document: their places come once from here on
    ranks = written(_ranked(names, lines, ["a", "b"], "alone").distinct(), "suffix-ranks")
    drop(names, lines)
    out, length = [(1, ranks)], 1
    while not ranks.isEmpty():
        if length < min_lines < 2 * length:
            some = _pairs(ranks, min_lines - length)
            exact = _intervals(some, ["r", "s"], "run-intervals")
            out.append((min_lines, written(_ranked(some, exact, ["r", "s"]), "suffix-ranks")))
            drop(exact)
        pairs = written(_pairs(ranks, length), "rank-pairs")
        intervals = _intervals(pairs, ["r", "s"], "run-intervals")
        ranks = written(_ranked(pairs, intervals, ["r", "s"]), "suffix-ranks")
        drop(pairs, intervals)
        length *= 2
        out.append((length, ranks))
    return out


def later_copies(documents: DataFrame, min_lines: int = 2, key: str = "doc_id", text: str = "text", passage_words: int | None = None) -> DataFrame:
    """(ra, rb, gone): the places of deleted lines, among lines with a word, sorted; rows without any are left out."""
    found = rounds(documents, min_lines, key, text, passage_words)
    windows = []
    for length, places in found:
        if length >= min_lines:
            windows.append(places.where("later").select(*_ROW, "pos", F.lit(length).alias("length")))
        elif length == 1 and passage_words is not None:
            windows.append(places.where("later AND alone").select(*_ROW, "pos", F.lit(1).alias("length")))
    every = found[0][1].where("false").select(*_ROW, "pos", F.lit(1).alias("length"))
    for w in windows:
        every = every.unionByName(w)
    # each window adds the places past the end of those before it; of those that start at a place the longest comes first
    before = Window.partitionBy(*_ROW).orderBy("pos", F.desc("length")).rowsBetween(Window.unboundedPreceding, -1)
    added = every.withColumn("to", F.col("pos") + F.col("length")).withColumn("reach", F.coalesce(F.max("to").over(before), F.lit(0))).where("to > reach")
    gone = added.groupBy(*_ROW).agg(F.sort_array(F.flatten(F.collect_list(F.sequence(F.greatest("reach", "pos"), F.col("to") - 1)))).alias("gone"))
    out = written(gone, "deleted-lines")
    drop(*(places for _, places in found))
    return out


def line_dedup(documents: DataFrame, min_lines: int = 2, key: str = "doc_id", text: str = "text", passage_words: int | None = None) -> DataFrame:
    """documents with later copies of repeated runs deleted from the text, and n_lines, n_removed, n_runs (maximal deleted runs).

    Those three names replace columns of the same name.
    """
    gone = later_copies(documents, min_lines, key, text, passage_words).select(F.col("ra").alias("ga"), F.col("rb").alias("gb"), "gone")
    ra, rb = row_key(key, text)
    # the row as one column, so that no name of its columns can clash
    rows = documents.select(F.struct(*[F.col(f"`{c}`") for c in documents.columns]).alias("row"), F.col(text).alias("t"), ra.alias("ra"), rb.alias("rb"))
    joined = rows.join(gone.hint("merge"), (F.col("ra") == F.col("ga")) & (F.col("rb") == F.col("gb")), "left")
    places = f"filter(sequence(0, size(l) - 1), i -> {_HAS.format('l[i]')})"
    # l: the lines, p: the places of those with a word; each is bound once by a one-element array
    cut = f"transform(array(split(t, '\\\\n', -1)), l -> transform(array({places}), p -> array_join(transform(array_except(sequence(0, size(l) - 1), transform(gone, g -> p[g])), i -> l[i]), '\n'))[0])[0]"
    made = {
        "n_lines": f"IF(t IS NULL, 0L, CAST(size({_LINES.replace('text', 't')}) AS BIGINT))",
        "n_removed": "CAST(coalesce(size(gone), 0) AS BIGINT)",
        "n_runs": "CAST(coalesce(size(filter(gone, (g, i) -> i = 0 OR gone[i - 1] <> g - 1)), 0) AS BIGINT)",
    }
    kept = [F.expr(f"IF(gone IS NULL OR t IS NULL, t, {cut})").alias(c) if c == text else F.col("row")[c].alias(c) for c in documents.columns if c not in made]
    return joined.select(*kept, *[F.expr(x).alias(name) for name, x in made.items()])
