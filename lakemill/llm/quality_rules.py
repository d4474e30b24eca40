"""Quality rules with risk-controlled thresholds.

Base rules count words, symbols, repeated lines and repeated 3-word windows. On top of them, each rule of RULES rejects a document whose value
reaches a cutoff. Cutoffs come from labelled documents, for each stratum (language) and rule. The cutoffs of the grid are nested: a lower one rejects
all that a higher one does. They are tested from the highest down, each with the exact binomial tail P(Bin(n, alpha) <= false rejections) among
the n good documents that pass the base rules, at level delta / (strata x rules); the first failure ends the sequence. Since n is the same for all and
false rejections only grow, the tail grows too, and the cutoffs certified are those with a tail within the level (fixed-sequence testing needs no share for each cutoff; strata and
rules are corrected by Bonferroni). So with probability 1 - delta every chosen cutoff falsely rejects at most alpha of its
stratum's good documents, and all rules together at most alpha x rules. Of the certified cutoffs the one with the largest (bad documents rejected -
`cost` x good ones rejected) is taken, the higher of equals, and only where that is above 0. A stratum with too few labels certifies
nothing and rejects nothing beyond the base rules.

The bound needs independent trials, so a trial is a distinct text of a stratum: copies and repeated labels count once, and as good if any label says so.

DataFrame and SQL functions only; all counts stay inside a document's row or are aggregates with at most strata x rules x grid rows.

Cases: a null or empty text has no words and fails the base rules; a null stratum is one of its own; labels without a document, or null, are
not used; a label is that of all rows that share its id; repeated rows are judged each; extra columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .shared import row_key, written

#: name: value of a document between 0 and 1, from the counted columns; 0 without words.
RULES = {
    "symbols": "n_symbols / word_chars",
    "exclamations": "n_exclaims / word_chars",
    "bars": "n_bars / n_words",
    "repeats": "n_repeat_words / n_words",
    "repeated_lines": "n_dup_lines / n_lines",
}
GRID = 50

_SPACE = r"[\\x20\\x09-\\x0D]+"
#: Starts of the 3-word windows w[i..i+2] as (hash, i), sorted; a start whose neighbour has its hash is a window found twice or more.
_REPEATS = """IF(size(w) < 3, 0L, transform(array(sort_array(transform(sequence(0, size(w) - 3), i -> struct(xxhash64(w[i], w[i + 1], w[i + 2]) AS h, i AS i)))), s ->
  CAST(size(array_distinct(flatten(transform(filter(transform(s, (x, j) -> IF((j > 0 AND s[greatest(j - 1, 0)].h = x.h) OR (j < size(s) - 1 AND s[least(j + 1, size(s) - 1)].h = x.h), x.i, -1)), p -> p >= 0), p -> array(p, p + 1, p + 2))))) AS BIGINT))[0])"""


def counted(documents: DataFrame, key: str = "doc_id", text: str = "text", stratum: str = "lang") -> DataFrame:
    """(doc_id, ra, rb, ta, tb, stratum, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_lines, n_exclaims, n_bars): ra, rb name the row, ta, tb its text."""
    t = F.coalesce(F.col(text), F.lit(""))
    (ra, rb), (ta, tb) = row_key(key, text, stratum), row_key(text)
    base = documents.select(F.col(key).alias("doc_id"), ra.alias("ra"), rb.alias("rb"), ta.alias("ta"), tb.alias("tb"), F.col(stratum).cast("string").alias("stratum"), t.alias("t"))
    worded = "filter(split(t, '\\\\n', -1), x -> rlike(x, '[^\\\\x20\\\\x09-\\\\x0D]'))"
    without = lambda chars: f"CAST(length(t) - length(translate(t, '{chars}', '')) AS BIGINT)"
    names = ["doc_id", "ra", "rb", "ta", "tb", "stratum"]
    return base.select(
        *names,
        F.expr(f"transform(array(filter(split(t, '{_SPACE}'), x -> x <> '')), w -> struct(CAST(size(w) AS BIGINT) AS n_words, {_REPEATS} AS n_repeat_words))[0]").alias("w"),
        F.length(F.translate("t", " \t\n\x0b\x0c\r", "")).cast("bigint").alias("word_chars"),
        F.expr(without("#*$%&|<>")).alias("n_symbols"),
        F.expr(f"transform(array({worded}), l -> struct(CAST(size(l) - size(array_distinct(l)) AS BIGINT) AS n_dup_lines, CAST(size(l) AS BIGINT) AS n_lines))[0]").alias("l"),
        F.expr(without("!")).alias("n_exclaims"),
        F.expr(without("|")).alias("n_bars"),
    ).select(*names, "w.n_words", "word_chars", "n_symbols", "l.n_dup_lines", "w.n_repeat_words", "l.n_lines", "n_exclaims", "n_bars")


def base_failed() -> Column:
    return F.expr("n_words < 50 OR 100 * n_repeat_words > 50 * n_words")


def _bins() -> Column:
    """(rule, bin) of a document: the highest cutoff bin / GRID that its value reaches."""
    return F.array(*[F.struct(F.lit(name).alias("rule"), F.expr(f"CAST(least({GRID}, floor(coalesce(try_divide({GRID} * {value.split(' / ')[0]}, {value.split(' / ')[1]}), 0))) AS INT)").alias("bin")) for name, value in RULES.items()])


def cutoffs(counts: DataFrame, labels: DataFrame, alpha: float = 0.01, delta: float = 0.05, cost: float = 20.0, key: str = "doc_id", label: str = "quality") -> DataFrame:
    """(stratum, rule, cutoff): the chosen bins, for strata and rules that have one."""
    held = counts.where(~base_failed()).join(labels.where(F.col(label).isNotNull()).select(F.col(key).alias("doc_id"), (F.col(label) > 0).alias("good")).hint("merge"), "doc_id")
    trials = held.groupBy("stratum", "ta", "tb").agg(F.max("good").alias("good"), F.min(_bins()).alias("bins"))
    tallied = written(trials.select("stratum", "good", F.explode("bins").alias("x")).groupBy("stratum", "x.rule", "x.bin").agg(F.count(F.when(F.col("good"), 1)).alias("good"), F.count(F.when(~F.col("good"), 1)).alias("bad")), "tallied")
    strata = max(1, tallied.select("stratum").distinct().count())
    down = Window.partitionBy("stratum", "rule").orderBy(F.desc("bin"))
    whole = Window.partitionBy("stratum", "rule")
    at = tallied.select("stratum", "rule", "bin", F.sum("good").over(down).alias("lost"), F.sum("bad").over(down).alias("caught"), F.sum("good").over(whole).alias("n")).where("bin > 0")
    # ln of each term of the tail by the ratio to the term before, summed by log-sum-exp
    tail = F.expr(f"aggregate(sequence(0L, lost), struct(n * ln(1 - {alpha}D) AS term, CAST(0 AS DOUBLE) AS total), (s, i) -> struct(s.term + IF(i < n, ln((n - i) / (i + 1D)) + ln({alpha}D / (1 - {alpha}D)), 0D) AS term, s.total + exp(s.term) AS total), s -> s.total)")
    sound = at.where("n > 0").withColumn("tail", tail).where(F.expr(f"tail <= {delta}D / {strata * len(RULES)}")).withColumn("gain", F.expr(f"caught - {cost}D * lost")).where("gain > 0")
    best = sound.groupBy("stratum", "rule").agg(F.max(F.struct("gain", "bin")).alias("x"))
    return best.select("stratum", "rule", F.col("x.bin").alias("cutoff"))


def quality_rules(documents: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", stratum: str = "lang", label: str = "quality", **control: float) -> DataFrame:
    """(doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, rejected_by, ra, rb); ra, rb are row_key(key, text, stratum)."""
    counts = written(counted(documents, key, text, stratum), "counted")
    chosen = cutoffs(counts, labels, key=key, label=label, **control)
    per = chosen.groupBy("stratum").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("rule", "cutoff")))).alias("limits"))
    judged = counts.withColumn("base_failed", base_failed()).withColumn("_bins", _bins())
    # one row a stratum, its map as long as RULES
    at = judged.join(F.broadcast(per.withColumnRenamed("stratum", "_s")), F.col("stratum").eqNullSafe(F.col("_s")), "left")
    hit = F.expr("transform(filter(_bins, x -> x.bin >= try_element_at(limits, x.rule)), x -> x.rule)")
    return at.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", F.when(F.col("base_failed"), False).otherwise(F.coalesce(F.size(hit), F.lit(0)) <= 0).alias("kept"), F.when(F.col("base_failed"), F.array(F.lit("base"))).otherwise(F.coalesce(hit, F.array().cast("array<string>"))).alias("rejected_by"), "ra", "rb")
