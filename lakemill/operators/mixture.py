"""Plans of mixtures, what they promise and what there is, and documents chosen for long contexts."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .select import hamilton, running


def planned_counts(weights: Sequence[float], total: int) -> list[int]:
    """Whole counts in proportion to the weights: floors, then one more for the largest remainders, the earlier of equals first."""
    whole = sum(weights)
    raw = [w / whole * total for w in weights]
    counts = [int(x) for x in raw]
    for i in sorted(range(len(raw)), key=lambda i: counts[i] - raw[i])[: total - sum(counts)]:
        counts[i] += 1
    return counts


def filled_counts(planned: Mapping[str, int], have: Mapping[str, int], buckets: Mapping[str, str]) -> dict[str, int]:
    """What each source gives: its own plan as far as it goes; what it lacks comes from the others of its bucket, in order of the plan."""
    given = {s: min(n, have.get(s, 0)) for s, n in planned.items()}
    for source, n in planned.items():
        lack = n - min(n, have.get(source, 0))
        for other in planned:
            if lack and buckets.get(source) and buckets.get(other) == buckets[source]:
                more = min(lack, have.get(other, 0) - given[other])
                given[other] += more
                lack -= more
    return given


def weighted_mixture(rows: DataFrame, weights: Mapping[str, float], total: int, buckets: Mapping[str, str], source: str = "source", key: str = "doc_id", span: Column | None = None) -> DataFrame:
    """rows of each source in order of key, as many as it gives to the mixture; the plan is made on one number a source."""
    have = {r[source]: r["n"] for r in rows.groupBy(source).agg(F.count("*").alias("n")).collect()}
    given = filled_counts(dict(zip(weights, planned_counts(list(weights.values()), total))), have, buckets)
    quota = F.create_map(*[F.lit(x) for s, n in given.items() for x in (s, n)])
    ranked = running(rows.where(F.col(source).isin(*given)).withColumn("_one", F.lit(1)), [source], [key], "_one", "_before", "_after", span)
    return ranked.where(F.col("_after") <= quota[F.col(source)]).drop("_one", "_before", "_after")


def plan_errors(sources: DataFrame, buckets: DataFrame, expected: int, most_share: float, bucket: str = "bucket", source: str = "source", tokens: str = "tokens", dataset: str = "dataset") -> DataFrame:
    """(error, name, found, wanted): buckets whose sources don't add up to them, buckets that don't add up to the target, buckets without a fallback of
    their own, and data sets over their share."""
    of_bucket = sources.groupBy(bucket).agg(F.sum(tokens).alias("found"))
    off = buckets.join(of_bucket, bucket, "left").select(F.lit("bucket_sum").alias("error"), F.col(bucket).alias("name"), F.coalesce("found", F.lit(0)).cast("bigint").alias("found"), F.col(tokens).cast("bigint").alias("wanted")).where("found <> wanted")
    whole = buckets.agg(F.coalesce(F.sum(tokens), F.lit(0)).cast("bigint").alias("found")).select(F.lit("target").alias("error"), F.lit("all").alias("name"), "found", F.lit(expected).cast("bigint").alias("wanted")).where("found <> wanted")
    loose = buckets.where("NOT coalesce(same_bucket_only, false)").select(F.lit("fallback").alias("error"), F.col(bucket).alias("name"), F.lit(0).cast("bigint").alias("found"), F.lit(1).cast("bigint").alias("wanted"))
    large = sources.groupBy(dataset).agg(F.sum(tokens).cast("bigint").alias("found")).where(F.col("found") > expected * (most_share + 1e-9)).select(F.lit("share").alias("error"), F.col(dataset).alias("name"), "found", F.floor(F.lit(expected * most_share)).cast("bigint").alias("wanted"))
    return off.unionByName(whole).unionByName(loose).unionByName(large)


def replacement_errors(groups: DataFrame, sources: DataFrame, source: str = "id") -> DataFrame:
    """(error, name, group) of a replacement policy of (id, members, donors, self_reserve): sources unknown, named twice or left out, groups without
    members or donors, sources without a compatible donor (same category and freshness) or a reserve of their own, and reserves that aren't declared."""
    s = sources.select(F.col(source).alias("name"), "category", "fresh", "reserve")
    members = groups.select(F.col("id").alias("group"), "self_reserve", "donors", F.explode("members").alias("name"))
    donors = groups.select(F.col("id").alias("group"), F.explode("donors").alias("name"))
    fields = ["error", "name", "group"]
    named = lambda df, error: df.select(F.lit(error).alias("error"), "name", "group")
    empty = lambda c, error: groups.where(F.size(c) == 0).select(F.lit(error).alias("error"), F.lit(None).cast("string").alias("name"), F.col("id").alias("group"))
    twice = members.groupBy("name").agg(F.count("*").alias("n"), F.max("group").alias("group")).where("n > 1")
    known = members.join(s, "name")
    other = s.select(F.col("name").alias("_d"), F.col("category").alias("_c"), F.col("fresh").alias("_f"))
    fits = known.select("name", "category", "fresh", F.explode("donors").alias("_d")).join(other, "_d").where("_d <> name AND _c = category AND _f = fresh").select("name").distinct()
    lonely = known.where("NOT self_reserve").join(fits, "name", "left_anti")
    parts = [
        named(members.join(s, "name", "left_anti"), "unknown_member"),
        named(twice, "repeated_member"),
        named(donors.join(s, "name", "left_anti"), "unknown_donor"),
        empty("members", "no_members"),
        empty("donors", "no_donors"),
        named(known.where("self_reserve AND NOT reserve"), "missing_reserve"),
        named(lonely, "no_compatible_donor"),
        named(s.join(members, "name", "left_anti").withColumn("group", F.lit(None).cast("string")), "omitted"),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.select(*fields)


# Roles of files that hold an index and no text, and bytes to a token where nothing better is known.
INDEX_ROLES = ["source_index", "metadata_index", "retrieval_index"]
BYTES_TO_TOKEN = 4


def candidate_estimates(receipts: DataFrame, children: str = "files") -> DataFrame:
    """(source_id, tokens, estimator): one conservative estimate for each output of receipts with kind, payload_role, source_id, candidate_token_estimate,
    estimated_tokens, text_bytes and an array of the same under `children`. Indexes count nothing; a wrapped data set counts once, not again by its shards."""
    estimate = F.coalesce("candidate_token_estimate", "estimated_tokens", F.expr(f"text_bytes DIV {BYTES_TO_TOKEN}"))
    how = F.when(F.col("candidate_token_estimate").isNotNull(), "candidate_token_estimate").when(F.col("estimated_tokens").isNotNull(), "estimated_tokens").otherwise("text_bytes")
    level, out = receipts, None
    while level is not None:
        live = level.where(~F.coalesce("payload_role", F.lit("")).isin(*INDEX_ROLES)).withColumn("_n", estimate)
        told = F.col("_n").isNotNull() & (F.coalesce("source_id", F.lit("")) != "")
        here = live.where(told).select("source_id", F.greatest(F.col("_n"), F.lit(0)).cast("bigint").alias("tokens"), how.alias("estimator"))
        out = here if out is None else out.unionByName(here)
        wrapped = told & (F.coalesce("kind", F.lit("")) == "materialized_dataset")
        level = live.where(~wrapped).select(F.explode(children).alias("_c")).select("_c.*") if children in level.columns else None
    return out


def target_report(targets: DataFrame, actual: DataFrame, source: str = "source", category: str = "category") -> tuple[DataFrame, DataFrame]:
    """Per source and per category (target, tokens, target_met); sources without tokens have 0."""
    each = targets.join(actual.select(source, "tokens"), source, "left").withColumn("tokens", F.coalesce("tokens", F.lit(0)).cast("bigint")).withColumn("target_met", F.col("tokens") >= F.col("target"))
    sums = each.groupBy(category).agg(F.sum("target").cast("bigint").alias("target"), F.sum("tokens").cast("bigint").alias("tokens")).withColumn("target_met", F.col("tokens") >= F.col("target"))
    return each, sums


def recount(rows: DataFrame, opted: DataFrame, key: str, text: str, by: str) -> DataFrame:
    """(by, kept_tokens, removed_tokens, removed_records) against a policy of opted-out keys: a token is four bytes of text, one at least."""
    out = rows.join(opted.select(key).distinct().withColumn("_out", F.lit(True)), key, "left")
    n, gone = F.greatest(F.lit(1), F.floor(F.octet_length(text) / BYTES_TO_TOKEN)).cast("bigint"), F.coalesce("_out", F.lit(False))
    return out.groupBy(by).agg(F.sum(F.when(gone, 0).otherwise(n)).alias("kept_tokens"), F.sum(F.when(gone, n).otherwise(0)).alias("removed_tokens"), F.count(F.when(gone, 1)).alias("removed_records"))


def lane_quotas(gates: DataFrame, mix: Mapping[str, int], source: str = "source", gate: str = "gate", tokens: str = "tokens") -> DataFrame:
    """(gate, lane, source, tokens): each gate's total in lanes by the mix, each lane's in sources by their share of the gate; both exactly."""
    lanes = gates.sparkSession.createDataFrame(list(mix.items()), "lane string, weight bigint")
    totals = {r[gate]: int(r["n"]) for r in gates.groupBy(gate).agg(F.sum(tokens).alias("n")).collect()}
    out = None
    for g, total in sorted(totals.items()):
        of = {r["lane"]: int(r["share"]) for r in hamilton(lanes, total, "lane", "weight").collect()}
        for lane, n in sorted(of.items()):
            one = hamilton(gates.where((F.col(gate) == g) & (F.col(tokens) > 0)).select(source, tokens), n, source, tokens).select(F.lit(g).alias(gate), F.lit(lane).alias("lane"), source, F.col("share").alias("tokens"))
            out = one if out is None else out.unionByName(one)
    return out


def reconciled(capacity: DataFrame, demand: DataFrame, on: Sequence[str]) -> DataFrame:
    """Routes whose capacity is not their demand; none in a sound plan."""
    both = capacity.groupBy(*on).agg(F.sum("tokens").alias("capacity")).join(demand.groupBy(*on).agg(F.sum("tokens").alias("demand")), list(on), "full_outer")
    return both.select(*on, F.coalesce("capacity", F.lit(0)).cast("bigint").alias("capacity"), F.coalesce("demand", F.lit(0)).cast("bigint").alias("demand")).where("capacity <> demand")


def context_selection(docs: DataFrame, quotas: DataFrame, least_long: int, least_score: int, evaluation: int, evaluation_tokens: int, source: str = "source", key: str = "doc_id", span: Column | None = None) -> DataFrame:
    """(key, source, lane, token_start, token_count) from (key, source, tokens, score): in order of key, long and structured documents fill their source's quota
    of the lane `long`, what is left of all documents that of `short`, and of what is left then, the first `evaluation` long ones of each source give
    a slice of evaluation_tokens to the lane `evaluation`; no token is taken twice."""
    rows = docs.withColumn("_long", (F.col("tokens") >= least_long) & (F.col("score") >= least_score))
    lane = lambda name, c: quotas.where(F.col("lane") == name).groupBy(source).agg(F.sum("tokens").alias(c))
    # one row a source
    rows = rows.join(F.broadcast(lane("long", "_ql")), source, "left").join(F.broadcast(lane("short", "_qs")), source, "left")
    quota = lambda c: F.coalesce(c, F.lit(0)).cast("bigint")
    taken = lambda a, b, q: F.greatest(F.lit(0), F.least(F.col(b), quota(q)) - F.least(F.col(a), quota(q))).cast("bigint")
    first = running(rows.withColumn("_n", F.when(F.col("_long"), F.col("tokens")).otherwise(0).cast("bigint")), [source], [key], "_n", "_a", "_b", span).withColumn("_l", taken("_a", "_b", "_ql"))
    second = running(first.withColumn("_r", (F.col("tokens") - F.col("_l")).cast("bigint")), [source], [key], "_r", "_c", "_d", span).withColumn("_s", taken("_c", "_d", "_qs"))
    free = second.withColumn("_used", F.col("_l") + F.col("_s")).withColumn("_e", (F.col("_long") & (F.col("tokens") - F.col("_used") >= evaluation_tokens)).cast("bigint"))
    third = running(free, [source], [key], "_e", "_f", "_g", span)
    slices = F.array(
        F.struct(F.lit("long").alias("lane"), F.lit(0).cast("bigint").alias("token_start"), F.col("_l").alias("token_count")),
        F.struct(F.lit("short").alias("lane"), F.col("_l").alias("token_start"), F.col("_s").alias("token_count")),
        F.struct(F.lit("evaluation").alias("lane"), F.col("_used").alias("token_start"), F.when((F.col("_e") == 1) & (F.col("_g") <= evaluation), evaluation_tokens).otherwise(0).cast("bigint").alias("token_count")),
    )
    return third.select(key, source, F.explode(slices).alias("x")).select(key, source, "x.*").where("token_count > 0")


def pack_checks(slices: DataFrame, tokens: DataFrame, evaluation_tokens: int, key: str = "doc_id") -> DataFrame:
    """(check, failures) of chosen slices: each within its document, no two of a document overlapping, evaluation slices of exact length and distinct."""
    inside = slices.join(tokens.select(key, "tokens"), key, "left").where(F.col("tokens").isNull() | (F.col("token_start") < 0) | (F.col("token_start") + F.col("token_count") > F.col("tokens")))
    order = Window.partitionBy(key).orderBy("token_start", "token_count")
    crossed = slices.withColumn("_e", F.lag(F.col("token_start") + F.col("token_count")).over(order)).where(F.col("token_start") < F.col("_e"))
    exams = slices.where("lane = 'evaluation'")
    twice = exams.groupBy(key, "token_start").agg(F.count("*").alias("n")).where("n > 1")
    count = lambda df, name: df.agg(F.count("*").alias("failures")).select(F.lit(name).alias("check"), "failures")
    return count(inside, "inside").unionByName(count(crossed, "disjoint")).unionByName(count(exams.where(F.col("token_count") != evaluation_tokens), "exact")).unionByName(count(twice, "distinct"))


def chunk_starts(rows: DataFrame, group: str, key: str, start: str = "token_start", count: str = "token_count") -> DataFrame:
    """rows with begins: whether a slice begins a sequence, because the one before it in its group is not what comes before it in its document."""
    order = Window.partitionBy(group).orderBy(key, start)
    before = F.lag(F.struct(F.col(key), (F.col(start) + F.col(count)).alias(start))).over(order)
    return rows.withColumn("begins", ~before.eqNullSafe(F.struct(F.col(key), F.col(start))))


def eligible_chunks(chunks: DataFrame, completed: DataFrame, object_id: str = "object_id") -> DataFrame:
    """Chunks that were published before their object's end count only when the object is complete, with as many chunks as it says."""
    seen = chunks.groupBy(object_id).agg(F.count_distinct("chunk_index").alias("_n"))
    whole = completed.join(seen, object_id).where("_n = chunks").select(object_id)
    return chunks.join(whole, object_id, "left_semi").dropDuplicates([object_id, "chunk_index"])
