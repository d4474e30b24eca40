"""Crawl gates, winners, opt-out, HTML extraction and byte ranges."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import urls as U
from .reasons import first_reason


# What a crawl's rows may be.
MIMES = ["text/html", "application/xhtml+xml", "text/plain"]
RANGE = {"least": 256, "most": 16 << 20}
MOST_URL = 2048


def gate_reason(crawl: str, allowed: Sequence[str] = (), denied: Sequence[str] = (), require_english: bool = True, categories: Sequence[str] = (), first_day: str | None = None, last_day: str | None = None, most_span: int = RANGE["most"], opted: Column | None = None) -> Column:
    """Why a row of a crawl index is left out, the first of 16 reasons. Over columns status, truncated, digest, mime_sent, mime_found, languages, url, offset,
    length, file, fetched (a timestamp) and suffix; opted is the reason of the opt-out policy for the captured address."""
    canonical = U.canonical_url(F.col("url"))
    inside = lambda domains: F.coalesce(*[F.when(U.in_domain(U.host(F.col("url")), F.lit(d)), True) for d in domains], F.lit(False))
    mime = lambda c: F.trim(F.lower(F.substring_index(F.coalesce(c, F.lit("")), ";", 1))).isin(*MIMES)
    digest = F.regexp_replace(F.lower(F.coalesce("digest", F.lit(""))), "^sha1:", "")
    languages = F.transform(F.split(F.lower(F.coalesce("languages", F.lit(""))), ","), lambda x: F.trim(x))
    rules = [
        ("http_status", F.coalesce("status", F.lit(0)) != 200),
        ("content_truncated", F.coalesce("truncated", F.lit("")) != ""),
        ("missing_or_invalid_digest", ~digest.rlike("^[a-z2-7]{32}$")),
        ("mime", ~mime(F.col("mime_sent")) & ~mime(F.col("mime_found"))),
    ]
    if require_english:
        rules.append(("language", ~F.array_contains(languages, "eng")))
    rules.append(("malformed_metadata", canonical.isNull()))
    if allowed:
        rules.append(("domain_not_allowed", ~inside(allowed)))
    if denied:
        rules.append(("domain_denied", inside(denied)))
    if opted is not None:
        rules += [(name, opted == name) for name in ("common_crawl_opt_out_domain", "common_crawl_opt_out_url")]
    rules += [
        ("url_pattern", (F.length(canonical) > MOST_URL) | canonical.rlike(U.REJECTED_PATH)),
        ("malformed_metadata", F.col("offset").isNull() | F.col("length").isNull()),
        ("range_bounds", (F.col("offset") < 0) | (F.col("length") < RANGE["least"]) | (F.col("length") > min(RANGE["most"], most_span))),
        ("warc_path", ~F.startswith(F.coalesce("file", F.lit("")), F.lit(f"crawl-data/{crawl}/")) | ~F.endswith(F.col("file"), F.lit(".warc.gz")) | F.array_contains(F.split("file", "/"), "..")),
        ("malformed_metadata", F.col("fetched").isNull()),
    ]
    day = F.date_format("fetched", "yyyy-MM-dd")
    if first_day is not None:
        rules.append(("capture_before_freshness_cutoff", day < first_day))
    if last_day is not None:
        rules.append(("capture_after_freshness_cutoff", day > last_day))
    if categories:
        rules.append(("route_category", ~U.category(canonical, F.col("suffix")).isin(*categories)))
    return first_reason(rules)


def gate_tallies(rows: DataFrame, reason: Column) -> DataFrame:
    """(reason, n) of the rows left out, and the number scanned under the reason scanned; the gates run in the scan's own code."""
    told = rows.select(reason.alias("reason"))
    return told.groupBy("reason").agg(F.count("*").alias("n")).where("reason IS NOT NULL").unionByName(told.agg(F.count("*").alias("n")).select(F.lit("scanned").alias("reason"), "n"))


def capture_winners(rows: DataFrame, url: str = "canonical", digest: str = "digest") -> DataFrame:
    """The best capture of each URL, then of those the best of each digest; both are aggregates with partial results."""
    order = F.struct(-F.col("priority"), F.col("length") < 1024, -F.col("epoch"), -F.col("length"), F.col("sample_hash"))

    def best(df: DataFrame, by: str) -> DataFrame:
        return df.groupBy(by).agg(F.min_by(F.struct(*[c for c in df.columns if c != by]), order).alias("_w")).select(by, "_w.*")

    return best(best(rows, url), digest)


def opt_out_rule(token: Column) -> Column:
    """struct(host, path, query, path_prefix, query_prefix) of one token of the opt-out registry, null if it is none: bullets and brackets off, a star
    in front of the host dropped, a star in path or query makes a prefix; the root without a query is a rule of the domain (path null)."""
    t = F.regexp_replace(F.regexp_replace(F.trim(F.regexp_replace(F.trim(token), "^[-*\u2022]+", "")), r"""^[<>()\[\]{}"']+|[<>()\[\]{}"']+$""", ""), "[.,;]+$", "")
    t = F.replace(F.replace(t, F.lit("\\."), F.lit(".")), F.lit("\\?"), F.lit("?"))
    whole = F.when(F.lower(t).rlike("^https?://"), t).otherwise(F.concat(F.lit("https://"), t))
    whole = F.regexp_replace(whole, r"^(https?://)\*\.", "$1")
    host, path, query = U.normal_host(whole), U.path(whole), U.query(whole)
    cut = lambda x: F.regexp_replace(F.substring_index(x, "*", 1), r"\$+$", "")
    own_path, own_query = U.normal_path(cut(path)), F.when(query != "", U.normal_query(cut(query), drop_tracking=False))
    domain = (own_path == "/") & own_query.isNull()
    rule = F.struct(host.alias("host"), F.when(~domain, own_path).alias("path"), own_query.alias("query"), F.contains(path, F.lit("*")).alias("path_prefix"), F.contains(query, F.lit("*")).alias("query_prefix"))
    return F.when((t != "") & ~F.contains(t, F.lit("@")) & host.isNotNull(), rule)


def opt_out_rules(registry: DataFrame, entries: str) -> DataFrame:
    """The rules of all tokens of a registry's entries, each once."""
    return registry.select(F.explode(F.split(entries, r"[,;\s]+")).alias("t")).select(opt_out_rule(F.col("t")).alias("r")).where("r IS NOT NULL").select("r.*").distinct()


def opt_out_reasons(urls: DataFrame, rules: DataFrame, key: str, url: str = "url") -> DataFrame:
    """(key, reason) of the addresses that a rule of their host, or of a domain above it, fits: common_crawl_opt_out_domain before common_crawl_opt_out_url.

    Hosts meet rules by an equal suffix, so no rule is compared with every page. A path rule fits its path and deeper ones, a prefix rule all that begin with it;
    a rule with a query fits that query, or all that begin with it.
    """
    u = F.col(url)
    hosts = urls.select(key, U.normal_path(U.path(u)).alias("p"), U.normal_query(U.query(u), drop_tracking=False).alias("q"), U.normal_host(u).alias("h")).where("h IS NOT NULL")
    each = hosts.select(key, "p", "q", F.explode(U.suffixes(F.col("h"))).alias("host"))
    met = each.join(rules, "host")
    path = F.col("path")
    under = F.when(F.col("path_prefix"), F.startswith("p", path)).otherwise((F.col("p") == path) | F.startswith(F.col("p"), F.concat(F.regexp_replace(path, "/+$", ""), F.lit("/"))))
    asked = F.col("query").isNull() | F.when(F.col("query_prefix"), F.startswith("q", F.col("query"))).otherwise(F.col("q") == F.col("query"))
    rank = F.when(path.isNull(), 0).when(under & asked, 1)
    least = met.select(key, rank.alias("rank")).where("rank IS NOT NULL").groupBy(key).agg(F.min("rank").alias("rank"))
    return least.select(key, F.when(F.col("rank") == 0, "common_crawl_opt_out_domain").otherwise("common_crawl_opt_out_url").alias("reason"))


def final_opt_out(rows: DataFrame, rules: DataFrame, key: str, fields: Sequence[str]) -> DataFrame:
    """(key, reason, url) of rows with an address that is opted out, the first of the fields' own."""
    each = rows.select(key, F.posexplode(F.array_distinct(F.array_compact(F.array(*[F.when(F.trim(F.col(f)) != "", F.trim(F.col(f))) for f in fields])))).alias("at", "url"))
    named = each.withColumn("_k", F.struct(key, "at"))
    told = opt_out_reasons(named, rules, "_k").join(named.select("_k", "url"), "_k")
    return told.groupBy(F.col("_k").getField(key).alias(key)).agg(F.min_by(F.struct(F.concat(F.lit("final_"), "reason").alias("reason"), "url"), "_k.at").alias("x")).select(key, "x.*")


def opted_out(pages: DataFrame, rules: DataFrame, key: str, url: str = "url") -> DataFrame:
    """Distinct keys of addresses that a rule fits."""
    return opt_out_reasons(pages, rules, key, url).select(key)


#: The order in which a record's eligibility is judged.
ELIGIBILITY = ["admission", "benchmark", "publisher", "license", "opt_out", "missing_url", "language", "quality", "contamination"]


def eligibility(checks: Mapping[str, Column]) -> Column:
    """The reason of the first check in ELIGIBILITY that has one; checks may be left out, as those deferred to a later stage."""
    unknown = set(checks) - set(ELIGIBILITY)
    if unknown:
        raise KeyError(f"no checks named {sorted(unknown)}")
    return F.coalesce(*[checks[k] for k in ELIGIBILITY if k in checks], F.lit(None).cast("string"))


def license_key(value: Column) -> Column:
    return F.regexp_replace(F.lower(value), r"[^\p{L}\p{N}]", "")


def license_reason(value: Column, allowed: Sequence[str]) -> Column:
    """Null if all licences of a list parted by commas are allowed, whatever their punctuation."""
    keys = F.array(*[license_key(F.lit(a)) for a in allowed])
    return F.when(F.coalesce(value, F.lit("")) == "", "missing_per_record_license").when(F.exists(F.split(value, ","), lambda x: ~F.array_contains(keys, license_key(x))), "per_record_license_not_allowed")


def license_allowed(expression: Column, allowed: Sequence[str]) -> Column:
    return F.forall(F.split(F.lower(expression), " or "), lambda x: x.isin(*allowed))


def islands(ranges: DataFrame, by: str, gap: int) -> DataFrame:
    """(by, start, stop, members) of half-open ranges joined while the next starts at most `gap` after the furthest end."""
    order = Window.partitionBy(by).orderBy("start", "stop")
    reach = ranges.withColumn("_r", F.max("stop").over(order.rowsBetween(Window.unboundedPreceding, -1)))
    cut = reach.withColumn("_i", F.sum(F.when(F.col("_r").isNull() | (F.col("start") > F.col("_r") + gap), 1).otherwise(0)).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return cut.groupBy(by, "_i").agg(F.min("start").alias("start"), F.max("stop").alias("stop"), F.count("*").alias("members")).drop("_i")


def bounded_ranges(ranges: DataFrame, by: str, gap: int, span: int) -> DataFrame:
    """The same, but no joined range is longer than span (unless one member is): each island is folded in order, by itself."""
    order = Window.partitionBy(by).orderBy("start", "stop")
    reach = ranges.withColumn("_r", F.max("stop").over(order.rowsBetween(Window.unboundedPreceding, -1)))
    cut = reach.withColumn("_i", F.sum(F.when(F.col("_r").isNull() | (F.col("start") > F.col("_r") + gap), 1).otherwise(0)).over(order.rowsBetween(Window.unboundedPreceding, 0)))

    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        out: list[list] = []
        for row in pdf.sort_values(["start", "stop"]).itertuples():
            if out and max(out[-1][2], row.stop) - out[-1][1] <= span:
                out[-1][2], out[-1][3] = max(out[-1][2], row.stop), out[-1][3] + 1
            else:
                out.append([getattr(row, by), row.start, row.stop, 1])
        return pd.DataFrame(out, columns=[by, "start", "stop", "members"])

    return cut.groupBy(by, "_i").applyInPandas(fold, f"{by} bigint, start bigint, stop bigint, members bigint")
