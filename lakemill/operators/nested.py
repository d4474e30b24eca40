"""What metadata of any depth tells: addresses, and lineage from benchmarks. Walks over JSON texts, in Arrow batches."""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator, Mapping

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import urls as U

# Keys that hold addresses, that name benchmarks, and that name data sets; and benchmarks that are ordinary words too.
URL_KEYS = ["url", "original_url", "canonical_url", "declared_canonical_url", "source_url", "warc_target_uri"]
BENCHMARK_KEYS = ["benchmark", "benchmark_id", "benchmark_name", "eval_benchmark", "eval_dataset", "evaluation_benchmark", "evaluation_dataset", "seed_benchmark", "source_benchmark"]
DATASET_KEYS = ["dataset", "dataset_id", "dataset_name", "datasets", "origin_dataset", "seed_dataset", "source_dataset", "task_dataset", "upstream_dataset"]
AMBIGUOUS = ["apps", "arc", "drop", "frames", "math", "race"]
#: Depth of a walk, items of a list, and characters of a value that count.
MOST_DEPTH, MOST_ITEMS, MOST_CHARS = 6, 250, 2048


def simple(name: str) -> str:
    return re.sub("[^a-z0-9]+", "", name.lower())


def entries(value, skip: tuple[str, ...] = (), most_depth: int | None = None) -> Iterator[tuple[str, object]]:
    """(name, value) of every entry of every object inside a JSON value, outer ones first."""
    level, depth = [value], 0
    while level and (most_depth is None or depth <= most_depth):
        inner = []
        for x in level:
            if isinstance(x, Mapping):
                for name, v in x.items():
                    if name not in skip:
                        yield name, v
                        inner.append(v)
            elif isinstance(x, list):
                inner += x if most_depth is None else x[:MOST_ITEMS]
        level, depth = [v for v in inner if isinstance(v, (Mapping, list))], depth + 1


def plain_values(value, depth: int = 0) -> Iterator[str]:
    if isinstance(value, str):
        if 0 < len(value) <= MOST_CHARS:
            yield value
    elif depth < MOST_DEPTH and isinstance(value, (Mapping, list)):
        for v in list(value.values() if isinstance(value, Mapping) else value)[:MOST_ITEMS]:
            yield from plain_values(v, depth + 1)


def urls_in(value) -> list[str]:
    return list(dict.fromkeys(v.strip() for name, v in entries(value, skip=("source_defaults",)) if name in URL_KEYS and isinstance(v, str) and v.strip()))


def lineage_in(value) -> list[tuple[bool, str]]:
    """(strict, name) of the benchmarks and data sets that a value names; strict if the field is one of benchmarks."""
    strict, loose = set(map(simple, BENCHMARK_KEYS)), set(map(simple, DATASET_KEYS))
    return [(simple(str(name)) in strict, v) for name, x in entries(value, most_depth=MOST_DEPTH) if simple(str(name)) in strict | loose for v in plain_values(x)]


def benchmark_of(value, strict: Mapping[str, str], safe: Mapping[str, str]) -> str | None:
    """The benchmark that a field of lineage names: its whole value, a part of it between separators, or the last two parts."""
    for is_strict, name in lineage_in(value):
        parts = [p for p in re.split(r"[/\\|,;\s]+", name) if p]
        said = [simple(name), *(simple(p.split("?")[0]) for p in parts)] + ([simple("/".join(parts[-2:]))] if len(parts) > 1 else [])
        found = next((x for x in said if x in (strict if is_strict else safe)), None)
        if found:
            return (strict if is_strict else safe)[found]
    return None


def aliases(benchmarks: Mapping[str, list[str]]) -> tuple[dict[str, str], dict[str, str]]:
    """(strict, safe) from benchmarks and their other names: ordinary words count only in fields of benchmarks."""
    strict = {simple(a): name for name, others in benchmarks.items() for a in (name, *others) if simple(a)}
    return strict, {a: name for a, name in strict.items() if a not in AMBIGUOUS}


def _walk(kind: str, of: Callable):
    @F.pandas_udf(kind)
    def run(texts: pd.Series) -> pd.Series:
        def one(t):
            try:
                return of(json.loads(t)) if t else None
            except (ValueError, RecursionError):
                return None

        return texts.map(one)

    return run


def published_urls(rows: DataFrame, key: str, metadata: str) -> DataFrame:
    """(key, url): the published addresses anywhere in the metadata, each once, in their order."""
    each = rows.select(key, F.posexplode(_walk("array<string>", urls_in)(F.col(metadata))).alias("pos", "url"))
    return each.where(U.published(F.col("url"))).select(key, "pos", "url")


def benchmark_lineage(metadata: Column, benchmarks: Mapping[str, list[str]]) -> Column:
    strict, safe = aliases(benchmarks)
    return _walk("string", lambda v: benchmark_of(v, strict, safe))(metadata)
