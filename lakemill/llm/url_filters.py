"""URL filters: a trie over reversed host labels and path segments, broadcast; the longest matching rule wins.

Cases: a null url, or one without `://`, has an empty host and path and gets the default verdict. A rule fits its host and every
subdomain when the url's path starts with the rule's path. The longest rule (host and path characters) wins; of equal length, block
wins. Repeated rows are judged each; other columns of the input are not read.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame

#: The rules are broadcast, so their number is bounded.
MOST_RULES = 1_000_000
_UPPER = {c: c + 32 for c in range(65, 91)}


def split_url(url: str | None) -> tuple[str, str]:
    at = -1 if url is None else url.find("://")
    if at < 0:
        return "", ""
    rest = url[at + 3 :]
    for mark in "?#":
        rest = rest.partition(mark)[0]
    host, slash, path = rest.partition("/")
    return host.translate(_UPPER), slash + path


class Trie:
    """Nodes are dicts: host labels from the right, then under PATH the path segments; under ENDS, by length, the beginnings of a segment that end a rule."""

    PATH, ENDS = object(), object()

    def __init__(self, rules: Sequence[tuple[str, str, str]]):
        """rules: (verdict, host, path)."""
        self.root: dict = {}
        for verdict, host, path in rules:
            if verdict not in ("allow", "block"):
                raise ValueError(f"a rule's verdict is allow or block, not {verdict!r}")
            node = self.root
            for label in reversed(host.translate(_UPPER).split(".")):
                node = node.setdefault(label, {})
            node = node.setdefault(self.PATH, {})
            *whole, begun = path.split("/")
            for segment in whole:
                node = node.setdefault(segment, {})
            ends = node.setdefault(self.ENDS, {}).setdefault(len(begun), {})
            found = (len(host) + len(path), verdict == "block", host + path, verdict)
            ends[begun] = max(found, ends.get(begun, found))

    def match(self, host: str, path: str) -> tuple[str, str] | None:
        best, node = None, self.root
        segments = path.split("/")
        for label in reversed(host.split(".")):
            node = node.get(label)
            if node is None:
                break
            at = node.get(self.PATH)
            for segment in segments:
                if at is None:
                    break
                for length, ends in at.get(self.ENDS, {}).items():
                    found = ends.get(segment[:length])
                    if found is not None and (best is None or found > best):
                        best = found
                at = at.get(segment)
        return best and best[2:]


#: The trie that this worker has built, by the name of its rules.
_tries: dict[str, Trie] = {}


def url_verdicts(pages: DataFrame, rules: Sequence[tuple[str, str, str]], key: str = "page_id", url: str = "url", default: str = "allow") -> DataFrame:
    """(key, host, path, rule, verdict) of every row of pages."""
    if len(rules) > MOST_RULES:
        raise ValueError(f"{len(rules)} rules; at most {MOST_RULES} are broadcast")
    sent, name = pages.sparkSession.sparkContext.broadcast(list(rules)), uuid.uuid4().hex

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if name not in _tries:
            _tries.clear()
            _tries[name] = Trie(sent.value)
        trie = _tries[name]
        for batch in batches:
            split = [split_url(u) for u in batch.column(1).to_pylist()]
            found = [trie.match(*x) if x[0] else None for x in split]
            columns = [batch.column(0), pa.array([x[0] for x in split], pa.string()), pa.array([x[1] for x in split], pa.string()), pa.array([f and f[0] for f in found], pa.string()), pa.array([f[1] if f else default for f in found], pa.string())]
            yield pa.RecordBatch.from_arrays(columns, names=[key, "host", "path", "rule", "verdict"])

    kind = pages.schema[key].dataType.simpleString()
    return pages.select(key, url).mapInArrow(judge, f"`{key}` {kind}, host string, path string, rule string, verdict string")
