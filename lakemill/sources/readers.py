"""Rows from files: Parquet, JSON lines (plain, gz, zst, xz), JSON, text, WARC and WET, MediaWiki XML, tar archives.

Spark's own readers where they exist; containers that Spark cannot split or decode are taken apart on executors, one file a task's row, streamed member
by member. Smaller files come through Spark (`binaryFile`), so any of its stores will do; large ones are streamed from their store.
"""

from __future__ import annotations

import bz2
import gzip
import io
import json
import lzma
import re
import tarfile
import zlib
from collections.abc import Iterator, Mapping
from itertools import islice

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SUFFIXES = ("parquet", "jsonl", "ndjson", "json", "txt", "md")
MOST_RECORD_BYTES = 64 << 20


def unpacked(name: str, data: bytes) -> bytes:
    """By magic bytes; a truncated frame is an error."""
    if data[:2] == b"\x1f\x8b":
        return gzip.decompress(data)
    if data[:4] == b"\x28\xb5\x2f\xfd":
        import zstandard

        out, rest = [], data
        while rest:
            d = zstandard.ZstdDecompressor().decompressobj()
            out.append(d.decompress(rest))
            if not d.eof:
                raise ValueError(f"{name}: truncated zstd frame")
            rest = d.unused_data
        return b"".join(out)
    if data[:6] == b"\xfd7zXZ\x00":
        return lzma.decompress(data)
    if data[:3] == b"BZh":
        return bz2.decompress(data)
    return data


class Frames(io.RawIOBase):
    """The bytes of zstd frames one after the other, as a stream; a frame that ends early is an error."""

    def __init__(self, raw, name: str = "", step: int = 1 << 20):
        self.raw, self.name, self.step, self.frame, self.rest, self.out = raw, name, step, None, b"", b""

    def readable(self) -> bool:
        return True

    def readinto(self, into) -> int:
        import zstandard

        while not self.out:
            data = self.rest or self.raw.read(self.step)
            self.rest = b""
            if not data:
                if self.frame is not None:
                    raise ValueError(f"{self.name}: truncated zstd frame")
                return 0
            self.frame = self.frame or zstandard.ZstdDecompressor().decompressobj()
            self.out = self.frame.decompress(data)
            if self.frame.eof:
                self.rest, self.frame = self.frame.unused_data, None
        n = min(len(into), len(self.out))
        into[:n], self.out = self.out[:n], self.out[n:]
        return n


def plain_stream(raw, name: str = ""):
    """A stream of what a stream holds, by its magic bytes."""
    whole = io.BufferedReader(raw) if isinstance(raw, io.RawIOBase) else raw
    head = whole.peek(6)[:6] if hasattr(whole, "peek") else b""
    if head[:2] == b"\x1f\x8b":
        return gzip.GzipFile(fileobj=whole)
    if head[:4] == b"\x28\xb5\x2f\xfd":
        return io.BufferedReader(Frames(whole, name))
    if head[:6] == b"\xfd7zXZ\x00":
        return lzma.LZMAFile(whole)
    if head[:3] == b"BZh":
        return bz2.BZ2File(whole)
    return whole


#: Files over this many bytes are streamed from their store instead of coming as one row.
MOST_WHOLE = 256 << 20


def _opened(path: str, content: bytes | None):
    if content is not None:
        return io.BufferedReader(io.BytesIO(content))
    from pyarrow import fs

    store, at = fs.FileSystem.from_uri(path)
    return io.BufferedReader(_Stream(store.open_input_stream(at, compression=None)))


class _Stream(io.RawIOBase):
    def __init__(self, raw):
        self.raw = raw

    def readable(self) -> bool:
        return True

    def readinto(self, into) -> int:
        data = self.raw.read(len(into))
        into[: len(data)] = data
        return len(data)


def _files(spark: SparkSession, path: str, pattern: str | None = None) -> DataFrame:
    """(path, content): content is null for files over MOST_WHOLE, which are read as streams by their path."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    found = (reader.option("pathGlobFilter", pattern) if pattern else reader).load(path)
    large = found.where(F.col("length") > MOST_WHOLE).select("path", F.lit(None).cast("binary").alias("content"))
    return found.where(F.col("length") <= MOST_WHOLE).select("path", "content").unionByName(large)


#: Rows to a batch that a reader gives.
BATCH = 1000


def _batched(rows: Iterator[tuple], columns: list[str]) -> Iterator[pd.DataFrame]:
    while part := list(islice(rows, BATCH)):
        yield pd.DataFrame(part, columns=columns)


def read_json_lines(spark: SparkSession, path: str, schema: str, strict: bool = False, pattern: str | None = None) -> DataFrame:
    """JSON lines; blank lines are skipped and lines that are no object dropped, or an error if strict. zst and xz are unpacked as streams."""
    if pattern and pattern.rsplit(".", 1)[-1] in ("zst", "xz"):

        def lines(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for part in parts:
                for name, data in zip(part["path"], part["content"]):
                    text = io.TextIOWrapper(plain_stream(_opened(name, data), name), encoding="utf-8-sig", newline="\n")
                    yield from _batched(((x.rstrip("\r\n"),) for x in text if x.strip()), ["value"])

        raw = _files(spark, path, pattern).mapInPandas(lines, "value string")
    else:
        reader = spark.read.option("recursiveFileLookup", "true")
        raw = (reader.option("pathGlobFilter", pattern) if pattern else reader).text(path).select(F.regexp_replace("value", "^﻿", "").alias("value")).where("trim(value) <> ''")
    if strict:
        bad = F.raise_error(F.lit("a record is too long"))
        raw = raw.select(F.when(F.octet_length("value") <= MOST_RECORD_BYTES, F.col("value")).otherwise(bad).alias("value"))
        return raw.select(F.from_json("value", schema, {"mode": "FAILFAST"}).alias("r")).select("r.*")
    return raw.where("value LIKE '{%'").select(F.from_json("value", schema).alias("r")).where("r IS NOT NULL").select("r.*")


def read_documents(spark: SparkSession, path: str, schema: str = "id string, text string") -> DataFrame:
    """A folder of any of the formats as one DataFrame of the schema's columns; a text file is one row."""
    columns = [c.strip().split()[0] for c in schema.split(",")]
    names = [r["path"] for r in spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path").collect()]
    kinds = {k for n in names for k in [n.rsplit("/", 1)[-1]] if not k.startswith((".", "_"))}
    found = lambda *ends: any(n.endswith(ends) for n in kinds)
    out: list[DataFrame] = []
    if found(".parquet"):
        out.append(spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", "*.parquet").parquet(path).select(*columns))
    for end in ("jsonl", "jsonl.gz", "json.gz", "jsonl.zst", "jsonl.xz", "json.xz"):
        if found("." + end):
            out.append(read_json_lines(spark, path, schema, pattern=f"*.{end}"))
    if found(".txt", ".md"):
        text = _files(spark, path, "*.{txt,md}").select(F.col("path").alias("id"), F.decode("content", "UTF-8").alias("text"))
        out.append(text.select(*[F.col(c) if c in ("id", "text") else F.lit(None).cast("string").alias(c) for c in columns]))
    if not out:
        return spark.createDataFrame([], schema)
    whole = out[0]
    for more in out[1:]:
        whole = whole.unionByName(more)
    return whole


def warc_records(data) -> Iterator[tuple[dict[str, str], bytes]]:
    """Header and body of each record of plain bytes or a stream of them; a length that runs past the end is an error."""
    stream = io.BytesIO(data) if isinstance(data, (bytes, bytearray)) else data
    while True:
        line = stream.readline()
        while line in (b"\r\n", b"\n"):
            line = stream.readline()
        if not line:
            return
        if not line.startswith(b"WARC/"):
            raise ValueError("no WARC record")
        head = {}
        while (line := stream.readline()) not in (b"\r\n", b"\n"):
            if not line:
                raise ValueError("truncated WARC record")
            name, _, value = line.decode("utf-8", "replace").partition(":")
            head[name.strip().lower()] = value.strip()
        n = int(head["content-length"])
        body = stream.read(n)
        if len(body) < n:
            raise ValueError("truncated WARC record")
        yield head, body


def unchunked(body: bytes) -> bytes:
    out, at = [], 0
    while True:
        end = body.index(b"\r\n", at)
        n = int(body[at:end].split(b";")[0], 16)
        if not n:
            return b"".join(out)
        out.append(body[end + 2 : end + 2 + n])
        at = end + 4 + n


def http_head(body: bytes) -> tuple[int, dict[str, str], bytes]:
    """(status, headers, payload as it was sent) of an HTTP response."""
    raw, _, payload = body.partition(b"\r\n\r\n")
    lines = raw.decode("latin-1").split("\r\n")
    return int(lines[0].split()[1]), {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}, payload


def http_body(fields: dict[str, str], payload: bytes) -> str:
    """The text of a payload after its encodings."""
    plain = unchunked(payload) if fields.get("transfer-encoding", "").lower() == "chunked" else payload
    encoding = fields.get("content-encoding", "").lower()
    if encoding in ("gzip", "x-gzip", "zstd"):
        plain = unpacked("body", plain)
    elif encoding == "deflate":
        plain = zlib.decompress(plain)
    elif encoding not in ("", "identity"):
        raise ValueError(f"content encoding {encoding}")
    charset = fields.get("content-type", "").partition("charset=")[2].split(";")[0].strip(" '\"") or "utf-8"
    return plain.decode(charset, "replace")


def http_text(body: bytes) -> tuple[int, str, str]:
    """(status, mime, text) of an HTTP response."""
    status, fields, payload = http_head(body)
    return status, fields.get("content-type", "").partition(";")[0].strip().lower(), http_body(fields, payload)


def read_warc(spark: SparkSession, path: str, mimes: tuple[str, ...] = ("text/html", "text/plain"), pattern: str = "*.gz") -> DataFrame:
    """(url, date, kind, mime, text): WET conversions, and responses with status 200 and one of the mimes."""

    def rows(name: str, data: bytes | None) -> Iterator[tuple]:
        for head, body in warc_records(plain_stream(_opened(name, data), name)):
            kind = head.get("warc-type")
            if kind == "conversion":
                yield head.get("warc-target-uri"), head.get("warc-date"), kind, "text/plain", body.decode("utf-8", "replace")
            elif kind == "response":
                status, mime, text = http_text(body)
                if status == 200 and mime in mimes:
                    yield head.get("warc-target-uri"), head.get("warc-date"), kind, mime, text

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for name, data in zip(part["path"], part["content"]):
                yield from _batched(rows(name, data), ["url", "date", "kind", "mime", "text"])

    return _files(spark, path, pattern).mapInPandas(run, "url string, date string, kind string, mime string, text string")


def read_wiki_xml(spark: SparkSession, path: str) -> DataFrame:
    """(id, title, text) of namespace 0 pages, by Spark's XML reader (bz2 is split by it); the wikitext is kept as it is."""
    schema = "id bigint, ns int, title string, revision struct<id bigint, text string>"
    return spark.read.format("xml").option("rowTag", "page").option("ignoreNamespace", "true").schema(schema).load(path).where("ns = 0 AND revision IS NOT NULL").select("id", "title", F.col("revision.text").alias("text"))


GENERATED_MARKS = ("@generated", "auto-generated", "automatically generated")


def read_tar(spark: SparkSession, path: str, least_chars: int = 80, pattern: str = "*.tar*") -> DataFrame:
    """(archive, path, text) of the plain files: no links, no way out of the archive, no binary, short or generated ones."""

    def rows(name: str, data: bytes | None) -> Iterator[tuple]:
        with tarfile.open(fileobj=_opened(name, data), mode="r|*") as tar:
            for m in tar:
                if not m.isfile() or m.name.startswith("/") or ".." in m.name.split("/"):
                    continue
                body = tar.extractfile(m).read()
                text = body.decode("utf-8", "replace")
                if b"\0" not in body and len(text) >= least_chars and not any(g in text[:4000].lower() for g in GENERATED_MARKS):
                    yield name, m.name, text

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for name, data in zip(part["path"], part["content"]):
                yield from _batched(rows(name, data), ["archive", "path", "text"])

    return _files(spark, path, pattern).mapInPandas(run, "archive string, path string, text string")


#: Bytes of files that are worth dealing out anew, and that still are for each core.
LEAST_SPREAD, MOST_SPREAD = 1 << 20, 16 << 20


def spread(df: DataFrame) -> DataFrame:
    """df dealt out to all cores if its files are too few for them to be busy: a small table may be a single row group, which one task reads whatever its
    size. Larger tables have splits enough and stay as they are, without a shuffle."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    if not LEAST_SPREAD <= size <= MOST_SPREAD * cores or df.rdd.getNumPartitions() >= cores:
        return df
    return df.repartition(cores)


def first_text(*fields: Column) -> Column:
    """The first field that is not blank."""
    return F.coalesce(*[F.when(F.trim(f) != "", f) for f in fields])


def sections(parts: Mapping[str, Column]) -> Column:
    """Name and body of the parts that aren't blank, one under the other."""
    return F.array_join(F.array_compact(F.array(*[F.when(F.trim(v) != "", F.concat(F.lit(f"{k}:\n"), v)) for k, v in parts.items()])), "\n\n")


def extracted(rows: DataFrame, order: tuple[str, ...] = ("text", "content", "code", "body", "document")) -> DataFrame:
    """rows with training_text: the first text field, else files or pages joined where there are such arrays."""
    fields = [F.col(c) for c in order if c in rows.columns]
    if "pages" in rows.columns:
        fields.append(F.array_join("pages", "\n"))
    return rows.withColumn("training_text", first_text(*fields) if fields else F.lit(None).cast("string"))


def is_pointer(text: Column) -> Column:
    """A large-file or archive pointer instead of content."""
    return text.rlike(r"^version https://git-lfs\.github\.com/spec/v1") | text.rlike(r"^swh:1:(cnt|dir|rev|rel|snp):[0-9a-f]{40}$")


def canonical_json(value) -> str:
    """Sorted keys, compact, no NaN."""
    return json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False, allow_nan=False)


def simple_name(name: Column) -> Column:
    return F.regexp_replace(F.lower(name), "[^a-z0-9]+", "")


def load_source(spark: SparkSession, spec: Mapping) -> DataFrame:
    """A source by its description: format (parquet, jsonl, json.gz and others of read_documents, text, warc, xml, tar), path, schema, words that file names have or don't
    have (letters and digits alone count), and part_index of part_count of its files in order of name."""
    kind, path = spec["format"], spec["path"]
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path")
    name = simple_name(F.element_at(F.split("path", "/"), -1))
    words = lambda key: [w for w in (re.sub("[^a-z0-9]+", "", x.lower()) for x in spec.get(key, ())) if w]
    for key, wanted in (("include", True), ("exclude", False)):
        if words(key):
            files = files.where(F.exists(F.array(*map(F.lit, words(key))), lambda w: F.contains(name, w)) == wanted)
    # names are control data: as many as a source has files
    names = [r["path"] for r in files.orderBy("path").collect() if not r["path"].rsplit("/", 1)[-1].startswith((".", "_"))]
    count, index = spec.get("part_count", 1), spec.get("part_index", 0)
    if not 0 <= index < count:
        raise ValueError(f"no part {index} of {count}")
    names = names[index::count]
    if not names:
        return spark.createDataFrame([], spec["schema"])
    if kind == "parquet":
        return spark.read.parquet(*names)
    if kind == "text":
        return spark.read.text(names, wholetext=True).select(F.col("value").alias("text"))
    if kind in ("jsonl", "json.gz", "jsonl.gz"):
        return spark.read.schema(spec["schema"]).option("mode", "DROPMALFORMED").json(names)
    raise ValueError(f"no reader for {kind}")


def expanded_receipts(receipts: DataFrame, key: str) -> DataFrame:
    """(key, shard, path, payload_role) of the files that receipts with kind, payload_role, local_path and shards name: the shards of a data set, or a file by
    itself. Indexes hold no records."""
    live = receipts.where(~F.coalesce("payload_role", F.lit("")).isin("source_index", "metadata_index", "retrieval_index"))
    wrapped = F.coalesce("kind", F.lit("")) == "materialized_dataset"
    role = F.coalesce("payload_role", F.lit("training_records"))
    shards = live.where(wrapped).select(key, F.explode("shards").alias("s"), F.lit("training_records").alias("payload_role")).select(key, "s.shard", "s.path", "payload_role")
    alone = live.where(~wrapped & F.col("local_path").isNotNull()).select(key, F.lit(None).cast(shards.schema["shard"].dataType).alias("shard"), F.col("local_path").alias("path"), role.alias("payload_role"))
    return shards.unionByName(alone)


def file_components(rows: DataFrame, key: str, files: str = "files", text: str = "text") -> DataFrame:
    """(key, component, body, license, file_count, rejection): a document for each of an object's files, in order, with the object's licence where the file has none;
    files without text and pointers are refused, and an object without files is one refused row."""
    each = rows.select(key, F.size(files).alias("file_count"), F.col("license").alias("_own"), F.posexplode(files).alias("_i", "_f"))
    body = F.col("_f")[text]
    told = each.select(key, F.concat(F.lit("files/"), F.col("_i").cast("string")).alias("component"), body.alias("body"), F.coalesce(F.nullif(F.col("_f.license"), F.lit("")), "_own").alias("license"), "file_count", F.when(body.isNull() | is_pointer(body), "pointer_only_code").alias("rejection"))
    none = rows.where(F.size(files) == 0).select(key, F.lit("row").alias("component"), F.lit(None).cast("string").alias("body"), "license", F.lit(0).alias("file_count"), F.lit("empty_file_list").alias("rejection"))
    return told.unionByName(none)


# Names under which a row's JSON may hold each field, in order, and licences that say nothing.
ALIASES = {"language": ["language", "lang", "doc_language"], "canonical_url": ["canonical_url", "url", "source_url", "original_url"]}
LICENSE_FIELDS = ["license", "licenses", "license_spdx", "license_id", "detected_licenses"]
LINEAGE_FIELDS = ["source_dataset", "hf_dataset_name", "seed_source", "dataset", "dataset_name", "seed_dataset", "upstream_dataset"]
NO_LICENSE = ["", "none", "null", "unknown", "n/a", "noassertion", "unlicensed"]


def projected_metadata(rows: DataFrame, metadata: str) -> DataFrame:
    """rows with language, canonical_url, license and source_dataset from their aliases in the JSON text, and language_field and url_field, the names that had them. A
    list of licences is joined by commas, each once; those that say nothing don't count."""
    get = lambda name: F.nullif(F.get_json_object(metadata, f"$.{name}"), F.lit(""))
    first = lambda names: F.coalesce(*[get(n) for n in names])
    which = lambda names: F.coalesce(*[F.when(get(n).isNotNull(), F.lit(n)) for n in names])

    def license_of(name: str) -> Column:
        value = F.get_json_object(metadata, f"$.{name}")
        listed = F.coalesce(F.from_json(value, "array<string>"), F.array(value))
        known = F.array_distinct(F.filter(listed, lambda x: x.isNotNull() & ~F.lower(F.trim(x)).isin(NO_LICENSE)))
        return F.when(F.size(known) > 0, F.array_join(known, ","))

    told = {"language": first(ALIASES["language"]), "language_field": which(ALIASES["language"]), "canonical_url": first(ALIASES["canonical_url"]), "url_field": which(ALIASES["canonical_url"]), "license": F.coalesce(*[license_of(n) for n in LICENSE_FIELDS]), "source_dataset": first(LINEAGE_FIELDS)}
    return rows.select("*", *[c.alias(n) for n, c in told.items()])
