"""Files of every format written and read back, receipts and journals, sorts and ranks."""

from __future__ import annotations

import bz2
import gzip
import io
import json
import tarfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import hashing as H
from ..functions import text as T
from ..operators import dedup as D
from ..operators import evidence as E
from ..operators import select as S
from ..sources import readers, sinks
from ..streaming import journal as J
from .corpus import _CANON, _KEYED, _SENT, keyed
from .registry import query, table
from .streams import _scratch

#: Documents to a file, about, where a query makes files of its own.
PER_FILE = 200


def _bundles(docs, pack, suffix: str, key: str = "doc_id", text: str = "text"):
    """(name, data): files of neighbouring documents, packed by pack(list of (key, text)). Each file is made from one group of bounded size."""

    def run(part: pd.DataFrame) -> pd.DataFrame:
        rows = sorted(zip(part[key].tolist(), part[text].tolist()))
        return pd.DataFrame([(f"part-{rows[0][0] // PER_FILE}.{suffix}", pack(rows))], columns=["name", "data"])

    return docs.select(key, text).withColumn("_file", F.floor(F.col(key) / PER_FILE)).groupBy("_file").applyInPandas(lambda p: run(p), "name string, data binary")


def _lines(rows) -> bytes:
    return "".join(json.dumps({"id": str(k), "text": t}) + "\n" for k, t in rows).encode()


def _two_frames(rows) -> bytes:
    import zstandard

    data = _lines(rows)
    return zstandard.compress(data[: len(data) // 2]) + zstandard.compress(data[len(data) // 2 :])


@query("SELECT CAST(doc_id AS VARCHAR) AS id, sha256(text) AS digest FROM documents")
def s2_s21_folder_scan(spark, sf_dir):
    """A folder of Parquet, JSON lines plain and gzipped, and zstd of several frames, read as one table."""
    path, docs = _scratch(spark), table(spark, sf_dir, "documents")
    part = lambda i: docs.where(F.col("doc_id") % 4 == i)
    part(0).select(F.col("doc_id").cast("string").alias("id"), "text").write.parquet(f"{path}/a")
    sinks.write_files(_bundles(part(1), _lines, "jsonl"), f"{path}/b", "name", "data")
    sinks.write_files(_bundles(part(2), lambda rows: gzip.compress(_lines(rows)), "jsonl.gz"), f"{path}/b", "name", "data")
    sinks.write_files(_bundles(part(3), _two_frames, "jsonl.zst"), f"{path}/b", "name", "data")
    return readers.read_documents(spark, path).select("id", H.sha256(F.col("text")).alias("digest"))


@query("SELECT CAST(doc_id AS VARCHAR) AS id, sha256(text) AS digest FROM documents")
def s3_s7_strict_formats(spark, sf_dir):
    """Every record of every frame, or an error: JSON lines in zstd of several frames, read strictly."""
    path = _scratch(spark)
    sinks.write_files(_bundles(table(spark, sf_dir, "documents"), _two_frames, "jsonl.zst"), path, "name", "data")
    return readers.read_json_lines(spark, path, "id string, text string", strict=True, pattern="*.zst").select("id", H.sha256(F.col("text")).alias("digest"))


def _warc(rows) -> bytes:
    out = io.BytesIO()
    for k, t in rows:
        body = (t or "").encode()
        if k % 3:
            http = f"HTTP/1.1 {'404 Gone' if k % 11 == 0 else '200 OK'}\r\nContent-Type: {'application/pdf' if k % 13 == 0 else 'text/plain; charset=utf-8'}\r\n{'Transfer-Encoding: chunked' if k % 2 else 'X: y'}\r\n\r\n".encode()
            body = http + (b"%x\r\n%s\r\n0\r\n\r\n" % (len(body), body) if k % 2 and body else b"0\r\n\r\n" if k % 2 else body)
        head = f"WARC/1.0\r\nWARC-Type: {'response' if k % 3 else 'conversion'}\r\nWARC-Target-URI: http://example.com/{k}\r\nWARC-Date: 2024-01-01T00:00:00Z\r\nContent-Length: {len(body)}\r\n\r\n".encode()
        out.write(gzip.compress(head + body + b"\r\n\r\n"))
    return out.getvalue()


@query("SELECT 'http://example.com/' || doc_id AS url, CASE WHEN doc_id % 3 = 0 THEN 'conversion' ELSE 'response' END AS kind, sha256(text) AS digest FROM documents WHERE doc_id % 3 = 0 OR (doc_id % 11 <> 0 AND doc_id % 13 <> 0)")
def s5_warc(spark, sf_dir):
    """Conversions and responses in archives, chunked ones too; other kinds and statuses are left out."""
    path = _scratch(spark)
    sinks.write_files(_bundles(table(spark, sf_dir, "documents"), _warc, "warc.gz"), path, "name", "data")
    return readers.read_warc(spark, path).select("url", "kind", H.sha256(F.col("text")).alias("digest"))


def _wiki(rows) -> bytes:
    from xml.sax.saxutils import escape

    page = "<page><title>D{0}</title><ns>{1}</ns><id>{0}</id><revision><id>1</id><text>x{2}</text></revision></page>"
    return bz2.compress(("<mediawiki>\n" + "\n".join(page.format(k, int(k % 5 == 0), escape("".join(c for c in t or "" if c.isprintable()))) for k, t in rows) + "\n</mediawiki>").encode())


@query("SELECT doc_id AS id, 'D' || doc_id AS title FROM documents WHERE doc_id % 5 <> 0")
def s6_wiki_xml(spark, sf_dir):
    """Pages of the main namespace of compressed dumps."""
    path = _scratch(spark)
    sinks.write_files(_bundles(table(spark, sf_dir, "documents"), _wiki, "xml.bz2"), path, "name", "data")
    return readers.read_wiki_xml(spark, path).where("text LIKE 'x%'").select("id", "title")


def _tar(rows) -> bytes:
    out = io.BytesIO()
    with tarfile.open(fileobj=out, mode="w:gz") as t:
        for k, text in rows:
            body = (text or "").encode() if k % 7 else b"\0" + (text or "").encode()
            info = tarfile.TarInfo(f"../{k}.txt" if k % 9 == 0 else f"src/{k}.txt")
            info.size = len(body)
            t.addfile(info, io.BytesIO(body))
    return out.getvalue()


@query("SELECT 'src/' || doc_id || '.txt' AS path, sha256(text) AS digest FROM documents WHERE doc_id % 7 <> 0 AND doc_id % 9 <> 0 AND length(text) >= 80 AND NOT regexp_matches(lower(left(text, 4000)), '@generated|auto-generated|automatically generated')")
def s13_tar(spark, sf_dir):
    """Plain files of archives: no way out, no binary, short or generated ones."""
    path = _scratch(spark)
    sinks.write_files(_bundles(table(spark, sf_dir, "documents"), _tar, "tar.gz"), path, "name", "data")
    return readers.read_tar(spark, path).select("path", H.sha256(F.col("text")).alias("digest"))


@query("SELECT doc_id, source FROM documents WHERE doc_id // 200 % 2 = 1")
def s15_s16_f16_source_dispatch(spark, sf_dir):
    """A source by its description: its format, file names to take and leave, and which of several parts of its files."""
    path, docs = _scratch(spark), table(spark, sf_dir, "documents").select("doc_id", "source")
    pack = lambda rows: "".join(json.dumps({"doc_id": k, "source": t}) + "\n" for k, t in rows).encode()
    made = _bundles(docs, pack, "jsonl", text="source")
    number = F.regexp_extract("name", r"part-(\d+)", 1).cast("int")
    made = made.withColumn("name", F.concat(F.lpad((number / 2).cast("int").cast("string"), 6, "0"), F.when(number % 2 == 1, "-Train_Set").otherwise("-test"), F.lit(".jsonl")))
    sinks.write_files(made, path, "name", "data")
    spec = {"format": "jsonl", "path": path, "schema": "doc_id bigint, source string", "include": ["train set"], "exclude": ["dev"]}
    parts = [readers.load_source(spark, spec | {"part_index": i, "part_count": 3}) for i in range(3)]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query("SELECT item_id, kind, sha256(part) AS digest FROM (SELECT item_id, unnest([struct_pack(kind := 'query', part := text), struct_pack(kind := 'choices', part := 'b: ' || item_id), struct_pack(kind := 'answer', part := CAST(item_id AS VARCHAR)), struct_pack(kind := 'other', part := 'a remark that is long enough ' || item_id)], recursive := true) FROM benchmark)")
def s20_p11_holdout_fragments(spark, sf_dir):
    """Fragments of benchmark rows in JSON lines, by families of fields; repeated and short others are left out, and bounds on size hold."""
    path = _scratch(spark)
    item = F.col("item_id").cast("string")
    rows = table(spark, sf_dir, "benchmark").select(F.to_json(F.struct("item_id", F.col("text").alias("question"), F.upper("text").alias("prompt"), F.struct(item.alias("b")).alias("options"), F.array(item, item).alias("answers"), F.concat(F.lit("a remark that is long enough "), item).alias("note"), F.lit("short").alias("tag"))).alias("value"))
    rows.write.text(path)
    return E.holdout_fragments(spark.read.text(path), "value", "item_id").select("item_id", "kind", H.sha256(F.col("text")).alias("digest"))


@query("SELECT 'hash' AS check, true AS sound UNION ALL SELECT 'changed', false UNION ALL SELECT 'written', true UNION ALL SELECT 'too_large', true")
def k8_k11_receipts_and_events(spark, sf_dir):
    """A sealed receipt read back, one that was changed, an event appended to a journal and read, and one too large refused."""
    path = _scratch(spark)
    sinks.write_json(spark, f"{path}/R.json", {"rows": table(spark, sf_dir, "documents").count()})
    receipt = sinks.read_json(spark, f"{path}/R.json")
    sinks.append_event(spark, f"{path}/events", {"event_id": 1})
    sinks.append_event(spark, f"{path}/events", {"event_id": 1})
    read = [r[0] for r in J.read(spark, f"{path}/events", "event_id bigint").collect()]
    try:
        sinks.append_event(spark, f"{path}/events", {"event_id": 2, "x": "y" * (1 << 20)})
        refused = False
    except ValueError:
        refused = True
    checks = [("hash", sinks.is_sealed(receipt)), ("changed", sinks.is_sealed(receipt | {"rows": -1})), ("written", read == [1]), ("too_large", refused)]
    return spark.createDataFrame(checks, "check string, sound boolean")


@query("SELECT 'first' AS run, true AS made, count(*) AS rows FROM documents UNION ALL SELECT 'same', false, count(*) FROM documents UNION ALL SELECT 'other policy', true, count(*) FROM documents WHERE n_chars >= 500")
def r10_stage_ledger(spark, sf_dir):
    """A stage is computed again only when its inputs, policy or version changed."""
    path, docs = _scratch(spark), table(spark, sf_dir, "documents")
    out = []
    for name, least in (("first", 0), ("same", 0), ("other policy", 500)):
        rows, made = sinks.stage(spark, path, {"table": "documents"}, {"least": least}, "1", lambda: docs.where(F.col("n_chars") >= least).select("doc_id"))
        out.append((name, made, rows.count()))
    return spark.createDataFrame(out, "run string, made boolean, rows bigint")


@query("SELECT source, count(*) AS n, sum(n_chars) AS chars FROM documents GROUP BY source")
def k10_source_shards(spark, sf_dir):
    """A folder a source with the counts of what was written."""
    path = _scratch(spark)
    table(spark, sf_dir, "documents").repartition("source").write.partitionBy("source").parquet(path)
    return spark.read.parquet(path).groupBy("source").agg(F.count("*").alias("n"), F.sum("n_chars").alias("chars"))


@query("""SELECT conv_id, sha256('{"messages":[' || string_agg('{"content":' || to_json(text) || ',"role":' || to_json(role) || '}', ',' ORDER BY turn) || ']}') AS digest FROM conversations GROUP BY conv_id""")
def p6_p8_canonical_messages(spark, sf_dir):
    """Conversations as canonical JSON: sorted keys, no white space, text as it is."""
    turns = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("turn", "text", "role"))), lambda m: F.struct(m["text"].alias("content"), m["role"].alias("role"))).alias("messages"))
    return turns.select("conv_id", H.sha256(F.to_json(F.struct("messages"))).alias("digest"))


@query("SELECT l_orderkey AS dataset, l_linenumber AS shard, 's' || l_partkey AS path, 'training_records' AS payload_role FROM lineitem WHERE l_orderkey % 4 <> 0 UNION ALL SELECT o_orderkey, NULL, 'local-' || o_orderkey, 'training_records' FROM orders WHERE o_orderkey % 4 = 0 AND o_orderkey % 3 <> 0")
def p17_expanded_receipts(spark, sf_dir):
    """Receipts as rows of files: a data set's shards, a file by itself; indexes hold no records."""
    o = F.col("o_orderkey")
    shards = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.collect_list(F.struct(F.col("l_linenumber").alias("shard"), F.concat(F.lit("s"), F.col("l_partkey").cast("string")).alias("path"))).alias("shards"))
    receipts = table(spark, sf_dir, "orders").join(shards, "o_orderkey", "left").select(o.alias("dataset"), F.when(o % 4 != 0, "materialized_dataset").alias("kind"), F.when((o % 4 == 0) & (o % 3 == 0), "metadata_index").alias("payload_role"), F.when(o % 4 == 0, F.concat(F.lit("local-"), o.cast("string"))).alias("local_path"), F.when(o % 4 != 0, F.col("shards")).alias("shards"))
    return readers.expanded_receipts(receipts, "dataset")


# joins, sorts and ranks


@query(f"""WITH s AS (SELECT doc_id, {_SENT} AS s FROM documents), w AS (SELECT doc_id, unnest(range(1, len(s) - 1)) AS i, s FROM s WHERE len(s) >= 3), d AS (SELECT doc_id, CAST(i - 1 AS INTEGER) AS pos, sha256(lower(array_to_string(s[i:i+2], chr(30)))) AS digest FROM w WHERE len(regexp_extract_all(array_to_string(s[i:i+2], ' '), '[\\p{{L}}\\p{{N}}_]+')) >= 24)
SELECT doc_id, pos, digest FROM d WHERE left(digest, 32) IN (SELECT left(digest, 32) FROM d GROUP BY left(digest, 32) HAVING min(doc_id) <> max(doc_id))""")
def j3_a23_span_candidates(spark, sf_dir):
    """Signatures of spans whose prefix two documents or more hold; whole digests go on only for those."""
    return D.span_candidates(D.span_signatures(table(spark, sf_dir, "documents")))


@query(f"""WITH s AS (SELECT doc_id, {_SENT} AS s FROM documents), r AS (SELECT doc_id, s, CASE WHEN doc_id % 5 = 0 THEN 'stale' ELSE sha256(lower(array_to_string(s[1:3], chr(30)))) END AS digest FROM s WHERE len(s) >= 3 AND doc_id % 2 = 0) SELECT doc_id, CAST(len(s) AS INTEGER) AS n_sentences, CASE WHEN doc_id % 5 = 0 THEN 0 ELSE 3 END AS n_removed FROM r""")
def j4_span_removal_join(spark, sf_dir):
    """Removals meet their documents by key; a span is removed only if its digest is still that of the text."""
    docs = table(spark, sf_dir, "documents").where("doc_id % 2 = 0")
    told = docs.select("doc_id", T.sentences(F.col("text")).alias("s")).where("size(s) >= 3")
    digest = F.when(F.col("doc_id") % 5 == 0, "stale").otherwise(D.span_digest(F.slice("s", 1, 3)))
    removals = told.select("doc_id", F.lit(0).alias("pos"), digest.alias("digest"))
    return D.verified_removals(docs, removals).select("doc_id", "n_sentences", F.size("gone").alias("n_removed"))


@query("SELECT c_custkey, o_orderkey FROM (SELECT o_custkey AS c_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS r FROM orders) WHERE r = 1")
def w2_first_in_group(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("c_custkey"), "o_orderkey", "o_totalprice")
    return D.first_of(orders, ["c_custkey"], [F.desc("o_totalprice"), F.col("o_orderkey")]).select("c_custkey", "o_orderkey")


@query("SELECT o_orderkey, CAST(coalesce(sum(o_orderkey % 97) OVER (ORDER BY o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start FROM orders")
def w6_prefix_sums(spark, sf_dir):
    """Where each shard begins in the whole: sums in spans of keys first, so no task sorts all."""
    rows = table(spark, sf_dir, "orders").select("o_orderkey", (F.col("o_orderkey") % 97).alias("n"), F.lit(0).alias("all"))
    return S.running(rows, ["all"], ["o_orderkey"], "n", span=F.floor(F.col("o_orderkey") / 4096)).select("o_orderkey", "start")


@query("SELECT doc_id, CAST(row_number() OVER (ORDER BY sha256(text), doc_id) - 1 AS BIGINT) AS place FROM documents")
def l1_l3_sorted_places(spark, sf_dir):
    """The place of each document in the order of digests: runs by the digest's first letters, sorted by themselves and put one after the other."""
    rows = table(spark, sf_dir, "documents").select("doc_id", H.sha256(F.col("text")).alias("digest"), F.lit(1).alias("n"), F.lit(0).alias("all"))
    return S.running(rows, ["all"], ["digest", "doc_id"], "n", span=F.substring("digest", 1, 2)).select("doc_id", F.col("start").alias("place"))


@query("SELECT doc_id, text FROM documents WHERE doc_id % 3 = 0")
def l12_keys_first(spark, sf_dir):
    """A plan on keys alone, then the texts of what it chose; the same rows as by one pass."""
    keys = table(spark, sf_dir, "documents").select("doc_id").where("doc_id % 3 = 0")
    return table(spark, sf_dir, "documents").select("doc_id", "text").join(keys, "doc_id", "left_semi")


@query("SELECT CAST(sum(length(text)) AS BIGINT) AS chars, count(*) AS rows, true AS ordered FROM documents")
def o5_ordered_shards(spark, sf_dir):
    """Shards written in ranges of keys: one after the other they are the whole in order."""
    path = _scratch(spark)
    table(spark, sf_dir, "documents").select("doc_id", "text").repartitionByRange(8, "doc_id").sortWithinPartitions("doc_id").write.parquet(path)
    back = spark.read.parquet(path)
    files = back.groupBy(F.col("_metadata.file_name").alias("f")).agg(F.min("doc_id").alias("a"), F.max("doc_id").alias("b"), F.sum(F.length("text")).alias("chars"), F.count("*").alias("n"))
    before = F.lag("b").over(Window.orderBy("f"))
    return files.withColumn("ok", F.coalesce(before < F.col("a"), F.lit(True))).agg(F.sum("chars").alias("chars"), F.sum("n").alias("rows"), F.bool_and("ok").alias("ordered"))


@query("SELECT min(conv_id * 1000 + turn) AS first, sha256(t) AS digest FROM (SELECT conv_id, turn, 'Turn ' || turn || chr(10) || chr(10) || text AS t FROM conversations WHERE length(text) >= 120) GROUP BY sha256(t)")
def a35_p13_discussion_dedup(spark, sf_dir):
    """Discussion fragments of 120 characters or more under their titles, each digest once."""
    rows = table(spark, sf_dir, "conversations").where(F.length("text") >= 120).select((F.col("conv_id") * 1000 + F.col("turn")).alias("id"), H.sha256(F.concat(F.lit("Turn "), F.col("turn").cast("string"), F.lit("\n\n"), F.col("text"))).alias("digest"))
    return rows.groupBy("digest").agg(F.min("id").alias("first")).select("first", "digest")


@query(f"SELECT dedup_hash, arg_min(doc_id, struct_pack(a := -priority, b := quality_score < 0, c := -quality_score, d := doc_id)) AS doc_id, count(*) AS occurrences FROM ({_KEYED}) GROUP BY dedup_hash")
def a21_r6_compaction(spark, sf_dir):
    """An index of batches compacted twice while it is read: winners and occurrences are those of the parts, and the snapshot stays whole."""
    rows = keyed(spark, sf_dir).select("dedup_hash", "doc_id", "priority", "quality_score")
    order = lambda: [-F.col("priority"), F.col("quality_score") < 0, -F.col("quality_score"), F.col("doc_id")]
    index = J.Index(spark, _scratch(spark), "dedup_hash", "doc_id", order)
    for i in range(4):
        index.ingest(rows.where(F.col("doc_id") % 4 == i), i)
    index.ingest(rows.where("doc_id % 4 = 1"), "again")
    snapshot = index.winners()
    compacted = index.compact(_scratch(spark)).compact(_scratch(spark))
    same = compacted.winners().select("dedup_hash", "doc_id", "occurrences")
    return same.intersect(snapshot.select("dedup_hash", "doc_id", "occurrences"))


@query("WITH e AS (SELECT event_id, user_id, event_type FROM events), ok AS (SELECT * FROM e WHERE event_id % 10 <> 0) SELECT event_type, count(*) AS admitted, count(*) >= 50 AS ready FROM ok GROUP BY event_type")
def r1_r8_admission_states(spark, sf_dir):
    """Events of a journal admitted batch by batch, failed ones marked; a stratum is ready when it has enough."""
    path, target = _scratch(spark), _scratch(spark)
    body = F.to_json(F.struct("event_id", "event_type", "user_id"))
    table(spark, sf_dir, "events").select(body.alias("b")).select(F.to_json(F.struct(F.col("b").alias("body"), F.sha2(F.col("b").cast("binary"), 256).alias("event_sha256"))).alias("value")).repartition(6).write.text(path)
    index = J.Index(spark, target, "event_id", "user_id", lambda: [F.col("user_id")])
    stream = J.tail(spark, path, "event_id bigint, event_type string, user_id bigint", files=2).withColumn("failed", F.col("event_id") % 10 == 0)
    index.feed(stream, _scratch(spark)).awaitTermination()
    return J.states(index.occurrences(), "event_type", 50)


@query()
def l13_shard_places(spark, sf_dir):
    """Sources put into shards of equal size, from a hashed start on the first with room; one after the other by nature, over one row a source; tested by hand."""
    sizes = {r["source"]: r["n"] for r in table(spark, sf_dir, "documents").groupBy("source").agg(F.count("*").alias("n")).collect()}
    names, total = sorted(sizes), sum(sizes.values())
    starts = [int(D.sha_number(name), 16) for name in names]
    places = E.shard_places([sizes[n] for n in names], -(-total // 8), 9, starts)
    return spark.createDataFrame([(n, *p) for n, own in zip(names, places) for p in own], "source string, shard int, offset bigint, length bigint")


@query()
def l18_balanced_fill(spark, sf_dir):
    """Strata taken first to each language's minimum, then always from the language with the fewest characters, until the target; over one row a stratum."""
    strata = table(spark, sf_dir, "documents").groupBy("lang", "source").agg(F.sum("n_chars").alias("n")).orderBy("lang", "source").toPandas()
    return spark.createDataFrame(E.balanced_fill(strata, {"en": int(strata["n"].max())}, int(strata["n"].sum()) // 2, "lang", "n"))


@query(f"WITH c AS (SELECT {_CANON} AS c, doc_id FROM documents), g AS (SELECT c, min(doc_id) AS first FROM c GROUP BY c) SELECT doc_id, first AS component FROM c JOIN g ON c.c = g.c WHERE doc_id <> first")
def a12_a13_component_removals(spark, sf_dir):
    """Removals of all components but their winners, each once; links of equal texts make components whose answer is known."""
    from ..operators import graph as G

    rows = table(spark, sf_dir, "documents").select("doc_id", T.canonical(F.col("text")).alias("c"))
    links = rows.join(rows.groupBy("c").agg(F.min("doc_id").alias("v")), "c").where("doc_id <> v").select(F.col("doc_id").alias("u"), "v")
    found = G.connected_components(links)
    return found.where("node <> component").select(F.col("node").alias("doc_id"), "component").distinct()
