"""The training-data operators against brute force, on odd inputs: nulls, empty and long texts, ties, copies, empty tables, extra columns."""

import hashlib
import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from oracle import both, duck
from pyspark.sql import functions as F

from lakemill.llm import chunk_encoding, language_id, line_dedup, packing, quality_rules, queries, shared, simhash, suffix_dedup, token_files, tokens, topk, url_filters

SF = "/root/testdata/sf0.001"
VOCABULARY = tokens.vocabulary()
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, fp string, h long, rank int, pos string"
_r = random.Random(5)
WORDS = [f"w{i}" for i in range(30)]
PROSE = [" ".join(_r.choice(WORDS) for _ in range(80)) for _ in range(4)]
LINES = [" ".join(_r.choice(WORDS) for _ in range(9)) for _ in range(6)]
TEXTS = [
    None, "", "   \n\t\n", "x", "Word", "É è\u0301 ß 中文 \U0001f600 İ Σας", "a" * 5000, "ab " * 3000, "x<|endoftext|>y <|startoftext|>", "it's DON'T we'LL 12 ½",
    PROSE[0], PROSE[0], PROSE[0] + " tail", "head " + PROSE[1], PROSE[1] + "\n" + PROSE[2], PROSE[2].upper(),
    "\n".join(LINES[:4]), "\n".join(["new", *LINES[:3], "", LINES[3], "end"]), "\n".join([LINES[5]] * 5), LINES[4], LINES[4],
    " ".join(_r.choice(WORDS) for _ in range(30_000)), "\x1c a\x1cb\x85c\u2028d", "no\u00a0break \ufeff", "!!! ### $$$ ||| <>" * 20,
]


def rows(texts=TEXTS):
    out = [(i, t, ["en", "de", None][i % 3], "s", None if t is None else len(t), "f", i, i, "p") for i, t in enumerate(texts)]
    return out


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(rows(), SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def got(df, *columns):
    return sorted((tuple(r[c] for c in columns) for r in df.collect()), key=str)


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_same_rows_as_sql(spark, name):
    a, b = both(spark, duck(SF), queries.QUERIES[name], queries.SQL[name], SF)
    assert a == b


# tokens


def library():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(VOCABULARY)
    t.no_truncation()
    t.no_padding()
    return t


def ids_of(text):
    return library().encode(text or "", add_special_tokens=False).ids


def raw(ids):
    return np.array(ids, "<u4").tobytes()


def test_words_give_the_ids_of_the_whole():
    e = tokens.Encoder(VOCABULARY, most=50)
    assert e.by_word
    for _ in range(2):
        assert e.encode(TEXTS) == [raw(ids_of(t)) for t in TEXTS]


def test_long_calls_go_in_halves(monkeypatch):
    monkeypatch.setattr(tokens, "AT_ONCE", 100)
    assert tokens.Encoder(VOCABULARY).encode(TEXTS) == [raw(ids_of(t)) for t in TEXTS]


def test_words_below_u0250():
    r = random.Random(1)
    alphabet = [chr(c) for c in range(0x21, 0x260)] + [" ", "\n", "'", "s"] * 20
    texts = ["".join(r.choice(alphabet) for _ in range(40)) for _ in range(300)]
    assert tokens.Encoder(VOCABULARY).encode(texts) == [raw(library().encode(t, add_special_tokens=False).ids) for t in texts]


def test_op5_round_trip(docs, none):
    t = library()
    want = sorted([(i, len(ids := ids_of(x)), hashlib.sha256(raw(ids)).hexdigest(), hashlib.sha256(t.decode(ids, skip_special_tokens=False).encode()).hexdigest()) for i, x in enumerate(TEXTS)], key=str)
    assert got(chunk_encoding.encode_decode(docs, VOCABULARY), "doc_id", "n_tokens", "ids_sha256", "decoded_sha256") == want
    assert chunk_encoding.encode_decode(none, VOCABULARY).collect() == []


def test_chunks_are_content_defined_and_whole_characters():
    data = ("é中 " + PROSE[3]).encode() * 20
    ends = chunk_encoding.cuts(data, bits=5)
    assert ends[-1] == len(data) and ends == sorted(set(ends))
    last = 0
    for e in ends:
        data[last:e].decode()
        last = e
    shifted = chunk_encoding.cuts(b"zz" + data, bits=5)
    assert len({e - 2 for e in shifted} & set(ends)) > 0.9 * len(ends)


@pytest.mark.parametrize("most", [0, 3, 40])
def test_op5_full_store(monkeypatch, most):
    monkeypatch.setattr(chunk_encoding, "MOST_CHUNKS", most)
    coder = chunk_encoding.ChunkEncoder(tokens.Encoder(VOCABULARY))
    texts = [t * 3 if t else t for t in TEXTS]
    for batch in (texts, texts[::-1], texts[5:9], texts):
        assert coder.encode(batch) == [raw(ids_of(t)) for t in batch]
        assert len(coder.kept) <= max(most, 0)


def test_op3_places(docs, none):
    out = packing.best_fit_packing(docs, VOCABULARY, capacity=64).collect()
    by_doc, by_seq = defaultdict(list), defaultdict(list)
    for r in out:
        by_doc[r["doc_id"]].append(r)
        by_seq[r["sequence_id"]].append(r)
    for i, t in enumerate(TEXTS):
        ids = [*ids_of(t), 0]
        own = sorted(by_doc[i], key=lambda r: r["piece"])
        assert [(r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in own] == [(k, s, len(p), zlib.crc32(raw(p))) for k, s in enumerate(range(0, len(ids), 64)) for p in [ids[s : s + 64]]]
    for own in by_seq.values():
        at = 0
        for r in sorted(own, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= 64
    assert packing.best_fit_packing(none, VOCABULARY).collect() == []


def best_fit(lengths, capacity):
    """One by one: pairs of large ones, then the smallest gap that holds each smaller one."""
    large = sorted(x for x in lengths if 3 * x > capacity)
    gaps = []
    while large:
        a = large.pop()
        k = max((i for i, x in enumerate(large) if x <= capacity - a), default=None)
        gaps.append(capacity - a - (0 if k is None else large.pop(k)))
    for x in sorted((x for x in lengths if 3 * x <= capacity), reverse=True):
        fit = min((g for g in gaps if g >= x), default=None)
        if fit is None:
            gaps.append(capacity - x)
        else:
            gaps[gaps.index(fit)] = fit - x
    return len(gaps)


@pytest.mark.parametrize("seed", range(40))
def test_plan_is_best_fit_on_counts(seed):
    r = random.Random(seed)
    capacity = r.choice([10, 37, 100])
    lengths = [r.randint(1, capacity) for _ in range(r.randint(0, 120))]
    used = set()
    for length, _, number, first, each, _ in packing.plan(dict(Counter(lengths)), capacity):
        used |= {first + j // each for j in range(number)}
    assert len(used) == best_fit(lengths, capacity)


def test_op6_files(docs, none):
    want, at = [], 0
    for i, t in enumerate(TEXTS):
        ids = [*ids_of(t), 1]
        want.append((i, at, len(ids), zlib.crc32(raw(ids))))
        at += len(ids)
    assert got(token_files.token_digests(docs, VOCABULARY), "doc_id", "start", "n_tokens", "ids_crc32") == sorted(want, key=str)
    assert token_files.token_digests(none, VOCABULARY).collect() == []


def test_op6_texts_come_back(docs):
    folder = token_files.write_token_files(docs, VOCABULARY, 1)
    # another session has nothing but the folder
    back = {r["doc_id"]: bytes(r["ids"]) for r in token_files.read_token_files(docs.sparkSession.newSession(), folder).collect()}
    by_rank = token_files.open_token_files(docs.sparkSession, folder)[1]
    assert back == {i: raw([*ids_of(t), 1]) for i, t in enumerate(TEXTS)}
    counts = Counter(x for t in TEXTS for x in [*ids_of(t), 1])
    assert [counts[x] for x in by_rank.tolist()] == sorted(counts.values(), reverse=True)


@pytest.mark.parametrize("n", [0, 1, 3, 4, 5, 1000])
def test_variable_length_coding(n):
    r = np.random.default_rng(n)
    x = (r.integers(0, 1 << 32, n, dtype=np.uint64) >> r.integers(0, 32, n).astype(np.uint64)).astype(np.uint32)
    assert (token_files.unpack_ranks(*token_files.pack_ranks(x), n) == x).all()


# op1


def counts_by_hand(text):
    import re

    words = [w for w in re.split(r"[\x20\x09-\x0D]+", text or "") if w]
    grams = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    twice = Counter(grams)
    covered = {j for i, g in enumerate(grams) if twice[g] > 1 for j in (i, i + 1, i + 2)}
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(words), sum(map(len, words)), sum((text or "").count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(covered)


def test_op1_counts(docs, none, spark):
    labels = spark.createDataFrame([(3, 1), (4, None), (None, 0), (99, 1)], "doc_id long, quality int")
    want = []
    for i, t in enumerate(TEXTS):
        c = counts_by_hand(t)
        failed = c[0] < 50 or 100 * c[4] > 50 * c[0]
        want.append((i, *c, failed, not failed))
    out = quality_rules.quality_rules(docs, labels)
    assert got(out, "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept") == sorted(want, key=str)
    assert quality_rules.quality_rules(none, labels).collect() == []


def test_op1_cutoffs_are_certified(spark):
    r = random.Random(3)
    good = [" ".join(f"a{r.randrange(10**6)}" for _ in range(80)) for _ in range(1500)]
    bad = [t.replace(" ", "%%% ") for t in good[:200]]
    data = [(i, t, "en", "s") for i, t in enumerate(good + bad)] + [(5000 + i, t, "xx", "s") for i, t in enumerate(bad[:20])]
    docs = spark.createDataFrame(data, "doc_id long, text string, lang string, source string")
    labels = spark.createDataFrame([(i, int(i < 1500)) for i in range(1700)] + [(5000 + i, 0) for i in range(20)], "doc_id long, quality int")
    out = {x["doc_id"]: x for x in quality_rules.quality_rules(docs, labels).collect()}
    assert all(out[i]["kept"] for i in range(1500))
    assert not any(out[i]["kept"] for i in range(1500, 1700)) and out[1500]["rejected_by"] == ["symbols"]
    assert all(out[5000 + i]["kept"] for i in range(20))  # too few labels of that stratum


def test_op1_exact_tail(spark):
    value = lambda i: 90 if i < 20 else 10 if i < 54 else 0
    bad = lambda i: i < 20 or 24 <= i < 54
    counts = spark.createDataFrame([(i, i, i, "en", 100, 100, value(i), 0, 0, 1, 0, 0) for i in range(1023)], "doc_id long, ta long, tb long, stratum string, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, n_lines long, n_exclaims long, n_bars long")
    labels = spark.createDataFrame([(i, int(not bad(i))) for i in range(1023)], "doc_id long, quality int")
    n, lost, alpha = 1023 - 50, 4, 0.01
    tail = sum(math.comb(n, k) * alpha**k * (1 - alpha) ** (n - k) for k in range(lost + 1))
    # five rules in one stratum share delta; the lower cutoff loses four good documents and catches thirty more bad ones
    for delta, cutoff in ((tail * 5 * 0.999, 45), (tail * 5 * 1.001, 5)):
        assert [tuple(r) for r in quality_rules.cutoffs(counts, labels, delta=delta, cost=1.0).collect()] == [("en", "symbols", cutoff)]
    assert quality_rules.cutoffs(counts, labels, delta=tail * 5 * 1.001, cost=20.0).first()["cutoff"] == 45


def test_op1_copies_are_one_trial(spark):
    r = random.Random(3)
    good = [" ".join(f"a{r.randrange(10**6)}" for _ in range(80)) for _ in range(300)]
    bad = [t.replace(" ", "%%% ") for t in good[:100]]
    texts = good * 4 + bad
    docs = spark.createDataFrame([(i, t, "en", "s") for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string")
    labels = spark.createDataFrame([(i, int(i < 1200)) for i in range(1300)] * 2, "doc_id long, quality int")
    # 1200 good documents would certify a cutoff, 300 different texts do not: 0.99 ** 300 > 0.05 / 5 > 0.99 ** 1200
    assert all(x["kept"] for x in quality_rules.quality_rules(docs, labels).collect())


def test_op1_query_with_certified_cutoffs(spark, tmp_path):
    r = random.Random(9)
    good = [" ".join(f"a{r.randrange(10**6)}" for _ in range(80)) for _ in range(800)]
    texts = good + [t.replace(" ", "%%% ") for t in good[:90]] + [t + " !!!" * 40 for t in good[:70]]
    data = [(i, t, "en" if i < 900 or i % 2 else "de", "s", len(t)) for i, t in enumerate(texts)]
    spark.createDataFrame(data, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(i, int(i < 800), 0) for i in range(len(texts))], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    import duckdb

    con = duckdb.connect()
    for t in ("documents", "labels"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{tmp_path}/{t}.parquet/*.parquet')")
    a, b = both(spark, con, queries.op1_quality_rules, queries.SQL["op1_quality_rules"], str(tmp_path))
    assert a == b
    kept = {x["doc_id"]: x["kept"] for x in queries.op1_quality_rules(spark, str(tmp_path)).collect()}
    assert all(kept[i] for i in range(800)) and not any(kept[i] for i in range(800, 890)) and 0 < sum(kept[i] for i in range(890, 960)) < 70


# op2


def test_op2_accuracy(spark):
    out = queries.op2_language_id(spark, "/root/testdata/sf0.01").collect()
    lang = {r["doc_id"]: r["lang"] for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()}
    held = [r for r in out if r["held_out"]]
    assert {r["doc_id"] for r in held} == {i for i in lang if zlib.crc32(str(i).encode()) % 4 == 2}
    assert np.mean([r["lang_pred"] == lang[r["doc_id"]] for r in held]) > 0.98
    assert all(0 <= r["score"] <= 1 for r in out)


def test_op2_odd_texts(docs, none):
    model = language_id.fit(docs, F.lit(True))
    assert model.languages == ["de", "en"]
    out = {r["doc_id"]: r for r in language_id.predict(docs, model, F.lit(False)).collect()}
    for i, t in enumerate(TEXTS):
        assert (out[i]["lang_pred"] == "und") == (not t or not any(map(str.isalpha, t)))
    empty = language_id.fit(none, F.lit(True))
    assert {r["lang_pred"] for r in language_id.predict(docs, empty, F.lit(False)).collect()} == {"und"}
    assert language_id.predict(none, model, F.lit(False)).collect() == []


def test_op2_blocks_do_not_matter(monkeypatch):
    t = "".join(TEXTS[5:8])
    whole = language_id.counts_of(t, 3, 12)
    monkeypatch.setattr(language_id, "_AT_ONCE", 7)
    assert (language_id.counts_of(t, 3, 12) == whole).all() and whole.sum() == 3 * len(t.lower()) - 3


def test_op2_is_naive_bayes():
    model = language_id.Model(["a", "b"], np.log([0.5, 0.5]), np.log(np.random.default_rng(0).random((1 << 8, 2))), 2, 8)
    text = "Hello there"
    logs = model.prior + sum(model.log_p[x] for b in language_id.buckets_of(text, 2, 8) for x in b)
    names, scores = model.score([text])
    assert names == [["a", "b"][int(logs.argmax())]] and abs(scores[0] - 1 / np.exp(logs - logs.max()).sum()) < 1e-9


# op4


def brute_repeats(texts, length):
    data = [(t or "").encode() for t in texts]
    seen = Counter(d[i : i + length] for d in data for i in range(len(d) - length + 1))
    out = []
    for d in data:
        gone = [False] * len(d)
        for i in range(len(d) - length + 1):
            if seen[d[i : i + length]] > 1:
                gone[i : i + length] = [True] * length
        kept = bytes(x for x, g in zip(d, gone) if not g)
        out.append((len(d), sum(gone), sum(g and (i == 0 or not gone[i - 1]) for i, g in enumerate(gone)), hashlib.sha256(kept).hexdigest()))
    return out


@pytest.mark.parametrize("most", [50_000, 2])
def test_op4_brute_force(spark, docs, none, most):
    texts = [t if t is None or len(t) < 20_000 else t[:20_000] for t in TEXTS]
    r = random.Random(2)
    base = ["".join(r.choice("ab") for _ in range(300)) for _ in range(5)]
    texts += [r.choice(base)[r.randrange(90) :][: r.randrange(80, 250)] + r.choice(["", "z", "é"]) + r.choice(base)[r.randrange(90) :] for _ in range(60)]
    for length in (64, 200):
        out = suffix_dedup.suffix_dedup(spark.createDataFrame(rows(texts), SCHEMA).repartition(4), length=length, most=most, carry=("lang", "rank"))
        want = [(i, *x) for i, x in enumerate(brute_repeats(texts, length))]
        assert got(out, "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256") == sorted(want, key=str)
    assert suffix_dedup.suffix_dedup(none, most=most).collect() == []


def test_op4_blocks_do_not_matter(monkeypatch):
    data = (PROSE[0] + PROSE[1] + "x" * 400 + PROSE[0]).encode()
    whole = suffix_dedup.anchors(data, 200)
    monkeypatch.setattr(suffix_dedup, "_AT_ONCE", 33)
    parts = suffix_dedup.anchors(data, 200)
    assert (whole[0] == parts[0]).all() and (whole[1] == parts[1]).all()


# op7


def test_op7_trie():
    rules = queries.URL_RULES
    r = random.Random(4)
    hosts = ["example.com", "www.example.com", "a.www.example.com", "EXAMPLE.net", "net", "com", "xcom", "example.org", "", "notexample.com", "example.com:80", "com."]
    paths = ["", "/", "/en", "/en/", "/en/1", "/es/x?y", "/fr/#z", "/EN/", "//en/", "?q=/en/", "#/en/"]
    urls = [None, "", "nothing", "http:/x", "://", "a://://b/en/"] + [f"http://{h}{p}" for h in hosts for p in paths] + [f"https://u@{r.choice(hosts)}{r.choice(paths)}" for _ in range(20)]
    trie = url_filters.Trie(rules)

    def plain(url):
        host, path = url_filters.split_url(url)
        fits = [(len(h + p), v == "block", h + p, v) for v, h, p in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
        return max(fits)[2:] if fits else None

    for u in urls:
        host, path = url_filters.split_url(u)
        assert (trie.match(host, path) if host else None) == plain(u), u


def test_op7_rows(spark):
    pages = spark.createDataFrame([(1, None, "h", "x"), (None, "http://a.com/", "h", "x"), (1, None, "h", "x")], "page_id long, url string, host string, rule string")
    assert got(url_filters.url_verdicts(pages, queries.URL_RULES), "page_id", "host", "path", "rule", "verdict") == sorted([(1, "", "", None, "allow")] * 2 + [(None, "a.com", "/", "com/", "allow")], key=str)


# op8


def fingerprint_by_hand(text):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    n = min(3, len(words))
    hs = [xxhash.xxh64_intdigest(b" ".join(words[i : i + n]), 42) for i in range(len(words) - n + 1)]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def groups_by_hand(fps, ids, radius):
    parent = list(range(len(fps)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= radius:
                parent[root(i)] = root(j)
    least = {}
    for i, x in enumerate(ids):
        least[root(i)] = min(x, least.get(root(i), x))
    return [least[root(i)] for i in range(len(ids))]


def test_op8_documents(docs, none):
    fps = [fingerprint_by_hand(t) for t in TEXTS]
    want = [(i, f"{f:016x}", g) for i, (f, g) in enumerate(zip(fps, groups_by_hand(fps, range(len(TEXTS)), 2)))]
    assert got(simhash.near_duplicates(docs), "doc_id", "fingerprint", "component_id") == sorted(want, key=str)
    assert simhash.near_duplicates(none).collect() == []


@pytest.mark.parametrize("block", [1024, 4])
def test_op8_links(spark, block):
    r = random.Random(block)
    fps = [r.getrandbits(64) for _ in range(40)]
    for _ in range(160):
        fps.append(r.choice(fps) ^ (1 << r.randrange(64)) ^ (1 << r.randrange(64)))
    fps = sorted({f - (1 << 64) if f >> 63 else f for f in fps} | {0, -1, 1})
    links = [(a, b) for a, b in map(tuple, simhash.links(spark.createDataFrame([(f,) for f in fps], "fp long"), block=block).collect())]
    assert all(((a ^ b) & (1 << 64) - 1).bit_count() <= 2 for a, b in links)
    roots = {x["node"]: x["root"] for x in shared.components(spark.createDataFrame(links, "u long, v long")).collect()}
    assert [roots.get(f, f) for f in fps] == groups_by_hand([f & (1 << 64) - 1 for f in fps], fps, 2)


@pytest.mark.parametrize("edges", [[], [(1, 1)], [(i, i + 1) for i in range(40)], [(0, i) for i in range(1, 30)], [(9, 3), (3, 9), (4, 9), (7, 8)]])
def test_components(spark, edges):
    out = {x["node"]: x["root"] for x in shared.components(spark.createDataFrame(edges, "u long, v long")).collect()}
    ids = sorted({x for e in edges for x in e})
    parent = {i: i for i in ids}
    for _ in ids:
        for a, b in edges:
            parent[a] = parent[b] = min(parent[a], parent[b])
    assert {i: out.get(i, i) for i in ids} == parent


# op9


def test_op9_ties_and_gaps(spark, monkeypatch):
    monkeypatch.setattr(topk, "LANE", 8)
    monkeypatch.setattr(topk, "QUERIES", 2)
    r = random.Random(6)
    data = [(i, [r.choice([-1.0, 0.0, 0.5, 0.126]) for _ in range(4)], 0, 0) for i in range(60)] + [(60, None, 0, 0), (61, [1.0, None, 0.0, 0.0], 0, 0), (62, [float("nan")] * 4, 0, 0), (63, [float("inf")] * 4, 0, 0), (None, [1.0] * 4, 0, 0), (70, [1.0, 2.0], 0, 0), (80, [3.0, 4.0], 0, 0), (90, [], 0, 0)]
    df = spark.createDataFrame(data, "vec_id long, embedding array<float>, score int, rank int")
    sound = [(i, [math.floor(256 * float(np.float32(x))) for x in v]) for i, v, _, _ in data if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    want = []
    for i, q in sound:
        if i % 10 == 0:
            best = sorted((-sum(a * b for a, b in zip(q, v)), j) for j, v in sound if j != i and len(v) == len(q))[:5]
            want += [(i, k + 1, j, -s) for k, (s, j) in enumerate(best)]
    assert got(topk.top_k(df, F.col("vec_id") % 10 == 0), "query_id", "rank", "vec_id", "score") == sorted(want, key=str)
    assert topk.top_k(df.where("vec_id = 999"), F.col("vec_id") % 10 == 0).collect() == []


def test_op9_trees_skip_but_lose_nothing():
    r = np.random.default_rng(0)
    x = np.floor(256 * (r.normal(size=(3000, 8)) + 4 * r.integers(-3, 4, (3000, 1))))
    ids = r.permutation(3000).astype(np.int64)
    best = topk.Best(50, 5)
    rows = np.arange(3000)
    topk.visit(topk.tree(x, rows), np.arange(50), x[:50], np.sqrt((x[:50] ** 2).sum(axis=1)), rows[:50], x, ids, rows, best)
    for k in range(50):
        order = sorted((-int(s), i) for s, i in zip((x @ x[k]).tolist(), ids.tolist()) if i != ids[k])[:5]
        assert list(zip((-best.score[k]).tolist(), best.id[k].tolist())) == order


# op10


@pytest.mark.parametrize("size", [1, 2, 3, 5])
def test_op10_brute_force(spark, none, size):
    r = random.Random(size)
    texts = TEXTS[:20] + ["\n".join(r.choice([*LINES, "", "one", "two"]) for _ in range(r.randrange(14))) for _ in range(30)]
    df = spark.createDataFrame(rows(texts), SCHEMA).repartition(3)
    has = lambda x: bool(x.strip(" \t\n\x0b\x0c\r"))
    seen, want = set(), []
    for i, t in enumerate(texts):
        lines = (t or "").split("\n")
        at = [k for k, x in enumerate(lines) if has(x)]
        gone = set()
        for p in range(len(at) - size + 1):
            run = tuple(lines[k] for k in at[p : p + size])
            if run in seen:
                gone |= set(range(p, p + size))
            seen.add(run)
        out = {at[p] for p in gone}
        kept = t if not gone else "\n".join(x for k, x in enumerate(lines) if k not in out)
        want.append((i, kept, len(at), len(gone), sum(p - 1 not in gone for p in gone), "p"))
    assert got(line_dedup.line_dedup(df, size), "doc_id", "text", "n_lines", "n_removed", "n_runs", "pos") == sorted(want, key=str)
    assert line_dedup.line_dedup(none, size).collect() == []


# rows that share an id, or have none, and rows alike in all columns

_s = random.Random(21)
_line = lambda n: " ".join("".join(_s.choice("abcdefghij") for _ in range(6)) for _ in range(n))
_passage, _lines = _line(60), [_line(12) for _ in range(4)]
SHARED = [
    (1, _line(100)), (1, f"{_line(40)} {_passage} {_line(40)}"), (None, _line(90)), (None, f"{_passage} {_line(30)}"), (None, "\n".join(_lines)), (1, "\n".join(["head", *_lines])),
    (2, "\n".join(_line(9) for _ in range(4))), (2, "\n".join([*_lines[:2], _line(9)])), (5, _line(120)), (5, _line(120)), (7, "alike " + _line(50)), (None, None), (None, ""), (1, None),
]
SHARED += [SHARED[10], SHARED[10], SHARED[4]]
CLASH = "doc_id long, text string, lang string, source string, n_chars long, _id long, _gone long, _gone_id long, spans long, n_bytes long, kept_sha256 long, n_removed long, n_spans long, ra long, rb long, gone long, row long, carried long, t long, k long, a long, h long, id long, d long"


@pytest.fixture(scope="module")
def clash(spark):
    return spark.createDataFrame([(i, t, "en", "s", 0, *range(100, 119)) for i, t in SHARED], CLASH).repartition(3)


def test_shared_ids_op4(clash):
    want = sorted(((i, *x) for (i, _), x in zip(SHARED, brute_repeats([t for _, t in SHARED], 200))), key=str)
    out = suffix_dedup.suffix_dedup(clash, carry=("spans", "n_bytes", "carried", "ra"))
    assert got(out, "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256") == want
    assert {tuple(r["carried"]) for r in out.collect()} == {(103, 104, 112, 108)}


def test_shared_ids_op8(clash):
    fps = [fingerprint_by_hand(t) for _, t in SHARED]
    parent = groups_by_hand(fps, range(len(fps)), 2)
    want = [(i, f"{f:016x}", min((SHARED[j][0] for j, p in enumerate(parent) if p == g and SHARED[j][0] is not None), default=None)) for (i, _), f, g in zip(SHARED, fps, parent)]
    assert got(simhash.near_duplicates(clash), "doc_id", "fingerprint", "component_id") == sorted(want, key=str)


def test_shared_ids_op3_op5_op6(clash):
    ids = {t: ids_of(t) for _, t in SHARED}
    out = sorted(token_files.token_digests(clash, VOCABULARY).collect(), key=lambda r: r["start"])
    at = 0
    for r in out:
        assert r["start"] == at
        at += r["n_tokens"]
    keys = [r["doc_id"] for r in out]
    assert keys == sorted(keys, key=lambda k: -1 if k is None else k)
    assert Counter((r["doc_id"], r["ids_crc32"]) for r in out) == Counter((i, zlib.crc32(raw([*ids[t], 1]))) for i, t in SHARED)
    # rows of one id follow each other in the order of their texts' hashes, whatever the partitions
    again = sorted(token_files.token_digests(clash.repartition(5), VOCABULARY).collect(), key=lambda r: r["start"])
    assert [(r["doc_id"], r["ids_crc32"]) for r in out] == [(r["doc_id"], r["ids_crc32"]) for r in again]
    packed = packing.best_fit_packing(clash, VOCABULARY, capacity=64).collect()
    assert Counter((r["doc_id"], r["piece"], r["ids_crc32"]) for r in packed) == Counter((i, k, zlib.crc32(raw(p))) for i, t in SHARED for k, p in enumerate([*ids[t], 0][s : s + 64] for s in range(0, len(ids[t]) + 1, 64)))
    assert len({(r["sequence_id"], r["offset"]) for r in packed}) == len(packed)
    coded = chunk_encoding.encode_decode(clash, VOCABULARY).collect()
    assert Counter((r["doc_id"], r["ids_sha256"]) for r in coded) == Counter((i, hashlib.sha256(raw(ids[t])).hexdigest()) for i, t in SHARED)


def test_shared_ids_op1_op2(spark, clash):
    labels = spark.createDataFrame([(1, 1), (1, 0), (None, 0)], "doc_id long, quality int")
    out = quality_rules.quality_rules(clash, labels).collect()
    assert Counter((r["doc_id"], r["n_words"], r["n_repeat_words"]) for r in out) == Counter((i, counts_by_hand(t)[0], counts_by_hand(t)[4]) for i, t in SHARED)
    model = language_id.fit(clash, F.lit(True))
    assert Counter((r["doc_id"], r["lang_pred"]) for r in language_id.predict(clash, model, F.lit(False)).collect()) == Counter((i, "en" if t else "und") for i, t in SHARED)


def test_joins_are_repaired_until_they_agree():
    """An encoder whose ids depend on the word before: joins agree only when the chunks are one."""

    class Chained:
        by_word = True

        def encode(self, texts):
            out = []
            for t in texts:
                words, ids = (t or "").split(), []
                for before, w in zip(["", *words], words):
                    ids.append(hash((before[-1:] if before[-1:] == "q" else "", w)) & 0xFFFFFFFF)
                out.append(raw(ids))
            return out

    r = random.Random(7)
    texts = [" ".join(r.choice(["aq", "b", "cc", "dq"]) + str(r.randrange(9)) * r.randrange(2) for _ in range(n)) for n in (0, 1, 3, 5, 40, 400, 900)]
    texts += [t.replace(" ", "") for t in texts[:5]] + ["x" * 3000 + " y z", " ".join("q" for _ in range(2000))]
    coder = chunk_encoding.ChunkEncoder(Chained())
    plain = tokens.Encoder(VOCABULARY)
    assert chunk_encoding.ChunkEncoder(plain).encode(texts) == [raw(ids_of(t)) for t in texts]
    words = Chained()
    words.encode = lambda ts: [raw([hash(w) & 0xFFFFFFFF for w in (t or "").split()]) for t in ts]
    assert chunk_encoding.ChunkEncoder(words).encode(texts) == words.encode(texts)
    assert all(len(x) % 4 == 0 for x in coder.encode(texts))


def test_shared_ids_op9(spark, monkeypatch):
    monkeypatch.setattr(topk, "LANE", 3)
    data = [(50, [1.0, 0.0]), (50, [0.5, 0.5]), (7, [1.0, 1.0]), (None, [9.0, 9.0]), (100, [1.0, 0.0]), (100, [1.0, 0.0]), (9, [1e30, -1e30]), (8, [1e30, 1e30]), (150, [-3e30, 2e29]), (11, [3e37, 1.0])]
    df = spark.createDataFrame(data, "vec_id long, embedding array<double>")
    sound = [(n, i, [math.floor(256 * x) for x in v]) for n, (i, v) in enumerate(data) if i is not None]
    want = []
    for n, i, q in sound:
        if i % 50 == 0:
            scored = sorted((-max(-(2**63) + 1, min(2**63 - 1, sum(a * b for a, b in zip(q, v)))), j) for m, j, v in sound if m != n)[:5]
            want += [(i, k + 1, j, -s) for k, (s, j) in enumerate(scored)]
    assert got(topk.top_k(df, F.col("vec_id") % 50 == 0), "query_id", "rank", "vec_id", "score") == sorted(want, key=str)


def runs_by_hand(rows_, size, words):
    """The kept texts: rows alike in id and text are one document; documents in order of id and row key."""
    has = lambda x: bool(x.strip(" \t\n\x0b\x0c\r"))
    seen, kept = set(), {}
    for i, t in rows_:
        lines = t.split("\n")
        at = [k for k, x in enumerate(lines) if has(x)]
        gone = set()
        for p in range(len(at)):
            for n in {size, *([1] if words and len(lines[at[p]].split()) >= words else [])}:
                if p + n <= len(at):
                    run = (n, *(lines[k] for k in at[p : p + n]))
                    if run in seen:
                        gone |= set(range(p, p + n))
                    seen.add(run)
        out = {at[p] for p in gone}
        kept[i, t] = "\n".join(x for k, x in enumerate(lines) if k not in out)
    return kept


@pytest.mark.parametrize("words", [None, 12])
def test_shared_ids_op10(spark, clash, words):
    ra, rb = shared.row_key("doc_id", "text")
    distinct = clash.where("text IS NOT NULL").select("doc_id", "text", ra.alias("x"), rb.alias("y")).distinct().orderBy(F.struct("doc_id", "x", "y")).collect()
    kept = runs_by_hand([(r[0], r[1]) for r in distinct], 2, words)
    want = sorted(((i, None if t is None else kept[i, t], 101) for i, t in SHARED), key=str)
    assert got(line_dedup.line_dedup(clash, passage_words=words), "doc_id", "text", "_gone") == want


def test_op10_intervals(spark):
    """The rounds hold the places whose lines occur elsewhere too, ranked in the order of the suffix array."""
    r = random.Random(2)
    texts = ["\n".join(r.choice("abc") for _ in range(r.randrange(1, 30))) for _ in range(12)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    name = {c: x for c, x in df.limit(1).select(*[F.struct(F.xxhash64(F.lit(1), F.lit(c)), F.xxhash64(F.lit(2), F.lit(c))).alias(c) for c in "abc"]).first().asDict().items()}
    lengths = []
    for length, places in line_dedup.rounds(df, 3):
        lengths.append(length)
        runs = {(i, p): tuple(name[x] for x in t.split("\n")[p : p + length]) for i, t in enumerate(texts) for p in range(len(t.split("\n")) - length + 1)}
        count = Counter(runs.values())
        rows_ = places.collect()
        assert {(x["k"], x["pos"]) for x in rows_} == {at for at, run in runs.items() if count[run] > 1}
        ordered = sorted((x["rank"], runs[x["k"], x["pos"]]) for x in rows_)
        assert [run for _, run in ordered] == sorted(run for _, run in ordered) and len(set(ordered)) == len({run for _, run in ordered}) == len({rank for rank, _ in ordered})
        assert all(x["later"] == ((x["k"], x["pos"]) != min(at for at, run in runs.items() if run == runs[x["k"], x["pos"]])) for x in rows_)
    assert lengths[:4] == [1, 2, 3, 4] and not rows_


# pipeline


def test_pipeline_shared_ids(spark, clash, tmp_path):
    import corpus_pipeline as p

    for name, rows_ in (("full", clash), ("none", clash.limit(0))):
        rows_.write.parquet(str(tmp_path / name / "documents.parquet"))
        spark.createDataFrame([(1, 1), (None, 0)], "doc_id long, quality int").write.parquet(str(tmp_path / name / "labels.parquet"))
        docs = spark.read.parquet(str(tmp_path / name / "documents.parquet"))
        columns = docs.columns
        for stage, f in p.STAGES:
            docs = shared.written(f(spark, docs, str(tmp_path / name)), "stage")
            assert stage == p.STAGES[-1][0] or docs.columns == columns
            if name == "full" and stage == "quality rules":
                assert Counter(r["text"] for r in docs.collect()) == Counter(t for _, t in SHARED if t and counts_by_hand(t)[0] >= 50 and 2 * counts_by_hand(t)[4] <= counts_by_hand(t)[0])
            if name == "full" and stage == "SimHash near-dedup":
                assert sorted(r["text"][:20] for r in docs.collect()) == sorted({t[:20] for t in (t for _, t in SHARED) if t and len(t.split()) >= 50 and not t.startswith(_lines[0])} - {SHARED[5][1][:20]} | {x["text"][:20] for x in docs.where(F.col("text").contains(_lines[2])).collect()})
                assert docs.where(F.col("text").contains(_lines[2])).count() <= 1 and docs.where("doc_id = 7").count() == 1
        assert (name == "full") == (not docs.isEmpty())


def test_similar_groups_in_tiles(spark, monkeypatch):
    """A large group of near copies with an original, most of them similar to it alone, compared in tiles as by brute force."""
    from lakemill.operators import similar

    monkeypatch.setattr(similar, "MANY", 4)
    monkeypatch.setattr(similar, "TILE", 8)
    monkeypatch.setattr(similar, "COLUMNS", 64)
    r = random.Random(13)
    texts = []
    for n in (150, 60, 20):
        base = ["".join(r.choice("abcdefghij") for _ in range(6)) for _ in range(n)]
        for _ in range(60):
            copy = list(base)
            for at in r.sample(range(n), r.randrange(8)):
                copy[at] = f"edit{r.random()}"
            texts.append(" ".join(copy[: r.randrange(n - 8, n + 1)]))
    r.shuffle(texts)
    sets = [frozenset(similar.shingles(t, None, 5).tolist()) for t in texts]
    least = list(range(len(texts)))
    for _ in texts:
        before = list(least)
        for i in range(len(texts)):
            for j in range(i):
                if least[i] != least[j] and 9 * len(sets[i] & sets[j]) >= 4 * (len(sets[i]) + len(sets[j])):
                    least[i] = least[j] = min(least[i], least[j])
        if before == least:
            break
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    out = simhash.similar_groups(docs).collect()
    assert sorted((x["doc_id"], x["component_id"]) for x in out) == sorted(enumerate(least))
    assert {x["doc_id"] for x in out if x["kept"]} == set(least) and 20 < len(set(least)) < 150


def test_similar_groups_in_rounds(spark, monkeypatch):
    """Prefixes and texts in passes, pairs and tiles in rounds: no table of sets holds all that are compared, and groups are those of brute force."""
    from lakemill.operators import similar

    for name, value in (("MANY", 4), ("TILE", 8), ("ROUND", 6000), ("PASSES", 2)):
        monkeypatch.setattr(similar, name, value)
    r, texts = random.Random(31), []
    for n in (70, 60, 50):
        base = ["".join(r.choice("abcdefghij") for _ in range(6)) for _ in range(n)]
        for _ in range(14):
            copy = list(base)
            for at in r.sample(range(n), r.randrange(4)):
                copy[at] = f"edit{r.random()}"
            texts.append(" ".join(copy))
    sets = [frozenset(similar.shingles(t, None, 5).tolist()) for t in texts]
    least = list(range(len(texts)))
    for _ in texts:
        for i in range(len(texts)):
            for j in range(i):
                if 9 * len(sets[i] & sets[j]) >= 4 * (len(sets[i]) + len(sets[j])):
                    least[i] = least[j] = min(least[i], least[j])
    made, real = {}, simhash.written

    def counted(df, name):
        out = real(df, name)
        made.setdefault(name, []).append(out.count())
        return out

    monkeypatch.setattr(simhash, "written", counted)
    out = simhash.similar_groups(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)).collect()
    assert sorted((x["doc_id"], x["component_id"]) for x in out) == sorted(enumerate(least))
    assert len(made["set-digests"]) == len(made["shared-postings"]) == 2 and len(made["similar-to-hubs"]) > 1
    assert max(made["sets"]) < 0.7 * len(set(sets)) <= sum(made["sets"])


def test_similar_groups_make_sets_of_candidates_alone(spark, monkeypatch):
    """Documents that share a passage with each of many others, but are similar to none, are never gathered as whole sets."""
    r = random.Random(17)
    fresh = lambda n: " ".join("".join(r.choice("abcdefghij") for _ in range(7)) for _ in range(n))
    passages = {(i, j): fresh(12) for i in range(12) for j in range(i)}
    texts = [" ".join(x for at, x in passages.items() if i in at) for i in range(12)] + [(copy := fresh(120)), copy + " tail"]
    made, real = Counter(), simhash.written

    def counted(df, name):
        out = real(df, name)
        made[name] += out.count()
        return out

    monkeypatch.setattr(simhash, "written", counted)
    out = simhash.similar_groups(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)).collect()
    assert {x["doc_id"]: x["component_id"] for x in out} == {i: min(i, 12) for i in range(14)}
    assert made["sets-that-share"] > 10 and made["sets"] == 2


def test_written_frees_shuffle_files(spark):
    import time

    disk = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()

    def files() -> int:
        found = disk.getAllFiles()
        return sum("shuffle_" in found.apply(i).getName() for i in range(found.size()))

    spark._jvm.System.gc()
    time.sleep(2)
    before = files()
    tables = [shared.written(spark.range(5000).groupBy((F.col("id") % (1000 + k)).alias("g")).count(), "freed") for k in range(3)]
    until = time.time() + 20
    while files() > before and time.time() < until:
        time.sleep(0.2)
    assert files() <= before and [x.count() for x in tables] == [1000, 1001, 1002]


def test_no_shuffle_files_after_a_table(spark):
    """Each table's own files are gone when it is there, without a later query."""
    from lakemill.operators import graph

    for make in (lambda df: shared.written(df, "freed"), graph.cut):
        before = graph.shuffles(spark)
        table = make(spark.range(5000).groupBy((F.col("id") % 1003).alias("g")).count())
        assert graph.shuffles(spark) <= before and table.count() == 1003


def test_pipeline_stages(spark, tmp_path):
    import corpus_pipeline as p

    r = random.Random(8)
    fresh = lambda n: " ".join("".join(r.choice("abcdefghij") for _ in range(r.randrange(2, 9))) for _ in range(n))
    passage, many = fresh(60), fresh(300)
    texts = [fresh(80) + "\n" + fresh(90), many, many, many.replace("a", "a", 1) + "", "too short", None, fresh(100) + " " + passage + " " + fresh(70), fresh(90) + " " + passage, "%%% " * 100]
    data = [(i, t, "en", "s", 0 if t is None else len(t)) for i, t in enumerate(texts)]
    spark.createDataFrame(data, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(0, 1)], "doc_id long, quality int").write.parquet(str(tmp_path / "labels.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    columns, tables = docs.columns, []
    for name, f in p.STAGES:
        docs = shared.written(f(spark, docs, str(tmp_path)), "stage")
        tables.append({x["doc_id"]: x for x in docs.collect()})
        assert name == p.STAGES[-1][0] or docs.columns == columns
    assert set(tables[0]) == {0, 1, 2, 3, 6, 7}
    assert set(tables[2]) == {0, 1, 6, 7}
    assert passage[5:-5] not in tables[3][6]["text"] and passage[5:-5] not in tables[3][7]["text"]
    assert tables[3][0]["text"] == texts[0] and tables[3][0]["n_chars"] == len(texts[0])
    assert set(tables[4]) == {0, 1, 6, 7}
    assert got(p.run(spark, str(tmp_path)), "doc_id", "piece", "ids_crc32") == got(docs, "doc_id", "piece", "ids_crc32")


def test_pipeline_near_copies(spark, tmp_path):
    import corpus_pipeline as p

    r = random.Random(11)
    texts = []
    for _ in range(12):
        words = ["".join(r.choice("abcdefghij") for _ in range(6)) for _ in range(150)]
        for edits in (0, 1, 2, 3, 4, 6, 9):
            copy = list(words)
            for at in r.sample(range(150), edits):
                copy[at] = f"edit{r.random()}"
            texts.append(" ".join(copy))
    texts += [None, "", "one two", "One  two", "é é"]
    sets = [{tuple(w[i : i + min(5, len(w))]) for i in range(len(w) - min(5, len(w)) + 1)} if w else set() for w in ((t or "").lower().split() for t in texts)]
    least = list(range(len(texts)))
    alike = [(i, j) for i in range(len(texts)) for j in range(i) if sets[i] == sets[j] or 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j])]
    for _ in texts:
        for i, j in alike:
            least[i] = least[j] = min(least[i], least[j])
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long").repartition(3)
    least = [x for x, t in zip(least, texts) if t]
    assert {x["doc_id"] for x in p.simhash_near_dedup(spark, docs, str(tmp_path)).collect()} == set(least)
    assert 12 < len(set(least)) < len(texts) - 20
    assert p.simhash_near_dedup(spark, docs.limit(0), str(tmp_path)).collect() == []


def test_op10_passages(spark, tmp_path):
    import corpus_pipeline as p

    r = random.Random(3)
    fresh = lambda n: " ".join("".join(r.choice("abcdefghij") for _ in range(6)) for _ in range(n))
    long, edge, short, pair = fresh(60), fresh(50), fresh(49), fresh(5) + "\n" + fresh(5)
    texts = [f"{fresh(9)}\n{x}\n{fresh(9)}" for x in (long, edge, short, pair) for _ in range(3)] + [f"{fresh(9)}\n\n{long}\n{fresh(9)}\n{long}", None, ""]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long").repartition(3)
    gone = {1: long, 2: long, 4: edge, 5: edge, 10: pair, 11: pair}
    want = {i: t if i not in gone else t.replace(gone[i] + "\n", "") for i, t in enumerate(texts)}
    want[12] = "\n".join(texts[12].split("\n")[k] for k in (0, 1, 3))
    assert {x["doc_id"]: x["text"] for x in p.line_dedup_stage(spark, docs, str(tmp_path)).collect()} == want
    assert {x["doc_id"]: x["n_runs"] for x in line_dedup.line_dedup(docs, passage_words=50).collect() if x["n_runs"]} == dict.fromkeys(gone, 1) | {12: 2}
