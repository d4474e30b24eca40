"""Queries over whole texts and all pairs, against plain Python."""

import random
import re
from hashlib import md5

import pytest

import lakemill.catalog as catalog

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"\w+")


def rows(spark, name):
    return spark.read.parquet(f"{SF}/{name}.parquet").collect()


def run(spark, name, sf_dir=SF):
    return catalog.QUERIES[name](spark, sf_dir).collect()


@pytest.fixture(scope="module")
def copies(spark, tmp_path_factory):
    """Texts with edited copies, about as many on either side of the threshold."""
    r, out = random.Random(5), []
    for _ in range(15):
        words = [f"w{r.randrange(10**6)}" for _ in range(120)]
        for edits in (0, 0, 1, 2, 3, 3, 4, 5, 8):
            copy = list(words)
            for at in r.sample(range(120), edits):
                copy[at] = f"e{r.randrange(10**9)}"
            out.append((len(out), " ".join(copy), r.choice(["en", "en", "de"])))
    path = str(tmp_path_factory.mktemp("copies"))
    spark.createDataFrame([*out, (len(out), "a b", "en"), (len(out) + 1, "a b", "en"), (len(out) + 2, None, "en")], "doc_id long, text string, lang string").write.parquet(f"{path}/documents.parquet")
    return path, out


def test_similar_components(spark, copies):
    path, texts = copies
    sets = [{tuple(w[i : i + 5]) for i in range(len(w) - 4)} for w in (t.split() for _, t, _ in texts)]
    least = list(range(len(texts)))
    alike = [(i, j) for i in range(len(texts)) for j in range(i) if texts[i][2] == texts[j][2] and 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j])]
    for _ in texts:
        for i, j in alike:
            least[i] = least[j] = min(least[i], least[j])
    want = {i: c for i, c in enumerate(least) if least.count(c) > 1}
    assert {x["doc_id"]: x["component"] for x in run(spark, "a9_a10_j15_similar_components", path)} == want
    won = {x["component"]: (x["winner"], x["removed"]) for x in run(spark, "a11_a12_similar_winners", path)}
    assert won == {c: (min((i for i in want if want[i] == c), key=lambda i: (-(i % 100), -(i * 7919 % 1009), i)), least.count(c) - 1) for c in set(want.values())}


def test_similar_winners_leave_no_texts_or_sets(spark, copies):
    """Scratch tables of texts, prefixes, postings and sets are gone when the result is there."""
    from pathlib import Path

    shared = Path(spark.conf.get("spark.checkpoint.dir").removeprefix("file:"), "lakemill")
    before = set(shared.iterdir()) if shared.exists() else set()
    run(spark, "a11_a12_similar_winners", copies[0])
    left = [spark.read.parquet(str(x)).columns for x in set(shared.iterdir()) - before]
    assert not [x for x in left if {"text", "p", "s", "h", "docs"} & set(x)]


def test_whole_code_tokens_and_skeletons(spark, tmp_path):
    base = "x = 1 \"s\" " * 300
    spark.createDataFrame([(0, base + "foo(1)"), (1, base + "foo[1]"), (2, base + "bar(2)")], "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    found = {x["doc_id"]: (x["tokens"], x["numbers"], x["strings"]) for x in run(spark, "t31_t33_code_tokens", str(tmp_path))}
    assert found == dict.fromkeys(range(3), (1204, 301, 300))
    digests = {x["doc_id"]: x["skeleton"] for x in run(spark, "t32_skeletons", str(tmp_path))}
    assert digests[0] == digests[2] == md5(" ".join(["<id> = <num> <str>"] * 300 + ["<id> ( <num> )"]).encode()).hexdigest()
    assert digests[1] != digests[0]


def test_whole_sequence_ratio(spark, tmp_path):
    from difflib import SequenceMatcher

    r = random.Random(2)
    texts = ["".join(r.choice("abcÄßé ÐЖ語") for _ in range(n)).strip() + "x" for n in (3, 40, 90, 200, 61, 62)]
    spark.createDataFrame([(c, t, ("user", "assistant")[t], texts[2 * c + t]) for c in range(3) for t in range(2)], "conv_id long, turn int, role string, text string").write.parquet(str(tmp_path / "conversations.parquet"))
    plain = [re.sub("[ \t]{2,}", " ", t).strip().casefold() for t in texts]
    want = {c: round(SequenceMatcher(a=plain[2 * c], b=plain[2 * c + 1]).ratio(), 9) for c in range(3)}
    assert {x["conv_id"]: x["ratio"] for x in run(spark, "t47_sequence_ratio", str(tmp_path))} == want


def test_whole_labels(spark):
    got = {(x["doc_id"], x["pos"]): (x["token"], x["label"]) for x in run(spark, "c14_w8_shifted_labels")}
    docs = {x["doc_id"]: WORD.findall(x["text"] or "") for x in rows(spark, "documents")}
    assert {k: sum(d == k for d, _ in got) for k in list(docs)[:20]} == {k: len(docs[k]) for k in list(docs)[:20]}
    assert len(got) == sum(map(len, docs.values()))
    for k, words in docs.items():
        assert not words or (got[k, len(words) - 1][1] is None and all(got[k, i][1] == words[i + 1] for i in range(len(words) - 1)))


def test_every_contamination(spark, tmp_path):
    r = random.Random(9)
    fresh = lambda n: " ".join(f"w{r.randrange(10**8)}" for _ in range(n))
    code = "def f(a, b):\n    total = a * 3 + b\n    for x in range(total):\n        if x > 7: return g(x, 'no')\n"
    renamed = "def solve(p, q):\n    s = p * 8 + q\n    for k in range(s):\n        if k > 1: return h(k, 'yes')\n"
    long, short = fresh(40), fresh(9)
    docs = [(0, long), (1, fresh(50) + " " + " ".join(long.split()[:22])), (2, fresh(50) + " " + " ".join(long.split()[:15])), (3, fresh(30) + "\n" + code.replace("'no'", "'other' + z")), (4, fresh(30) + "\n" + renamed), (5, fresh(20) + " " + short + " " + fresh(20)), (6, fresh(60)), (7, None), (8, fresh(20) + " " + " ".join(short.split()[:8]) + " " + fresh(20))]
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(0, long), (1, code), (2, short)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    got = {x["doc_id"]: x["reason"] for x in run(spark, "a15_j7_contamination", str(tmp_path))}
    assert got == {0: "exact", 1: "contiguous_run", 2: "ngram", 3: got[3], 4: "code_skeleton_ngram", 5: "short_ngram"}
    assert got[3] in ("ngram", "code_ngram")


def test_ranked_answers_sampled(spark):
    pairs = run(spark, "c5_ranked_answers_sampled")
    plain = {x["id"]: (x["chosen"], x["rejected"]) for x in run(spark, "c5_ranked_answers")}
    assert {x["id"]: x["chosen"] for x in pairs} == {k: v[0] for k, v in plain.items()}
    assert {(k, *v) for k, v in plain.items()} <= {(x["id"], x["chosen"], x["rejected"]) for x in pairs} and len(pairs) > len(plain)


def test_bucket_fallback():
    from lakemill.operators import mixture as M

    assert M.planned_counts([1, 1, 1], 4) == [2, 1, 1] and M.planned_counts([0.8, 0.5, 0.4, 0.3], 100) == [40, 25, 20, 15]
    assert M.filled_counts({"a": 5, "b": 2, "c": 1}, {"a": 1, "b": 9, "c": 9}, {"a": "x", "b": "x", "c": "y"}) == {"a": 1, "b": 6, "c": 1}
    assert M.filled_counts({"a": 5, "b": 2}, {"a": 1, "b": 3}, {}) == {"a": 1, "b": 2}


def test_chat_ids(spark):
    from tokenizers import Tokenizer

    from lakemill.operators import training as G
    from lakemill.plans.mixtures import _vocabulary

    turns = [[("user", " hi there "), ("assistant", "yes")], [("assistant", "x"), ("user", "y")], [("user", "only")]]
    df = spark.createDataFrame([(i, [{"role": r, "content": c} for r, c in t]) for i, t in enumerate(turns)], "conv_id long, messages array<struct<role: string, content: string>>")
    tok = Tokenizer.from_file(_vocabulary())
    ids = lambda t: tok.encode(t, add_special_tokens=False).ids
    names = {"user": "User", "assistant": "Assistant"}
    got = {r["conv_id"]: (list(r["input_ids"]), list(r["labels"])) for r in G.chat_ids(df, _vocabulary(), names, 5, 6, 100).collect()}
    u, a = ids("User: hi there\n"), ids("Assistant: yes\n")
    x, y = ids("Assistant: x\n"), ids("User: y\n")
    assert got == {0: ([5, *u, *a, 6], [-100] * (1 + len(u)) + a + [6]), 1: ([5, *x, *y, 6], [-100, *x] + [-100] * (len(y) + 1))}
    short = {r["conv_id"]: list(r["input_ids"]) for r in G.chat_ids(df, _vocabulary(), names, None, 6, 3).collect()}
    assert short[0] == [*u, *a, 6][-3:] and {r["conv_id"] for r in G.chat_ids(df, _vocabulary(), names, None, 6, 3, keep_tail=False).collect()} == set()


def test_shards_and_strata(spark):
    sizes = {}
    for x in rows(spark, "documents"):
        sizes[x["source"]] = sizes.get(x["source"], 0) + 1
    placed = run(spark, "l13_shard_places")
    assert {k: sum(p["length"] for p in placed if p["source"] == k) for k in sizes} == sizes
    cells = sorted((p["shard"], p["offset"] + i) for p in placed for i in range(p["length"]))
    assert len(cells) == len(set(cells)) == sum(sizes.values())
    filled = run(spark, "l18_balanced_fill")
    total = sum(x["n_chars"] for x in rows(spark, "documents"))
    assert total // 2 <= sum(x["n"] for x in filled) and filled[0]["lang"] == "en"


def test_sentence_spans(spark):
    from pyspark.sql import functions as F

    from lakemill.functions import text as T

    texts = ["One. Two!?  Three\nFour", "a.b c", "", "..!? x", "  lead\n\n tail.  ", "no end", "x.\n\ny.\tz"]

    def by_hand(text):
        out, start = [], 0
        for m in [*re.finditer(r"[.!?]+(?=\s|$)|\n", text), None]:
            end = len(text) if m is None else m.end()
            piece = text[start:end]
            if piece.strip():
                out.append((start + len(piece) - len(piece.lstrip()), start + len(piece.rstrip())))
            start = end
        return out

    df = spark.createDataFrame(list(enumerate(texts)), "id long, text string").orderBy("id")
    got = df.select(T.sentence_spans(F.col("text")), T.sentences(F.col("text"))).collect()
    assert [[tuple(s) for s in r[0]] for r in got] == [by_hand(t) for t in texts]
    assert [[" ".join(t[a:b].split()) for a, b in by_hand(t)] for t in texts] == [r[1] for r in got]


def test_dense_ids(spark):
    import unicodedata

    seen = {}
    for x in sorted(rows(spark, "documents"), key=lambda x: x["doc_id"]):
        plain = unicodedata.normalize("NFD", unicodedata.normalize("NFKC", x["text"] or ""))
        for w in WORD.findall(" ".join("".join(c for c in plain if unicodedata.category(c) != "Mn").lower().split())):
            seen.setdefault(w, len(seen))
    assert {x["token"]: x["id"] for x in run(spark, "t50_dense_ids")} == seen
