"""Evidence and sequential helpers against plain expectations."""

import re
import unicodedata
from collections import Counter
from statistics import median

import pandas as pd
import pytest
from pyspark.sql import functions as F

from lakemill.operators import evidence as E


def values(spark, rows, c):
    df = spark.createDataFrame(list(enumerate(rows)), "id long, text string")
    return [r[0] for r in df.orderBy("id").select(c).collect()]


TEXTS = ["$x$ costs $5 a", "$x", r"\[ a \] \( b", r"\begin{a}\end{a} = b", r"\begin{a}\end{b}", "", r"\$ alone", "sold for $153. It", r"in $20 \times 365 = 7300$", "x = 1, y = 2, 3+4 and a * b", "a <= b >= c", "∑ x ± 3", "http://a=b.c ok", "price $1,000.50 and $2"]


def equations_by_hand(text):
    money = re.sub(E.MONEY, " ", text)
    dollars = len(re.findall(E.DOLLAR, money))
    begins, ends = re.findall(E.BEGIN, text), re.findall(E.END, text)
    latex = dollars // 2 + text.count(r"\(") + text.count(r"\[") + len(begins) + len(re.findall(E.COMMAND, text))
    related = len(re.findall(E.RELATION, re.sub(r"https?://\S+", " ", text)))
    plain = len(re.findall(E.OPERATOR, text)) + (len(re.findall(E.EXPRESSION, text)) if related >= 2 else 0)
    sound = latex + plain > 0 and dollars % 2 == 0 and text.count(r"\(") == text.count(r"\)") and text.count(r"\[") == text.count(r"\]") and Counter(begins) == Counter(ends)
    return sound, latex, plain


def test_equations(spark):
    t = F.col("text")
    got = list(zip(values(spark, TEXTS, E.equation_integrity(t)), values(spark, TEXTS, E.math_signals(t)[0]), values(spark, TEXTS, E.math_signals(t)[1])))
    assert got == [equations_by_hand(x) for x in TEXTS]
    assert [x[0] for x in got[:6]] == [True, False, False, True, False, False] and got[7][0] is False and got[8][0]


def test_interleave(spark):
    rows = ["prose words that are long enough here\n```\nx\n```\nmore prose words that are long", "", "plain", "x = 1\nThese lines hold many plain words", "~~~\nThese lines hold many plain words\n~~~"]
    assert values(spark, rows, E.interleave_score(F.col("text"))) == [0.4, 0.0, 0.0, 0.5, 0.0]


def test_generated(spark):
    rows = ["x", "# DO NOT EDIT", "y" * 10_000, "a\n" * 3 + "z" * 501, "z" * 3000 + "\na" * 5, "z" * 3000 + "\na" * 20, ""]
    assert values(spark, rows, E.generated_probability(F.col("text"))) == [0.05, 1.0, 0.9, 0.05, 0.5, 0.05, 0.05]
    assert values(spark, ["x"], E.generated_probability(F.col("text"), F.lit("lib/a.MIN.js"))) == [1.0]


def pdf_by_hand(text, ends):
    lines = [x.strip() for x in text.replace("\r\n", "\n").splitlines() if x.strip()]
    broken = text.count("\ufffd") + sum(unicodedata.category(c) == "Cc" and c not in "\n\r\t" for c in text)
    confidence = max(0.0, 1 - 200 * broken / max(1, len(text)) - 2 * len(re.findall(E.SUSPICIOUS, text)) / max(1, len(lines)))
    sound = bool(ends) and all(0 < a <= len(text) for a in ends) and all(a < b for a, b in zip(ends, ends[1:]))
    cuts = [0, *(ends if sound else []), len(text)]
    edges = []
    for a, b in zip(cuts, cuts[1:]):
        own = [x.strip() for x in text[a:b].splitlines() if x.strip()]
        edges += [re.sub(r"\d+", "#", x.lower())[:160] for x in (own[:1] + own[-1:]) if len(x) <= 160]
    repeated = (len(edges) - len(set(edges))) / max(1, len(edges))
    order = confidence >= 0.9 and sum(len(x.split()) <= 1 for x in lines) / max(1, len(lines)) <= 0.35 and (not lines or median(map(len, lines)) >= 20) and (not ends or sound)
    return round(confidence, 6), round(repeated, 6), order


def test_pdf_evidence(spark):
    line = "A line of text that is long enough 1"
    text = "\n".join([line, "body of the first page, long enough", "page 1", line.replace("1", "2"), "another body that is long enough too", "page 2"])
    cut = text.index("page 1") + 7
    rows = [(0, text, [cut, len(text)]), (1, text, None), (2, text, [cut, cut]), (3, "x\ufffd\x01", []), (4, "", None), (5, "one\ntwo\nthree", [3]), (6, "|||| " + "_" * 12 + " " + "w" * 30, None)]
    df = spark.createDataFrame(rows, "id long, text string, ends array<int>")
    got = [tuple(r["e"]) for r in df.orderBy("id").select(E.pdf_evidence(F.col("text"), F.col("ends")).alias("e")).collect()]
    assert got == [pdf_by_hand(t, e) for _, t, e in rows] and got[0][1] == 0.5


def test_bibliography(spark):
    body = "word " * 40
    rows = [body + "\n\n## References\n[1] x", "References\n" + body, body + "\nsee doi: 1", body + "\nBibliography\n" + body + "\n\nReferences  \nz", ""]
    n = [len(x) for x in rows]
    at = [rows[0].index("\n\n##") + 1, None, None, rows[3].index("\n\nReferences") + 1, None]
    assert values(spark, rows, E.bibliography_ratio(F.col("text"))) == [round((n[0] - at[0]) / n[0], 6), 0.0, 0.34, round((n[3] - at[3]) / n[3], 6), 0.0]


def test_skeleton(spark):
    assert values(spark, ["return foo + 'a' * 12"], E.skeleton(F.col("text"))) == [["return", "<id>", "+", "<str>", "*", "<num>"]]


def test_chunks():
    assert [len(c) for c in E.chunks("\n\n".join(["a" * 30, "b" * 500, "c" * 10, "d" * 10]), 20, 100, 200)] == [30, 200, 200, 100, 22]
    words = "\n\n".join(["a" * 150, "one two " * 40, "tail"])
    out = E.chunks(words, 20, 100, 200)
    assert all(len(c) <= 200 for c in out) and not any(c.startswith(" ") or c.endswith(" ") for c in out) and all(w in ("one", "two", "tail", "a" * 150) for c in out for w in c.split())
    assert E.chunks("x" * 30, 40, 50, 60) == [] and E.chunks("", 1, 2, 3) == [] and E.chunks("ab\r\n\r\ncd", 1, 3, 9) == ["ab\n\ncd"]


def test_units():
    assert E.functions_of("def f():\n  pass\nclass A:\n  def g(self): pass") == [("f", 1, 2), ("A", 3, 4), ("g", 4, 4)]
    assert E.functions_of("def (") == []
    assert E.braced('f() { a("}"); { } } g() {}') == [(4, 19), (24, 26)]
    assert E.braced("f() { open") == []
    body = "".join(f"  x{i} = g(x, {i});\n" for i in range(8))
    text = f"int f(int x) {{\n{body}}}\nsmall() {{ }}\n"
    units = E.units_of(text, "a.c")
    tokens = len(re.findall(E.CODE_TOKEN, text))
    assert sorted(k for k, _ in units.values()) == ["function"] and 70 < max(w for _, w in units.values()) < tokens < 96
    assert {k for k, _ in E.units_of(text * 2, "a.c").values()} == {"function", "block"}
    renamed = E.units_of(f"def f(x):\n{body.replace(';', '')}", "a.PY")
    assert [k for k, _ in renamed.values()] == ["function"]


def test_code_units_and_removals(spark):
    from lakemill.operators import dedup as D

    body = "".join(f"  x{i} = g(x, {i});\n" for i in range(30))
    shared = f"int f(int x) {{\n{body}}}\n"
    rows = [(0, shared, "a.c"), (1, shared, "b.c"), (2, shared + "int h = 1;", "c.c"), (3, "int z(int q) {\n" + "".join(f"  y{i} = q;\n" for i in range(20)) + "}", "d.c"), (4, None, "e.c")]
    units = E.code_units(spark.createDataFrame(rows, "doc_id long, text string, path string"), "path")
    by_doc = {}
    for r in units.collect():
        by_doc.setdefault(r["doc_id"], set()).add((r["kind"], r["digest"], r["weight"]))
    assert by_doc[0] == by_doc[1] and all({(k, d, w) for d, (k, w) in E.units_of(t or "", p).items()} == {x for x in by_doc[i] if x[0] != "file"} for i, t, p in rows)
    gone = {r["doc_id"]: r["reason"] for r in D.code_removals(units, F.col("doc_id")).collect()}
    assert gone == {1: "file_duplicate", 2: "unit_duplicates"}


def test_holdout_fragments():
    row = {"id": 7, "question": " What? ", "prompt": "what?", "options": {"a": "x", "b": ["y", 3]}, "answer": True, "note": "a remark that is long enough, surely", "tag": "short", "code": "z" * 40_000}
    assert E.fragments_of(row, frozenset({"id"})) == [("query", "What?"), ("choices", "a: x"), ("choices", "y"), ("choices", "3"), ("answer", "True"), ("other", "a remark that is long enough, surely")]
    many = {"choices": [f"c{i}" for i in range(400)]}
    assert len(E.fragments_of(many, frozenset())) == 256


def test_balanced_fill():
    rows = pd.DataFrame({"c": list("aabbb"), "n": [5, 5, 4, 4, 4]})
    out = E.balanced_fill(rows, {"a": 5}, 17, "c", "n")
    assert list(out["c"]) == ["a", "b", "b", "a"]


def test_shard_places():
    assert E.shard_places([4, 5], 6, 2, [0, 0]) == [[(0, 0, 4)], [(0, 4, 2), (1, 0, 3)]]
    with pytest.raises(ValueError):
        E.shard_places([20], 6, 2, [0])


def test_derived_gates(spark):
    from lakemill.operators import normalization as N
    from lakemill.operators import reasons as R

    assert N.needed(R.profile("pdf_technical_v1")) == ["ocr_confidence", "language_probability", "repeated_header_footer_fraction", "reading_order_passed"]
    assert {f for p in R.PROFILES for f in N.needed(R.profile(p))} >= set(N.COMPUTED)
    words = "the cat and the dog are in a house with all of their friends because they should be there for two days "
    rows = [words * 10, "What is it? " + words * 10, words * 2, "x = 1\n" * 40 + words * 10 + "\n" + (words + "\n") * 30]
    df = spark.createDataFrame(list(enumerate(rows)), "id long, text string")

    def run(name, upstream=None, **own):
        return [r["reason"] for r in N.gate(df, name, upstream, maximum_repeated_line_fraction=None, **own).orderBy("id").collect()]

    lic = {"license": F.lit("MIT")}
    assert run("explanatory_qa_v1", lic) == ["missing_question_and_answer", None, "minimum_characters", "missing_question_and_answer"]
    assert run("explanatory_qa_v1") == ["missing_license", "missing_license", "minimum_characters", "missing_license"]
    assert run("math_score3_v1", {"math_score": F.lit(5.0)}, minimum_characters=None, quality_score_minimum=None)[:2] == ["missing_equation_integrity_passed"] * 2
    assert run("web_general_v1", {"quality_score": F.lit(0.1)}) == ["quality_score_minimum", "quality_score_minimum", "minimum_characters", "quality_score_minimum"]
    assert run("web_general_v1", {"language_probability": F.lit(0.5), "quality_score": F.lit(1.0)}) == ["language_probability_minimum", "language_probability_minimum", "minimum_characters", "language_probability_minimum"]
