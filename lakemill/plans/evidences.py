"""Evidence, chunks, code units and tokens."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import dedup as D
from ..operators import evidence as E
from .registry import query, table


_LINES = f"list_filter(string_split(regexp_replace(text, '{T.EDGES}', chr(10), 'g'), chr(10)), lambda x: x <> '')"


@query()
def t22_equations(spark, sf_dir):
    """Signs of mathematics, and whether its marks are balanced; the patterns look around, which SQL's engine cannot, so they are tested against Python.

    Every fifth document gets a formula, every seventh half of one.
    """
    d = F.col("doc_id")
    t = F.concat(F.col("text"), F.when(d % 5 == 0, " $a = b$ for $5.00").when(d % 7 == 0, r" \begin{x} \[ y").otherwise(""))
    latex, plain = E.math_signals(t)
    return table(spark, sf_dir, "documents").select("doc_id", E.equation_integrity(t).alias("sound"), latex.alias("latex"), plain.alias("plain"))


_FENCE = "starts_with(x, '```') OR starts_with(x, '~~~')"


@query(rf"""WITH t AS (SELECT doc_id, CASE WHEN doc_id % 4 = 0 THEN text || chr(10) || '```' || chr(10) || 'x' || chr(10) || '```' || chr(10) || 'a = 1' ELSE text END AS text FROM documents), l AS (SELECT doc_id, {_LINES} AS l FROM t), e AS (SELECT doc_id, unnest(l) AS x, generate_subscripts(l, 1) AS i FROM l),
f AS (SELECT doc_id, x, {_FENCE} AS fence, coalesce(sum(CASE WHEN {_FENCE} THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) % 2 = 1 AS inside FROM e),
k AS (SELECT doc_id, fence OR inside OR regexp_matches(x, '{E.CODE_LINE}') AS code, regexp_matches(x, '{E.PROSE_LINE}') AS prose FROM f), n AS (SELECT doc_id, count(*) FILTER (code) AS c, count(*) FILTER (NOT code AND prose) AS p FROM k GROUP BY doc_id)
SELECT documents.doc_id, round(CASE WHEN coalesce(c + p, 0) > 0 THEN least(c, p) / (c + p) ELSE 0 END, 6) AS score FROM documents LEFT JOIN n ON documents.doc_id = n.doc_id""")
def t23_interleave(spark, sf_dir):
    """Every fourth document gets a fence and a line of code."""
    t = F.when(F.col("doc_id") % 4 == 0, F.concat(F.col("text"), F.lit("\n```\nx\n```\na = 1"))).otherwise(F.col("text"))
    return table(spark, sf_dir, "documents").select("doc_id", E.interleave_score(t).alias("score"))


_MARKED = " OR ".join(f"contains(head, '{m}')" for m in E.GENERATED_MARKS)


@query(rf"""WITH t AS (SELECT doc_id, CASE WHEN doc_id % 7 = 0 THEN text || chr(10) || repeat('x', 12000) WHEN doc_id % 7 = 1 THEN repeat('y', 600) WHEN doc_id % 7 = 2 THEN repeat('z', 3500) || repeat(chr(10) || 'a', 8) ELSE text END AS text FROM documents), h AS (SELECT doc_id, lower(CASE WHEN doc_id % 11 = 0 THEN 'a.min.js' ELSE 'a.py' END || chr(10) || left(text, 8192)) AS head, list_transform(regexp_split_to_array(text, '\r\n|[{T.LINE_ENDS}]'), lambda x: length(x)) AS n FROM t)
SELECT doc_id, CAST(CASE WHEN {_MARKED} THEN 1.0 WHEN list_max(n) >= 10000 OR len(list_filter(n, lambda x: x > 500)) / len(n) >= 0.5 THEN 0.90 WHEN list_max(n) >= 3000 AND len(list_filter(n, lambda x: x > 500)) / len(n) >= 0.10 THEN 0.50 ELSE 0.05 END AS DOUBLE) AS p FROM h""")
def t24_generated_probability(spark, sf_dir):
    """With very long lines in some documents, and a generated file's path for others."""
    d, t = F.col("doc_id"), F.col("text")
    shaped = F.when(d % 7 == 0, F.concat(t, F.lit("\n" + "x" * 12_000))).when(d % 7 == 1, "y" * 600).when(d % 7 == 2, "z" * 3_500 + "\na" * 8).otherwise(t)
    path = F.when(d % 11 == 0, "a.min.js").otherwise("a.py")
    return table(spark, sf_dir, "documents").select("doc_id", E.generated_probability(shaped, path).alias("p"))


@query()
def t25_pdf_evidence(spark, sf_dir):
    """Documents as pages of 1,500 characters, those of even ids with their offsets, every ninth with unsound ones; a fold and medians, tested against Python."""
    n, d = F.length("text"), F.col("doc_id")
    ends = F.when((d % 2 == 0) & (n > 0), F.concat(F.filter(F.sequence(F.lit(1500), F.greatest(n, F.lit(1500)), F.lit(1500)), lambda x: x < n), F.array(n)))
    ends = F.when(d % 9 == 0, F.array(n + 1)).otherwise(ends)
    return table(spark, sf_dir, "documents").select("doc_id", E.pdf_evidence(F.col("text"), ends).alias("e")).select("doc_id", "e.*")


@query(rf"""WITH t AS (SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN text || chr(10) || chr(10) || '## References' || chr(10) || '[1] A et al. (2020)' WHEN 1 THEN 'Bibliography' || chr(10) || text WHEN 2 THEN text || chr(10) || 'See doi: 10.1' ELSE text END AS text FROM documents),
l AS (SELECT doc_id, text, string_split(text, chr(10)) AS l, {_LINES} AS own FROM t), e AS (SELECT doc_id, unnest(l) AS x, generate_subscripts(l, 1) AS i FROM l), p AS (SELECT doc_id, x, i, coalesce(sum(length(x) + 1) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS at, coalesce(max(CASE WHEN regexp_matches(x, '\S') THEN i END) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS last FROM e),
h AS (SELECT doc_id, max(i) AS i FROM p WHERE regexp_matches(x, '{E.REFERENCES}') GROUP BY doc_id), s AS (SELECT h.doc_id, b.at FROM h JOIN p a ON a.doc_id = h.doc_id AND a.i = h.i JOIN p b ON b.doc_id = h.doc_id AND b.i = a.last + 1)
SELECT l.doc_id, round(CASE WHEN s.at >= 0.35 * length(text) THEN (length(text) - s.at) / greatest(length(text), 1) ELSE least(0.34, len(list_filter(own, lambda x: regexp_matches(x, '{E.CITING}'))) / greatest(len(own), 1)) END, 6) AS bibliography FROM l LEFT JOIN s ON l.doc_id = s.doc_id""")
def t26_bibliography(spark, sf_dir):
    """A heading of references at the end of some documents, at the start of others, and citing lines in a third kind."""
    m, t = F.col("doc_id") % 4, F.col("text")
    shaped = F.when(m == 0, F.concat(t, F.lit("\n\n## References\n[1] A et al. (2020)"))).when(m == 1, F.concat(F.lit("Bibliography\n"), t)).when(m == 2, F.concat(t, F.lit("\nSee doi: 10.1"))).otherwise(t)
    return table(spark, sf_dir, "documents").select("doc_id", E.bibliography_ratio(shaped).alias("bibliography"))


_BOOK = "CASE doc_id % 8 WHEN 0 THEN 'Question: what is it?' || chr(10) || text || chr(10) || 'Answer: it' WHEN 1 THEN '# A title' || chr(10) || text || chr(10) || 'Chapter 2' || chr(10) || 'x' WHEN 2 THEN 'Chapter One' || chr(10) || repeat(text || chr(10), 9) || 'Part IV' WHEN 3 THEN repeat(text || ' ', 30) || '.' WHEN 4 THEN 'This invention, see fig. 3: ' || repeat(text, 4) WHEN 5 THEN 'Abstract' || chr(10) || text ELSE text END"
_STRIP = f"'^[{T.BLANKS}{T.LINE_ENDS}]+|[{T.BLANKS}{T.LINE_ENDS}]+$', '', 'g'"
_ENDS = ", ".join("'{}'".format(x.replace("'", "''")) for x in E.FINISHED)


@query(rf"""WITH t AS (SELECT doc_id, {_BOOK} AS text FROM documents), s AS (SELECT *, regexp_replace(text, {_STRIP}) AS whole, list_filter(string_split(text, chr(10))[1:8], lambda x: regexp_matches(x, '\S'))[1] AS head FROM t),
h AS (SELECT *, length(regexp_replace(head, {_STRIP})) AS head_n FROM s)
SELECT doc_id, regexp_matches(left(text, 20000), '(?im){E.ABSTRACT}') OR regexp_matches(left(text, 5000), '(?m){E.TITLE}') OR coalesce(head_n BETWEEN 10 AND 300 AND length(text) > 2 * head_n, false) AS titled,
(regexp_matches(left(text, 4000), '{E.QUESTION[0]}') OR regexp_matches(left(text, 4000), '(?im){E.QUESTION[1]}') OR regexp_matches(left(text, 4000), '(?i){E.QUESTION[2]}')) AND (regexp_matches(text, '(?im){E.ANSWER}') OR (position('?' IN text) > 0 AND length(text) - position('?' IN text) + 1 >= 400)) AS qa,
length(text) >= 800 AND doc_id % 3 <> 0 AND len(regexp_extract_all(text, '(?im){E.LESSON_HEADING}')) >= 2 AS lesson, length(text) >= 50000 AND len(regexp_extract_all(text, '(?im){E.LESSON_HEADING}')) >= 4 AS book,
length(text) >= 10000 AND (len(regexp_extract_all(text, '(?im){E.CHAPTER}')) >= 2 OR (length(text) >= 20000 AND list_contains([{_ENDS}], right(whole, 1)))) AS chapters,
length(text) >= 1200 AND {" + ".join(f"CAST(regexp_matches(text, '(?i){p}') AS INTEGER)" for p in E.PATENT)} >= 2 AS engineering FROM h""")
def t27_structure_detectors(spark, sf_dir):
    """Titles, questions and answers, lessons and books, chapters, and engineering reports, in documents with such parts added."""
    d, x = F.col("doc_id"), F.col("text")
    parts = [F.concat(F.lit("Question: what is it?\n"), x, F.lit("\nAnswer: it")), F.concat(F.lit("# A title\n"), x, F.lit("\nChapter 2\nx")), F.concat(F.lit("Chapter One\n"), F.repeat(F.concat(x, F.lit("\n")), F.lit(9)), F.lit("Part IV")), F.concat(F.repeat(F.concat(x, F.lit(" ")), F.lit(30)), F.lit(".")), F.concat(F.lit("This invention, see fig. 3: "), F.repeat(x, F.lit(4))), F.concat(F.lit("Abstract\n"), x)]
    t = F.coalesce(*[F.when(d % 8 == i, p) for i, p in enumerate(parts)], x)
    title, no, yes = F.when(d % 3 != 0, "T"), F.lit(False), F.lit(True)
    rows = table(spark, sf_dir, "documents").select("doc_id", t.alias("text"))
    t = F.col("text")
    return rows.select("doc_id", E.has_title_or_abstract(t).alias("titled"), E.has_question_and_answer(t).alias("qa"), E.textbook_structure(t, title, no).alias("lesson"), E.textbook_structure(t, title, yes).alias("book"), E.chapter_integrity(t).alias("chapters"), E.engineering_structure(t).alias("engineering"))


_SAID = "(SELECT doc_id, CASE doc_id % 6 WHEN 0 THEN 'CC BY 4.0' WHEN 1 THEN 'CC-BY-NC 4.0' WHEN 2 THEN 'CC0' WHEN 3 THEN 'https://creativecommons.org/licenses/by-sa/4.0/' WHEN 4 THEN 'Apache License, Version 2.0' ELSE 'All rights reserved, public domain' END AS l FROM documents)"


def _said():
    said = ["CC BY 4.0", "CC-BY-NC 4.0", "CC0", "https://creativecommons.org/licenses/by-sa/4.0/", "Apache License, Version 2.0"]
    return F.coalesce(*[F.when(F.col("doc_id") % 6 == i, F.lit(x)) for i, x in enumerate(said)], F.lit("All rights reserved, public domain"))


@query(rf"""SELECT doc_id, regexp_matches(l, '(?i){E.OPEN_LICENSE}') AND NOT regexp_matches(l, '(?i){E.CLOSED_LICENSE}') AS open FROM {_SAID}""")
def t28_open_access(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", E.open_access(_said()).alias("open"))


@query(rf"""SELECT doc_id, CASE WHEN NOT regexp_matches(l, '(?i){E.CLOSED_LICENSE}') THEN CASE {" ".join(f"WHEN regexp_matches(l, '(?i){p}') THEN '{name}'" for name, p in E.PAGE_LICENSES)} END END AS rule FROM {_SAID}""")
def t30_page_license(spark, sf_dir):
    """The rule by which a page's licence evidence is open: denials first, then three rules in order."""
    return table(spark, sf_dir, "documents").select("doc_id", E.page_license(_said()).alias("rule"))


@query()
def t19_chunks(spark, sf_dir):
    return E.chunked(table(spark, sf_dir, "documents"))


_CODE = E.CODE_TOKEN.replace("'", "''")


@query(rf"""WITH k AS (SELECT doc_id, text, regexp_extract_all(text, '{_CODE}') AS t FROM documents)
SELECT doc_id, CAST(len(t) AS BIGINT) AS tokens, CAST(len(list_filter(t, lambda x: regexp_matches(x, '^[0-9]'))) AS BIGINT) AS numbers, CAST(len(list_filter(t, lambda x: regexp_matches(x, '^["''`]'))) AS BIGINT) AS strings, regexp_matches(text, '(?m){E.CODE_MARK}') OR len(regexp_extract_all(text, '[{{}}();=]')) >= 4 AS code FROM k""")
def t31_t33_code_tokens(spark, sf_dir):
    """Tokens of code in whole texts, and whether the text looks like code."""
    rows = table(spark, sf_dir, "documents").select("doc_id", "text", T.found(F.col("text"), E.CODE_TOKEN).alias("t"))
    n = lambda p: F.size(F.filter("t", p)).cast("bigint")
    return rows.select("doc_id", F.size("t").cast("bigint").alias("tokens"), n(lambda x: x.rlike("^[0-9]")).alias("numbers"), n(lambda x: x.rlike("^[\"'`]")).alias("strings"), E.looks_like_code(F.col("text")).alias("code"))


_WORDS = ", ".join(f"'{w}'" for w in E.KEYWORDS)


@query(rf"""WITH k AS (SELECT doc_id, regexp_extract_all(text, '{_CODE}') AS t FROM documents) SELECT doc_id, md5(array_to_string(list_transform(t, lambda x: CASE WHEN list_contains([{_WORDS}], lower(x)) THEN lower(x) WHEN regexp_matches(x, '^[A-Za-z_$]') THEN '<id>' WHEN regexp_matches(x, '^[0-9]') THEN '<num>' WHEN regexp_matches(x, '^["''`]') THEN '<str>' ELSE x END), ' ')) AS skeleton FROM k""")
def t32_skeletons(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(F.array_join(E.skeleton(F.col("text")), " ").cast("binary")).alias("skeleton"))


def sources(spark, sf_dir):
    """Documents as files of code: a Python function, a text with a function in braces, or the text alone."""
    d, t = F.col("doc_id"), F.col("text")
    body = "".join(f"    x{i} = g(x, {i})\n" for i in range(12))
    python, braces = f"def f(x):\n{body}    return x\n", "\nint f(int x) {\n" + body.replace("\n", ";\n") + "}\n"
    text = F.when(d % 3 == 0, F.concat(F.lit(python), F.lit("# "), F.replace(t, F.lit("\n"), F.lit(" ")))).when(d % 3 == 1, F.concat(t, F.lit(braces))).otherwise(t)
    return table(spark, sf_dir, "documents").select("doc_id", text.alias("text"), F.when(d % 3 == 0, "a.py").otherwise("a.c").alias("path"))


@query()
def t34_t35_code_units(spark, sf_dir):
    """Functions, blocks and the whole of each file: digest and weight; tested against a count by hand."""
    return E.code_units(sources(spark, sf_dir), "path")


@query()
def a7_a8_j2_code_removals(spark, sf_dir):
    """Files that are copies, or whose copied units are 0.8 of their weight; each digest stays with the file of the most priority."""
    rows = E.code_units(sources(spark, sf_dir), "path")
    return D.code_removals(rows, -(F.col("doc_id") % 100))


@query("SELECT conv_id, turn, " + " OR ".join(f"contains(text, '{n}')" for n in E.CODE_NEEDLES) + " AS code FROM conversations")
def t49_code_needles(spark, sf_dir):
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", E.holds_code(F.col("text")).alias("code"))


@query(rf"SELECT event_id, regexp_replace(regexp_replace('GET https://h/p?token=' || event_id || ' failed, key=ghp_' || repeat('a', 16) || user_id || ' sk-short', '{T.MESSAGE_URL.replace(chr(39), chr(39) * 2)}', '\1', 'g'), '{T.MESSAGE_TOKEN}', '<redacted>', 'g') AS message FROM events")
def t51_redacted(spark, sf_dir):
    raw = F.concat(F.lit("GET https://h/p?token="), F.col("event_id").cast("string"), F.lit(" failed, key=ghp_" + "a" * 16), F.col("user_id").cast("string"), F.lit(" sk-short"))
    return table(spark, sf_dir, "events").select("event_id", T.redacted(raw).alias("message"))


@query(r"WITH s AS (SELECT lang, regexp_extract_all(text, '[\p{L}\p{N}_]+') AS w, length(text) AS n FROM documents) SELECT lang, count(*) AS docs, round(sum(n) / sum(len(w)), 6) AS chars_per_token, round(avg(len(w)), 4) AS tokens_per_doc FROM s GROUP BY lang")
def a30_tokenizer_stats(spark, sf_dir):
    n = T.number_of(F.col("text"), T.WORD)
    return table(spark, sf_dir, "documents").groupBy("lang").agg(F.count("*").alias("docs"), F.round(F.sum(F.length("text")) / F.sum(n), 6).alias("chars_per_token"), F.round(F.avg(n), 4).alias("tokens_per_doc"))


@query(r"WITH d AS (SELECT DISTINCT sha256(text) AS c FROM documents WHERE doc_id % 2 = 0) SELECT sha256(text) AS content, min(doc_id) AS doc_id FROM documents WHERE sha256(text) NOT IN (SELECT c FROM d) GROUP BY 1")
def c7_missing_from_cache(spark, sf_dir):
    """What a content-addressed token cache lacks: an anti-join on digests."""
    rows = table(spark, sf_dir, "documents").select("doc_id", F.sha2(F.col("text").cast("binary"), 256).alias("content"))
    cached = rows.where("doc_id % 2 = 0").select("content").distinct()
    return rows.join(cached, "content", "left_anti").groupBy("content").agg(F.min("doc_id").alias("doc_id"))


@query(rf"""WITH d AS (SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 0.9 END AS given, {_LINES} AS lines, length(text) AS n, len(regexp_extract_all(text, '{T.QUALITY_WORD.replace("'", "''")}')) AS words, length(text) - length(regexp_replace(text, '\p{{L}}', '', 'g')) AS alpha, len(regexp_extract_all(text, '(?i)https?://\S+')) AS urls, n - length(regexp_replace(text, '[\x{{FFFD}}\x00-\x08\x0b\x0c\x0e-\x1f\x7f-\x{{9f}}]', '', 'g')) AS broken FROM documents)
SELECT doc_id, CASE WHEN given IS NULL THEN 'computed_quality' ELSE 'upstream_field' END AS method, round(coalesce(given, round(greatest(0.0, least(1.0, 0.20 * least(1.0, sqrt(n / 2000.0)) + 0.25 * greatest(0.0, least(1.0, (alpha / greatest(n, 1) - CAST(0.30 AS DOUBLE)) / 0.35)) + 0.20 * greatest(0.0, 1 - CASE WHEN len(lines) > 0 THEN 1 - len(list_distinct(lines)) / len(lines) ELSE 0 END) + 0.15 * greatest(0.0, 1 - (100.0 * urls / greatest(words, 1)) / 4.0) + 0.20 * greatest(0.0, 1 - broken / greatest(n, 1) * 250.0))), 6)), 6) AS quality_score FROM d""")
def f1_evidence_precedence(spark, sf_dir):
    """A quality score that came with a row, else one from its text, and by which way it came."""
    from ..operators import normalization as N

    given = F.when(F.col("doc_id") % 3 == 0, 0.9)
    value, method = N.derive(F.col("text"), ["quality_score"], {"quality_score": given})["quality_score"]
    return table(spark, sf_dir, "documents").select("doc_id", method.alias("method"), F.round(value, 6).alias("quality_score"))


@query()
def f1_derived_gates(spark, sf_dir):
    """Each document through the gate of one of eight profiles, with evidence derived from its text; tested against the rules one by one."""
    from ..operators import normalization as N

    names = ["web_general_v1", "code_interleaved_v1", "math_score3_v1", "pdf_technical_v1", "scientific_paper_v1", "textbook_v1", "explanatory_qa_v1", "repository_code_v1"]
    docs, out = table(spark, sf_dir, "documents"), None
    for i, name in enumerate(names):
        part = N.gate(docs.where(F.col("doc_id") % len(names) == i), name, {"license": F.lit("CC BY 4.0")}, {"title": F.lit("T"), "path": F.lit("a.py")}).select("doc_id", F.lit(name).alias("profile"), "reason", "decision")
        out = part if out is None else out.unionByName(part)
    return out
