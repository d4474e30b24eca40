"""Evidence about a document's kind: equations, code, PDFs, bibliographies, structure; and chunking that needs a fold."""

from __future__ import annotations

import ast
import hashlib
import json
import re
from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.text import bound


# Amounts of money, and what counts as mathematics.
MONEY = r"(?<!\\)\$\d[\d,]*(?:\.\d+)?(?!\d)(?!\s*[\\^_=+*/<>{}])(?!\s*\d*\s*\$)"
DOLLAR = r"(?<!\\)\$"
COMMAND = r"\\(?:frac|sum|int|sqrt|begin)\b"
BEGIN, END = r"\\begin\{([^{}]+)\}", r"\\end\{([^{}]+)\}"
RELATION = r"(?<![=<>!])[=≠≤≥≈≡<>](?![=])"
OPERATOR = r"[∫∑∏√±×÷∞≈≤≥∈∉⊆∪∩→∂∇]"
EXPRESSION = r"(?:\d+|\b[a-zA-Z]\b)\s*[-+*/^]\s*(?:\d+|\b[a-zA-Z]\b)"


def math_signals(text: Column) -> tuple[Column, Column]:
    """(signs of LaTeX, signs of plain mathematics); expressions count only where there are two relations or more."""
    n = lambda pattern, t=text: T.number_of(t, pattern)
    dollars = n(DOLLAR, F.regexp_replace(text, MONEY, " "))
    latex = F.floor(dollars / 2) + n(r"\\\(") + n(r"\\\[") + n(r"\\begin\{[^{}]+\}") + n(COMMAND)
    related = n(RELATION, F.regexp_replace(text, r"https?://\S+", " ")) >= 2
    return latex.cast("bigint"), (n(OPERATOR) + F.when(related, n(EXPRESSION)).otherwise(0)).cast("bigint")


def equation_integrity(text: Column) -> Column:
    """True where there is mathematics and its marks are balanced: dollar signs without money, \\( \\), \\[ \\] and environments by name."""
    latex, plain = math_signals(text)
    same = lambda a, b: T.number_of(text, a) == T.number_of(text, b)
    even = T.number_of(F.regexp_replace(text, MONEY, " "), DOLLAR) % 2 == 0
    return (latex + plain > 0) & even & same(r"\\\(", r"\\\)") & same(r"\\\[", r"\\\]") & (F.array_sort(T.found(text, BEGIN, 1)) == F.array_sort(T.found(text, END, 1)))


# Lines of code, and lines of prose.
CODE_LINE = r"(?i)^\s*(?:```|~~~|#include\b|(?:async\s+)?def\b|class\b|function\b|import\b|from\s+\S+\s+import\b|(?:const|let|var)\b|SELECT\b|(?:if|for|while)\s*\(|[\w.\[\]]+\s*=\s*\S+|[{};]\s*$)"
PROSE_LINE = r"[A-Za-z]{3,}(?:\s+[A-Za-z]{3,}){4}"


def interleave_score(text: Column) -> Column:
    """The smaller of the numbers of lines of code and of prose, as a share of both; all lines inside a fence are code."""

    def score(x: Column) -> Column:
        is_fence = lambda l: l.startswith("```") | l.startswith("~~~")
        start = F.struct(F.lit(False).alias("inside"), F.lit(0).alias("code"), F.lit(0).alias("prose"))

        def step(s: Column, l: Column) -> Column:
            code = is_fence(l) | s["inside"] | l.rlike(CODE_LINE)
            return F.struct((s["inside"] != is_fence(l)).alias("inside"), (s["code"] + code.cast("int")).alias("code"), (s["prose"] + (~code & l.rlike(PROSE_LINE)).cast("int")).alias("prose"))

        return F.aggregate(x, start, step, lambda s: F.round(F.coalesce(F.try_divide(F.least(s["code"], s["prose"]).cast("double"), s["code"] + s["prose"]), F.lit(0.0)), 6))

    return bound(T.lines(text), score)


# Marks of generated files, in the path or the head of the text, and probabilities by long lines.
GENERATED_MARKS = ["generated file", "auto-generated", "autogenerated", "do not edit", ".min.js", ".min.css", "generated by", "@generated", "this file was automatically generated", "code generated by"]
GENERATED = {"head": 8192, "long_line": 500, "certain": 1.0, "packed": 0.90, "mixed": 0.50, "written": 0.05}


def generated_probability(text: Column, path: Column | None = None) -> Column:
    """1 with a mark; else by the longest line and the share of long ones: packed output has few and very long lines."""
    k = GENERATED
    head = F.lower(F.concat_ws("\n", F.coalesce(path, F.lit("")) if path is not None else F.lit(""), F.substring(text, 1, k["head"])))
    marked = F.exists(F.array(*map(F.lit, GENERATED_MARKS)), lambda m: F.contains(head, m))

    def by_lines(n: Column) -> Column:
        longest, share = F.coalesce(F.array_max(n), F.lit(0)), F.size(F.filter(n, lambda x: x > k["long_line"])) / F.greatest(F.size(n), F.lit(1))
        return F.when((longest >= 10_000) | (share >= 0.5), k["packed"]).when((longest >= 3_000) & (share >= 0.10), k["mixed"]).otherwise(k["written"])

    sizes = F.transform(F.split(text, f"\r\n|[{T.LINE_ENDS}]"), F.length)
    return F.when(marked, k["certain"]).otherwise(bound(sizes, by_lines))


# What is suspicious in extracted text, and bounds of a sound reading order.
SUSPICIOUS = r"(?:[|]{3,}|[_]{12,}|\b\w{30,}\b)"
BROKEN = "[\ufffd\x00-\x08\x0b\x0c\x0e-\x1f\x7f-\x9f]"
READING = {"confidence": 0.90, "single_words": 0.35, "median_line": 20, "edge": 160}


def pdf_evidence(text: Column, page_ends: Column) -> Column:
    """struct(ocr_confidence, repeated_header_footer, reading_order): from broken characters and suspicious runs, from first and last lines of pages that
    repeat (digits are alike), and from line lengths. page_ends: rising offsets within the text; null for one page, others are not sound."""
    k, n = READING, F.greatest(F.length(text), F.lit(1))

    def of(x: Column) -> Column:
        broken = F.length(text) - T.without(text, BROKEN)
        suspicious = T.number_of(text, SUSPICIOUS)
        confidence = F.greatest(F.lit(0.0), 1 - broken * 200.0 / n - suspicious * 2.0 / F.greatest(F.size(x["lines"]), F.lit(1)))
        sizes = F.transform(F.array_sort(F.transform(x["lines"], F.length)), lambda v: v.cast("double"))
        half = F.floor(F.size(sizes) / 2).cast("int")
        median = F.when(F.size(sizes) % 2 == 1, F.get(sizes, half)).otherwise((F.get(sizes, half - 1) + F.get(sizes, half)) / 2)
        single = F.size(F.filter(x["lines"], lambda v: ~v.rlike(r"\S\s+\S"))) / F.greatest(F.size(x["lines"]), F.lit(1))
        sound = page_ends.isNull() | (F.size(page_ends) == 0) | x["given"]
        order = (confidence >= k["confidence"]) & (single <= k["single_words"]) & ((F.size(sizes) == 0) | (median >= k["median_line"])) & sound
        repeated = F.size(x["edges"]) - F.size(F.array_distinct(x["edges"]))
        return F.struct(F.round(confidence, 6).alias("ocr_confidence"), F.round(repeated / F.greatest(F.size(x["edges"]), F.lit(1)), 6).alias("repeated_header_footer"), order.alias("reading_order"))

    rising = F.aggregate(page_ends, F.lit(0), lambda last, e: F.when((last >= 0) & (e > last) & (e <= F.length(text)), e).otherwise(-1)) > 0
    given = F.coalesce(rising, F.lit(False))
    starts = F.when(given, F.concat(F.array(F.lit(0)), page_ends)).otherwise(F.array(F.lit(0)))
    pages = F.transform(starts, lambda a, i: F.substr(text, a + 1, F.coalesce(F.get(starts, i + 1), F.length(text)) - a))
    edge = lambda l: F.when(F.length(l) <= k["edge"], F.substring(F.regexp_replace(F.lower(l), r"\d+", "#"), 1, k["edge"]))
    edges = F.array_compact(F.flatten(F.transform(F.filter(F.transform(pages, T.lines), lambda l: F.size(l) > 0), lambda l: F.array(edge(F.get(l, F.lit(0))), edge(F.get(l, F.size(l) - 1))))))
    return bound(F.struct(T.lines(text).alias("lines"), edges.alias("edges"), given.alias("given")), of)


# A heading of references, and lines that cite.
REFERENCES = r"(?i)^\s*(?:#{1,6}\s*)?(?:references|bibliography)\s*$"
CITING = r"(?i)(?:\bdoi:|\bet al\.|\(\d{4}\)|\[\d+\])"
BIBLIOGRAPHY = {"from": 0.35, "most_citing": 0.34}


def bibliography_ratio(text: Column) -> Column:
    """What follows the last heading of references that lies in the later part of the text, as a share of it; without one the share of citing
    lines, bounded. Blank lines before the heading belong to it."""
    k = BIBLIOGRAPHY
    start = F.struct(F.lit(0).alias("at"), F.lit(0).alias("run"), F.lit(-1).alias("found"))

    def step(s: Column, l: Column) -> Column:
        after = s["at"] + F.length(l) + 1
        blank = ~l.rlike(r"\S")
        return F.struct(after.alias("at"), F.when(blank, s["run"]).otherwise(after).alias("run"), F.when(l.rlike(REFERENCES), s["run"]).otherwise(s["found"]).alias("found"))

    def ratio(at: Column) -> Column:
        n = F.greatest(F.length(text), F.lit(1))
        citing = bound(T.lines(text), lambda x: F.size(F.filter(x, lambda l: l.rlike(CITING))) / F.greatest(F.size(x), F.lit(1)))
        return F.round(F.when((at >= 0) & (at >= F.length(text) * k["from"]), (F.length(text) - at) / n).otherwise(F.least(F.lit(k["most_citing"]), citing)), 6)

    return bound(F.aggregate(F.split(text, "\n"), start, step, lambda s: s["found"]), ratio)


# Signs of titles, headings, chapters, questions, answers and patents. Engines put their own flags before them.
ABSTRACT = r"^\s*(?:#{1,6}\s*)?abstract\s*$"
TITLE = r"^\s*#{1,2}\s+\S.{3,200}$"
LESSON_HEADING = r"^\s*(?:#{1,6}\s+|(?:chapter|section|lesson|unit|exercise|example|introduction|discussion|conclusion|references?)\b)"
CHAPTER = r"^\s*(?:#{1,6}\s+)?(?:chapter|book|part)\s+(?:[ivxlcdm]+|\d+|one|two|three|four|five)\b"
BOOK_START, BOOK_END = r"\*{3}\s*START OF (?:THE|THIS) PROJECT GUTENBERG", r"\*{3}\s*END OF (?:THE|THIS) PROJECT GUTENBERG"
FINISHED = [".", "!", "?", '"', "'", "\u201d", "\u2019", "*", ")"]
QUESTION = [r"\?(?:\s|$)", r"^\s*(?:#+\s*)?(?:question|q)\b\s*[:.\-]", r"\b(?:how do i|how can i|why does|what is the|is it possible)\b"]
ANSWER = r"^\s*(?:#+\s*)?(?:answer|a|accepted answer|best answer)\b\s*[:.\-]"
PATENT = [r"\b(?:united states )?patent office\b", r"\bapplication (?:filed|number|no\.)\b", r"\b(?:detailed )?description\b|\bthis invention\b", r"\b(?:what is claimed|we claim|i claim)\b", r"\bfig(?:ure|\.)\s*\d+\b"]


def has_title_or_abstract(text: Column, title: Column | None = None) -> Column:
    """A title of its own, a heading, or a first line (among the first eight) that is no longer than half of the text."""
    named = F.length(F.trim(title)) >= 3 if title is not None else F.lit(False)
    head = F.get(F.filter(F.slice(F.split(text, "\n", 9), 1, 8), lambda l: l.rlike(r"\S")), F.lit(0))
    first = bound(F.length(T.stripped(head)), lambda n: n.between(10, 300) & (F.length(text) > n * 2))
    return F.coalesce(named, F.lit(False)) | F.substring(text, 1, 20_000).rlike("(?dim)" + ABSTRACT) | F.substring(text, 1, 5_000).rlike("(?dm)" + TITLE) | F.coalesce(first, F.lit(False))


def textbook_structure(text: Column, title: Column, whole_book: Column) -> Column:
    """Whole books: 50,000 characters and four headings; single lessons: 800, a title and two."""
    headings = T.number_of(text, "(?dim)" + LESSON_HEADING)
    return F.when(whole_book, (F.length(text) >= 50_000) & (headings >= 4)).otherwise((F.length(text) >= 800) & (F.coalesce(title, F.lit("")) != "") & (headings >= 2))


def chapter_integrity(text: Column) -> Column:
    """10,000 characters, and two chapters, both marks of a public library's book, or 20,000 that end in a finished sentence."""
    last = F.right(T.stripped(text), F.lit(1))
    n, both = F.length(text), text.rlike("(?i)" + BOOK_START) & text.rlike("(?i)" + BOOK_END)
    return (n >= 10_000) & ((T.number_of(text, "(?dim)" + CHAPTER) >= 2) | both | ((n >= 20_000) & last.isin(FINISHED)))


def has_question_and_answer(text: Column) -> Column:
    """A question in the first 4,000 characters, and a marked answer or 400 characters after the first question mark."""
    head = F.substring(text, 1, 4_000)
    asked = head.rlike(QUESTION[0]) | head.rlike("(?dim)" + QUESTION[1]) | head.rlike("(?i)" + QUESTION[2])
    at = F.locate("?", text)
    return asked & (text.rlike("(?dim)" + ANSWER) | ((at > 0) & (F.length(text) - at + 1 >= 400)))


def engineering_structure(text: Column) -> Column:
    """1,200 characters and two of five signs of a patent or report."""
    return (F.length(text) >= 1_200) & (sum((text.rlike("(?i)" + p).cast("int") for p in PATENT[1:]), text.rlike("(?i)" + PATENT[0]).cast("int")) >= 2)


# What an open licence says, and what none says.
OPEN_LICENSE = r"(?:creativecommons\.org/licenses/(?:by|by-sa)/|creative commons\s*[-\x{2013}\x{2014}:]?\s*attribution(?:\s+share[- ]alike)?|\bcc\s*[- ]?by(?:\s*[- ]?sa)?\b|\bcc0\b|creativecommons\.org/publicdomain/(?:zero|mark)/|\bpublic domain\b|\bopen parliament licen[cs]e\b|\bopen government licen[cs]e\b)"
CLOSED_LICENSE = r"(?:by[-_ /]?(?:nc|nd)|non[- ]?commercial|no[- ]?derivatives?|all rights reserved)"


def open_access(license_: Column) -> Column:
    return F.coalesce(license_.rlike("(?i)" + OPEN_LICENSE) & ~license_.rlike("(?i)" + CLOSED_LICENSE), F.lit(False))


# Licences that a page may state, by kind.
PAGE_LICENSES = [
    ("cc_by_or_cc_by_sa", r"creativecommons\.org/licenses/(?:by|by-sa)/|\bcc\s*[- ]?by(?:\s*[- ]?sa)?\b|creative commons attribution(?:-sharealike)?"),
    ("cc0_or_public_domain", r"creativecommons\.org/publicdomain/(?:zero|mark)/|\bcc\s*0\b|\bpublic domain\b"),
    ("open_source_or_open_government", r"\bmit license\b|\bapache license(?:,? version)? 2(?:\.0)?\b|\bbsd (?:2|3)[- ]clause\b|\bmpl 2\.0\b|\bopen government licen[cs]e\b|\bopen data commons attribution licen[cs]e\b"),
]


def page_license(evidence: Column) -> Column:
    """The kind of open licence that one piece of page evidence states; null for none, or one that reserves rights."""
    told = F.coalesce(*[F.when(evidence.rlike("(?i)" + p), F.lit(name)) for name, p in PAGE_LICENSES])
    return F.when(~evidence.rlike("(?i)" + CLOSED_LICENSE), told)


def chunks(text: str, least: int, target: int, most: int) -> list[str]:
    """Paragraphs joined until the target is reached, never over most; a longer paragraph is cut, at the last space past `least` characters where there is
    one; chunks under `least` are dropped, but a text that gives no chunk at all is one itself if it is that long."""
    whole = text.replace("\r\n", "\n").replace("\r", "\n").strip()
    pieces: list[str] = []
    for paragraph in filter(None, (p.strip() for p in whole.split("\n\n"))):
        while len(paragraph) > most:
            at = paragraph.rfind(" ", least, most)
            at = at if at >= least else most
            pieces.append(paragraph[:at].strip())
            paragraph = paragraph[at:].lstrip()
        pieces.append(paragraph)
    out: list[str] = []
    now: list[str] = []
    size = 0
    for piece in filter(None, pieces):
        if now and size + 2 + len(piece) > most:
            out.append("\n\n".join(now))
            now, size = [], 0
        size += len(piece) + 2 * bool(now)
        now.append(piece)
        if size >= target:
            out.append("\n\n".join(now))
            now, size = [], 0
    if now:
        out.append("\n\n".join(now))
    if not out and len(whole) >= least:
        return [whole]
    return [c for c in out if len(c) >= least]


def chunked(docs: DataFrame, least: int = 200, target: int = 1500, most: int = 3000, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, chunk, text): a fold over paragraphs, one document at a time."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            rows = [(k, i, c) for k, t in zip(part[key], part[text]) for i, c in enumerate(chunks(t or "", least, target, most))]
            yield pd.DataFrame(rows, columns=[key, "chunk", "text"])

    return docs.select(key, text).mapInPandas(run, f"{key} {docs.schema[key].dataType.simpleString()}, chunk int, text string")


def functions_of(source: str) -> list[tuple[str, int, int]]:
    """(name, first line, last line) of the functions and classes of a Python source; none where it does not parse."""
    try:
        tree = ast.parse(source)
    except (SyntaxError, ValueError, RecursionError):
        return []
    return [(n.name, n.lineno, n.end_lineno) for n in ast.walk(tree) if isinstance(n, (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef))]


def braced(source: str, openings: Iterable[int] | None = None, most: int = 1_000_000) -> list[tuple[int, int]]:
    """[from, to) of the blocks that open at these braces, strings skipped; of outermost blocks if none are given. A block that
    doesn't close within `most` characters is left out."""
    out, end = [], 0
    for start in openings if openings is not None else (i for i, c in enumerate(source) if c == "{"):
        if openings is None and (start < end or quoted_at(source, end, start)):
            continue
        depth, quote, i = 0, "", start
        while i < min(len(source), start + most):
            c = source[i]
            if quote:
                i += c == "\\"
                quote = "" if c == quote else quote
            elif c in "\"'`":
                quote = c
            elif c in "{}":
                depth += 1 if c == "{" else -1
                if not depth:
                    out.append((start, i + 1))
                    end = i + 1
                    break
            i += 1
    return out


def quoted_at(source: str, start: int, at: int) -> bool:
    """True if a string that begins at or after start holds this place."""
    quote, i = "", start
    while i < at:
        c = source[i]
        if quote:
            i += c == "\\"
            quote = "" if c == quote else quote
        elif c in "\"'`":
            quote = c
        i += 1
    return bool(quote)


# Strings are runs without escapes between escapes, so that the JVM's matcher doesn't recurse once a character.
# Tokens of code, words that a skeleton keeps, marks by which code is told, and heads of functions with braces.
CODE_TOKEN = r"""(?:"[^"\\]*(?:\\.[^"\\]*)*"|'[^'\\]*(?:\\.[^'\\]*)*'|`[^`\\]*(?:\\.[^`\\]*)*`|[A-Za-z_$][A-Za-z0-9_$]*|\d+(?:\.\d+)?(?:[eE][+-]?\d+)?|===|!==|==|!=|<=|>=|=>|->|::|\+\+|--|&&|\|\||<<|>>|\*\*|[{}()\[\];,.?:+\-*/%&|^~<>=!])"""
KEYWORDS = "and as assert async await break case catch class const continue def delete do else elif enum except export extends false finally fn for from function go if import in interface let match namespace new nil none not null of or package private protected public raise return static struct super switch this throw trait true try type typeof use var while with yield".split()
CODE_MARK = r"(?:^\s*(?:def|class|function|fn|public|private|package|import|from|#include)\b|(?:assert|return|throw|raise)\s+|=>|::|\{[^}]*\}|\[[^]]*\]\s*=)"
BRACE_HEAD = r"(?m)^[ \t]*(?:[A-Za-z_$][\w$<>:\[\],*&? ]+[ \t]+)?[A-Za-z_$][\w$]*[ \t]*\([^;{}\n]{0,500}\)[ \t]*(?:const[ \t]*)?\{"
#: Tokens that a function needs to be a unit, and those of a block.
UNIT, BLOCK = 32, 96


def skeleton(text: Column) -> Column:
    """Code tokens with names, numbers and strings replaced, keywords and marks kept."""
    kind = lambda x: F.when(F.lower(x).isin(KEYWORDS), F.lower(x)).when(x.rlike("^[A-Za-z_$]"), "<id>").when(x.rlike("^[0-9]"), "<num>").when(x.rlike("^[\"'`]"), "<str>").otherwise(x)
    return F.transform(T.found(text, CODE_TOKEN), kind)


def looks_like_code(text: Column) -> Column:
    return text.rlike("(?dm)" + CODE_MARK) | (T.number_of(text, "[{}();=]") >= 4)


# Parts of content that is code rather than an answer.
CODE_NEEDLES = ["```", "def ", "class ", "import ", "#include", "SELECT ", "function ", "public "]


def holds_code(*texts: Column) -> Column:
    return F.exists(F.array(*map(F.lit, CODE_NEEDLES)), lambda x: F.contains(F.concat_ws("\n", *texts), x))


def units_of(text: str, path: str = "") -> dict[str, tuple[str, int]]:
    """digest: (kind, weight) of the functions of `UNIT` tokens or more and of the blocks of `BLOCK` tokens; the weight is the number of tokens."""
    tokens = re.compile(CODE_TOKEN).findall
    if path.lower().endswith(".py"):
        lines = text.splitlines(keepends=True)
        spans = ["".join(lines[a - 1 : b]) for _, a, b in functions_of(text)]
    else:
        heads = [(m.start(), text.find("{", m.start(), m.end())) for m in re.finditer(BRACE_HEAD, text)]
        ends = dict(braced(text, [at for _, at in heads]))
        spans = [text[a : ends[at]] for a, at in heads if at in ends]
    out: dict[str, tuple[str, int]] = {}

    def add(kind: str, found: list[str]) -> None:
        digest = hashlib.md5("\0".join(found).encode("utf-8", "surrogatepass")).hexdigest()
        if digest not in out or out[digest][1] < len(found):
            out[digest] = kind, len(found)

    for span in spans:
        if len(found := tokens(span)) >= UNIT:
            add("function", found)
    whole = tokens(text)
    for at in range(0, len(whole) - BLOCK + 1, BLOCK):
        add("block", whole[at : at + BLOCK])
    return out


def code_units(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, kind, digest, weight): functions and blocks, as units_of, and the whole file as one digest of all its tokens (weight: their number)."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tokens = re.compile(CODE_TOKEN).findall
        for part in parts:
            rows = []
            for k, t, p in zip(part[key], part[text], part["_path"]):
                own = tokens(t or "")
                rows.append((k, "file", hashlib.md5("\0".join(own).encode("utf-8", "surrogatepass")).hexdigest(), len(own)))
                rows += [(k, kind, digest, weight) for digest, (kind, weight) in units_of(t or "", p or "").items()]
            yield pd.DataFrame(rows, columns=[key, "kind", "digest", "weight"])

    return docs.select(key, text, F.col(path).alias("_path")).mapInPandas(run, f"{key} {docs.schema[key].dataType.simpleString()}, kind string, digest string, weight bigint")


def balanced_fill(rows: pd.DataFrame, minima: dict[str, int], target: int, category: str, size: str) -> pd.DataFrame:
    """Rows in order: first each category's minimum, then always from the category with the fewest bytes so far, until the target.

    Sequential by nature; for control tables of strata, not for documents.
    """
    queues = {k: list(g.index) for k, g in rows.groupby(category, sort=True)}
    taken, used = [], dict.fromkeys(queues, 0)

    def take(k: str) -> None:
        i = queues[k].pop(0)
        used[k] += int(rows.at[i, size])
        taken.append(i)

    for k, least in sorted(minima.items()):
        while queues.get(k) and used[k] < least:
            take(k)
    while sum(used.values()) < target and any(queues.values()):
        take(min((k for k in queues if queues[k]), key=lambda k: (used[k], k)))
    return rows.loc[taken]


def shard_places(lengths: list[int], capacity: int, shards: int, start: list[int]) -> list[list[tuple[int, int, int]]]:
    """For each document its pieces (shard, offset, length): from its hashed start on, the first shard with room, cut where one is full."""
    room = [capacity] * shards
    out = []
    for n, at in zip(lengths, start):
        pieces = []
        k = at % shards
        seen = 0
        while n and seen < shards:
            take = min(n, room[k])
            if take:
                pieces.append((k, capacity - room[k], take))
                room[k] -= take
                n -= take
            k, seen = (k + 1) % shards, seen + 1
        if n:
            raise ValueError("no shard has room")
        out.append(pieces)
    return out


# Families of fields of benchmark rows, keys that hold no text, and bounds.
FRAGMENTS = {
    "query": ["question", "prompt", "problem", "input", "question_content", "query", "instruction", "turns", "messages", "description", "title"],
    "context": ["context", "passage", "article", "story", "documents", "supporting_facts", "paragraphs", "background", "scenario", "fact1", "fact2", "fact3", "facts", "table", "pre_text", "post_text"],
    "choices": ["choices", "options", "endings", "candidates", "incorrect_answers", "distractors"],
    "answer": ["answer", "answers", "solution", "canonical_solution", "target", "output", "response", "reference_answer", "ideal", "label_text", "rationale", "explanation"],
    "code": ["code", "starter_code", "completion", "patch", "diff", "test", "tests", "test_list", "public_tests", "private_tests", "entry_point", "setup_code", "test_code"],
}
FRAGMENT = {"chars": 32_768, "row_chars": 131_072, "row_fragments": 256, "least_other": 24}


def strings_of(value, skip: frozenset[str]) -> Iterator[str]:
    """Texts inside a JSON value; plain values of objects behind their names."""
    if isinstance(value, str):
        if value.strip():
            yield value.strip()
    elif isinstance(value, (bool, int, float)):
        yield str(value)
    elif isinstance(value, list):
        for x in value:
            yield from strings_of(x, skip)
    elif isinstance(value, dict):
        for name, x in value.items():
            if name.lower() in skip:
                continue
            if isinstance(x, (str, bool, int, float)):
                if str(x).strip():
                    yield f"{name}: {str(x).strip()}"
            else:
                yield from strings_of(x, skip)


def fragments_of(row: dict, skip: frozenset[str]) -> list[tuple[str, str]]:
    """(kind, text) of a benchmark row: fields of each family in order, then others that are long enough; alike ones once, over-long ones not at all, and
    none after the row's bounds are reached."""
    named = [(kind, f) for kind, fields in FRAGMENTS.items() for f in fields if f in row]
    known = {f for _, f in named}
    named += [("other", f) for f in row if f not in known and f.lower() not in skip]
    out, seen, room = [], set(), FRAGMENT["row_chars"]
    for kind, field in named:
        for text in strings_of(row[field], skip):
            plain = T._folded(text)
            if not plain or plain in seen or len(plain) > FRAGMENT["chars"] or kind == "other" and len(plain) < FRAGMENT["least_other"]:
                continue
            if len(seen) == FRAGMENT["row_fragments"] or len(plain) > room:
                return out
            seen.add(plain)
            room -= len(plain)
            out.append((kind, text))
    return out


def holdout_fragments(rows: DataFrame, value: str, key: str, skip: Iterable[str] = ("id", "idx", "index")) -> DataFrame:
    """(key, kind, text) of the JSON texts of benchmark rows; key is the name of a whole number in them."""
    hidden = frozenset({key, *skip})

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            read = [json.loads(v) for v in part[value]]
            yield pd.DataFrame([(r[key], *f) for r in read for f in fragments_of(r, hidden)], columns=[key, "kind", "text"])

    return rows.select(value).mapInPandas(run, f"{key} bigint, kind string, text string")
