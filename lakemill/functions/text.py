"""Text features and normalizers as Column expressions."""

from __future__ import annotations

import unicodedata
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

WORD = r"[\p{L}\p{N}_]+"
#: Letters, digits, apostrophes and hyphens, with a letter or digit at either end.
QUALITY_WORD = r"[\p{L}\p{N}_](?:[\p{L}\p{N}_'-]*[\p{L}\p{N}_])?"
WORD_OR_MARK = r"[\p{L}\p{N}_]+|[^\p{L}\p{N}_\s]"
SPACED_TOKEN = r"\s+|[\p{L}\p{N}_]+|[^\p{L}\p{N}_\s]"

# Characters that end a line, and those that are white space beside them.
LINE_ENDS = r"\n\r\x0b\x0c\x1c-\x1e\x85\x{2028}\x{2029}"
BLANKS = r"\t\x1f\x20\xa0\x{1680}\x{2000}-\x{200a}\x{202f}\x{205f}\x{3000}"
#: Line ends with the white space around them, and white space at the ends of the text.
EDGES = f"^[{BLANKS}{LINE_ENDS}]+|[{BLANKS}]*[{LINE_ENDS}][{BLANKS}{LINE_ENDS}]*|[{BLANKS}{LINE_ENDS}]+$"

# What counts as a secret, a contact or boilerplate must agree with existing corpora.
SECRETS = {
    "private_key": r"-----BEGIN (?:RSA |EC |OPENSSH )?PRIVATE KEY-----",
    "access_key": r"\bAKIA[0-9A-Z]{16}\b",
    "forge_token": r"\b(?:ghp|github_pat)_[A-Za-z0-9_]{20,}\b",
    "service_key": r"\bsk-[A-Za-z0-9_-]{20,}\b",
}
PHONE_PUNCTUATED = r"(?:\+1[-. ]?)?(?:\(\d{3}\)[-. ]?|\d{3}[-.])\d{3}[-.]\d{4}\b"
PHONE_ANNOUNCED = r"(?i)(?:phone|telephone|tel|fax|mobile|cell|call|contact)\b[^\d\n]{0,24}(?:\+?1[-. ]?)?\(?\d{3}\)?[-. ]\d{3}[-. ]\d{4}\b"
SSN = r"\b\d{3}-\d{2}-\d{4}\b"
EMAIL = r"(?i)\b[A-Z0-9._%+-]+@[A-Z0-9.-]+\.[A-Z]{2,}\b"
RESERVED_DOMAIN = r"(?i)^(?:.+\.)?(?:example\.(?:com|net|org)|example|test|invalid|localhost)$"
ROLE_MAILBOXES = ["abuse", "admin", "billing", "contact", "customerservice", "editor", "editorial", "enquiries", "feedback", "help", "hello", "info", "inquiries", "legal", "mail", "media", "office", "orders", "permissions", "postmaster", "press", "privacy", "sales", "security", "service", "support", "team", "webmaster", "noreply", "no-reply", "donotreply", "do-not-reply"]
MODEL_BOILERPLATE = r"(?i)\b(?:as an ai language model|i do not have personal opinions|here (?:is|are) (?:a|the) (?:five|seven|ten)-section)\b"


def found(text: Column, pattern: str, group: int = 0) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(group))


def number_of(text: Column, pattern: str) -> Column:
    return F.regexp_count(text, F.lit(pattern)).cast("bigint")


def fraction(part: Column, whole: Column) -> Column:
    return part / F.greatest(whole, F.lit(1))


def without(text: Column, pattern: str) -> Column:
    return F.length(F.regexp_replace(text, pattern, ""))


def alpha_chars(text: Column) -> Column:
    return F.length(text) - without(text, r"\p{L}")


def symbol_chars(text: Column) -> Column:
    """Neither letter, number nor white space."""
    return F.length(text) - without(text, r"[^\p{L}\p{N}\s]")


def lines(text: Column) -> Column:
    """Stripped, without blank ones."""
    return F.filter(F.split(F.regexp_replace(text, EDGES, "\n"), "\n"), lambda x: x != "")


def stripped(text: Column) -> Column:
    return F.regexp_replace(text, f"^[{BLANKS}{LINE_ENDS}]+|[{BLANKS}{LINE_ENDS}]+$", "")


def repeated_line_fraction(text: Column) -> Column:
    return bound(lines(text), lambda own: F.when(F.size(own) > 0, 1 - F.size(F.array_distinct(own)) / F.size(own)).otherwise(0.0))


def canonical(text: Column) -> Column:
    """Lower case, white space collapsed, trimmed: the part of the canonical form that SQL has."""
    return F.trim(F.regexp_replace(F.lower(text), r"\s+", " "))


def _per_text(change: Callable[[str], str]):
    """An Arrow UDF that changes each text; made when it is used, for that needs a session."""

    def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for part in parts:
            yield part.map(lambda t: None if t is None else change(t))

    return F.pandas_udf(run, StringType())


def _folded(t: str) -> str:
    return " ".join(unicodedata.normalize("NFKC", t).casefold().split())


def _plain(t: str) -> str:
    apart = unicodedata.normalize("NFD", unicodedata.normalize("NFKC", t))
    return " ".join("".join(c for c in apart if unicodedata.category(c) != "Mn").lower().split())


def canonical_nfkc(text: Column | str) -> Column:
    """NFKC, case folding, white space collapsed, trimmed."""
    return _per_text(_folded)(text)


def plain_token(text: Column | str) -> Column:
    """NFKC, accents stripped, lower case, white space collapsed."""
    return _per_text(_plain)(text)


def raw_form(text: Column) -> Column:
    """A leading byte-order mark off and newlines as \\n; case and Unicode form kept."""
    return F.regexp_replace(F.regexp_replace(text, "^﻿", ""), "\r\n?", "\n")


def personal_emails(text: Column) -> Column:
    def personal(e: Column) -> Column:
        return ~F.lower(F.substring_index(e, "@", 1)).isin(ROLE_MAILBOXES) & ~F.substring_index(e, "@", -1).rlike(RESERVED_DOMAIN)

    return F.array_distinct(F.transform(F.filter(found(text, EMAIL), personal), F.lower))


def phones(text: Column) -> Column:
    """The last ten digits of each distinct phone number."""
    both = F.concat(found(text, PHONE_PUNCTUATED), found(text, PHONE_ANNOUNCED))
    return F.array_distinct(F.transform(both, lambda p: F.right(F.regexp_replace(p, r"\D", ""), F.lit(10))))


def contacts(text: Column) -> Column:
    return (F.size(personal_emails(text)) + F.size(phones(text)) + F.size(F.array_distinct(found(text, SSN)))).cast("bigint")


def has_secret(text: Column) -> Column:
    return text.rlike("|".join(f"(?:{p})" for p in SECRETS.values()))


def features(text: Column) -> dict[str, Column]:
    """What the quality rules read of a text. As columns of a table they are computed once a row, however many rules name them."""
    n, words = F.length(text).cast("bigint"), number_of(text, QUALITY_WORD)
    return {
        "characters": n,
        "words": words,
        "alpha_fraction": fraction(alpha_chars(text), n),
        "symbol_fraction": fraction(symbol_chars(text), n),
        "repeated_line_fraction": repeated_line_fraction(text),
        "url_density_per_100_words": fraction(number_of(text, r"(?i)https?://\S+") * 100.0, words),
        "contains_secret": has_secret(text),
        "distinct_personal_contacts": contacts(text),
        "probable_model_boilerplate": text.rlike(MODEL_BOILERPLATE),
    }


def sentences(text: Column) -> Column:
    """Cut after a run of . ! ? that white space or the end follows, and at newlines; collapsed, without blank ones."""
    marked = F.regexp_replace(text, r"([.!?]+)(\s+|$)", "$1\x01")
    return F.filter(F.transform(F.split(marked, "[\x01\n]"), lambda s: F.trim(F.regexp_replace(s, r"\s+", " "))), lambda s: s != "")


def sentence_spans(text: Column) -> Column:
    """[start, end) of each sentence, cut as `sentences` cuts, without the white space at its ends."""
    # a piece ends after its marks, or after a line end that it keeps
    pieces = F.split(F.regexp_replace(text, r"([.!?]+)(?=\s|$)", "$1\x01"), "\x01|(?<=\n)")
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start: int, end: int>>").alias("out"))

    def step(s: Column, p: Column) -> Column:
        own, n = F.regexp_replace(p, r"^\s+|\s+$", ""), F.length(p)
        lead = n - F.length(F.regexp_replace(p, r"^\s+", ""))
        span = F.struct((s["at"] + lead).alias("start"), (s["at"] + lead + F.length(own)).alias("end"))
        return F.struct((s["at"] + n).alias("at"), F.when(own != "", F.concat(s["out"], F.array(span))).otherwise(s["out"]).alias("out"))

    return F.aggregate(pieces, start, step, lambda s: s["out"])


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value) with value computed once a row, also where use names it inside a lambda."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def windows(items: Column, size: int) -> Column:
    """Every run of `size` neighbours, none where there are fewer."""
    return bound(items, lambda x: F.when(F.size(x) >= size, F.transform(F.sequence(F.lit(1), F.size(x) - (size - 1)), lambda i: F.slice(x, i, size))).otherwise(F.array().cast("array<array<string>>")))


def cleaned(text: Column) -> Column:
    """Unix newlines, no control characters, no spaces at line ends, single spaces, at most one blank line."""
    t = F.regexp_replace(F.regexp_replace(text, "\r\n?", "\n"), "[\x00-\x08\x0b\x0c\x0e-\x1f\x7f]", "")
    t = F.regexp_replace(F.regexp_replace(F.regexp_replace(t, "[ \t]+\n", "\n"), "[ \t]{2,}", " "), "\n{3,}", "\n\n")
    return F.regexp_replace(t, r"^\s+|\s+$", "")


def collapsed(text: Column) -> Column:
    """Unix newlines, single spaces, at most one blank line, stripped."""
    t = F.regexp_replace(F.regexp_replace(text, "\r\n?", "\n"), "[ \t]{2,}", " ")
    return stripped(F.regexp_replace(t, "\n{3,}", "\n\n"))


def collapsed_sql(name: str) -> str:
    """collapsed in DuckDB's words."""
    return f"regexp_replace(regexp_replace(regexp_replace(regexp_replace({name}, '\\r\\n?', chr(10), 'g'), '[ \\t]{{2,}}', ' ', 'g'), '\\n{{3,}}', chr(10) || chr(10), 'g'), '^[{BLANKS}{LINE_ENDS}]+|[{BLANKS}{LINE_ENDS}]+$', '', 'g')"


def alpha_ratio(text: Column) -> Column:
    """Letters among the characters that are no white space; 0 without any."""
    solid = F.regexp_replace(text, r"\s+", "")
    return F.when(F.length(solid) > 0, alpha_chars(solid) / F.length(solid)).otherwise(0.0)


def latin_ratio(text: Column) -> Column:
    """a-z among the letters; 1 without any."""
    letters = alpha_chars(text)
    return F.when(letters > 0, (F.length(text) - without(text, "[A-Za-z]")) / letters).otherwise(1.0)


def url_count(text: Column) -> Column:
    return number_of(text, r"http://|https://|www\.")


def longest_run(text: Column) -> Column:
    """Length of the longest run of one character."""
    return F.when(F.length(text) > 0, F.array_max(F.transform(found(text, r"(?s)(.)\1*"), F.length))).otherwise(0)


def low_quality(text: Column, least_alpha: float = 0.5, most_urls: int = 2, most_fences: int = 4) -> Column:
    return (F.trim(text) == "") | (alpha_ratio(text) < least_alpha) | (latin_ratio(text) < 0.65) | text.rlike(r"(?s)(.)\1{9,}") | (url_count(text) > most_urls) | (number_of(text, "```") > most_fences)


def role(name: Column) -> Column:
    r = F.lower(F.trim(name))
    return F.when(r.isin("human", "user"), "user").when(r.isin("gpt", "assistant", "model"), "assistant").otherwise(r)


# Weights and scales of the document quality score.
QUALITY = {"length": 0.20, "letters": 0.25, "lines": 0.20, "urls": 0.15, "decoding": 0.20, "full_length": 2000.0, "letters_from": 0.30, "letters_span": 0.35, "urls_per_100_words": 4.0, "broken_factor": 250.0}


def document_quality(text: Column) -> Column:
    """Five weighted components: length, letters, distinct lines, few URLs, clean decoding."""
    k = QUALITY
    n = F.length(text)
    words = number_of(text, QUALITY_WORD)
    urls = number_of(text, r"(?i)https?://\S+")
    broken = n - without(text, "[�\x00-\x08\x0b\x0c\x0e-\x1f\x7f-\x9f]")
    unit = lambda x: F.greatest(F.lit(0.0), F.least(F.lit(1.0), x))
    parts = [
        (k["length"], F.least(F.lit(1.0), F.sqrt(n / k["full_length"]))),
        (k["letters"], unit((fraction(alpha_chars(text), n) - k["letters_from"]) / k["letters_span"])),
        (k["lines"], F.greatest(F.lit(0.0), 1 - repeated_line_fraction(text))),
        (k["urls"], F.greatest(F.lit(0.0), 1 - fraction(urls * 100.0, words) / k["urls_per_100_words"])),
        (k["decoding"], F.greatest(F.lit(0.0), 1 - fraction(broken, n) * k["broken_factor"])),
    ]
    total = parts[0][1] * parts[0][0]
    for weight, x in parts[1:]:
        total = total + x * weight
    return unit(total)


# Function words by which English is told, and the weights and bounds of its score.
ENGLISH_WORDS = """a about after all also an and are as at be because been before between both but by can could do does each for from had has have
how if in into is it may more not of on one or other should such than that the their then there these this those to two use used was we were which will with would""".split()
ENGLISH_WORD = r"[A-Za-z]+(?:'[A-Za-z]+)?"
ENGLISH = {"script_weight": 0.50, "vocabulary_weight": 0.30, "frequency_weight": 0.20, "latin_share": 0.985, "most_distinct": 12.0, "least_distinct": 3.0, "words_to_distinct": 2.5, "frequency": 0.11, "least_letters": 40, "least_words": 12, "sampled_characters": 250_000}


def _latin_class() -> str:
    """A character class of the letters of the Basic Multilingual Plane whose Unicode name says LATIN."""
    out, start = [], None
    for c in range(0x10001):
        inside = c < 0x10000 and chr(c).isalpha() and (c < 128 or "LATIN" in unicodedata.name(chr(c), ""))
        if inside and start is None:
            start = c
        elif not inside and start is not None:
            out.append(f"\\x{{{start:x}}}-\\x{{{c - 1:x}}}")
            start = None
    return "[" + "".join(out) + "]"


LATIN = _latin_class()


def english_probability(text: Column) -> Column:
    """Script, vocabulary and frequency scores, weighted; null under the least letters or words. Words are those of the sampled
    characters, letters of the whole text; distinct function words are held against a number that grows with the words there are."""
    k = ENGLISH
    words = F.transform(found(F.substring(text, 1, k["sampled_characters"]), ENGLISH_WORD), F.lower)
    letters, latin = alpha_chars(text), F.length(text) - without(text, LATIN)
    at_most_1 = lambda x: F.least(F.lit(1.0), x)

    def score(w: Column) -> Column:
        n = F.size(w)
        hits = F.filter(w, lambda x: x.isin(ENGLISH_WORDS))
        target = F.least(F.lit(k["most_distinct"]), F.greatest(F.lit(k["least_distinct"]), n / k["words_to_distinct"]))
        whole = k["script_weight"] * at_most_1(latin / letters / k["latin_share"]) + k["vocabulary_weight"] * at_most_1(F.size(F.array_distinct(hits)) / target) + k["frequency_weight"] * at_most_1(F.size(hits) / n / k["frequency"])
        return F.when((letters >= k["least_letters"]) & (n >= k["least_words"]), F.round(whole, 6))

    return bound(words, score)


# What long-range structure is told by, and its bounds. The flags are put before each pattern by engine.
HEADING = r"^(?:#{1,6}\s+|(?:chapter|section|part|appendix)\s+[A-Z0-9IVXLC.-]+\b)"
LONG_REFERENCE = r"\b(?:see|refer to|as (?:shown|described|defined|proved)|above|below|earlier|later)\s+(?:in\s+)?(?:chapter|section|part|appendix|figure|table|equation|theorem|lemma|definition|listing|file|module|class|function)?"
CODE_DEPENDENCY = r"""^(?:\s*(?:from|import|include|require|use|mod|package)\b|\s*#include\s*[<"]|\s*(?:class|interface|trait|impl|def|fn)\s+)"""
STRUCTURE = {"long": 32_768, "very_long": 131_072, "headings": 4, "paragraphs": 24, "references": 4, "dependencies": 8}


def structural_evidence(text: Column, described: Column | None = None) -> Column:
    """0 to 5: a point each for long, very long, headed or many paragraphs, references or code dependencies, and metadata that names a
    repository, a scholarly or a long work."""
    k, point = STRUCTURE, lambda c: F.coalesce(c, F.lit(False)).cast("bigint")
    n, paragraphs = F.length(text), F.size(F.filter(F.split(text, r"\n\s*\n"), lambda p: F.trim(p) != ""))
    many = lambda flags, pattern, least: number_of(text, flags + pattern) >= least
    points = [
        n >= k["long"],
        n >= k["very_long"],
        many("(?dim)", HEADING, k["headings"]) | (paragraphs >= k["paragraphs"]),
        many("(?i)", LONG_REFERENCE, k["references"]) | many("(?dm)", CODE_DEPENDENCY, k["dependencies"]),
        described if described is not None else F.lit(False),
    ]
    return sum((point(p) for p in points[1:]), point(points[0]))


# Phrases that a licence text holds, all of them, in order of precedence; and those that veto any.
LICENSE_PHRASES = [
    ("Apache-2.0", ["apache license", "version 2.0"]),
    ("MIT", ["permission is hereby granted, free of charge", 'the software is provided "as is"']),
    ("MPL-2.0", ["mozilla public license version 2.0"]),
    ("Unlicense", ["this is free and unencumbered software released into the public domain"]),
    ("CC0-1.0", ["cc0 1.0 universal", "public domain"]),
    ("ISC", ["permission to use, copy, modify, and/or distribute this software", 'the software is provided "as is"']),
    ("BSD-3-Clause", ["redistribution and use in source and binary forms", "neither the name"]),
    ("BSD-2-Clause", ["redistribution and use in source and binary forms"]),
]
STRONG_COPYLEFT = ["gnu affero general public license", "gnu general public license", "gnu lesser general public license", "server side public license", "business source license"]


def license_family(text: Column) -> Column:
    """The licence of a licence text, told by phrases that all have to be there; null if none is, or one of strong copyleft."""
    has = lambda t, phrases: F.forall(F.array(*map(F.lit, phrases)), lambda p: F.contains(t, p))

    def told(t: Column) -> Column:
        out = F.when(F.exists(F.array(*map(F.lit, STRONG_COPYLEFT)), lambda p: F.contains(t, p)), F.lit(None).cast("string"))
        for name, phrases in LICENSE_PHRASES:
            out = out.when(has(t, phrases), name)
        return out

    return bound(F.lower(F.regexp_replace(text, r"[\s\x0b]+", " ")), told)


# URLs in messages, and marks by which secret tokens begin.
MESSAGE_URL = r"""(https?://[^\s'"<>?]+)\?[^\s'"<>]*"""
MESSAGE_TOKEN = r"\b(?:hf_|ghp_|github_pat_|sk-)[A-Za-z0-9_-]{16,}"


def redacted(message: Column) -> Column:
    """URL queries cut and secret tokens masked in an error message."""
    return F.regexp_replace(F.regexp_replace(message, MESSAGE_URL, "$1"), MESSAGE_TOKEN, "<redacted>")


def sequence_ratio(left: Column, right: Column) -> Column:
    """2 M / T of the case-folded texts, where M are the characters of matching blocks and T those of both (Ratcliff and Obershelp)."""
    from difflib import SequenceMatcher

    def run(parts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for a, b in parts:
            yield pd.Series([None if x is None or y is None else SequenceMatcher(a=x.casefold(), b=y.casefold()).ratio() for x, y in zip(a, b)], dtype="float64")

    return F.pandas_udf(run, "double")(left, right)
