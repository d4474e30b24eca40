"""Evidence that quality rules read: what came with a row, else what its text tells, and by which way it came."""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from . import evidence as E
from .reasons import MAXIMA, MINIMA, REQUIRED, SCANS, decided, profile, quality_reason

# The score that mathematics with sound marks gives, and how much of it plain text needs.
MATH_SCORE, LEAST_PLAIN, PLAIN_PER_1000 = 3.0, 8, 2.0


def _math_score(text: Column) -> Column:
    """The score of texts with sound mathematics: some LaTeX, or enough plain expressions for the length."""
    latex, plain = E.math_signals(text)
    dense = (plain >= LEAST_PLAIN) & (plain * 1000.0 / F.greatest(F.length(text), F.lit(1)) >= PLAIN_PER_1000)
    return F.when(E.equation_integrity(text) & ((latex >= 1) | dense), F.lit(MATH_SCORE))


#: field: (method, what the text and the other columns tell). Columns: title, path, license, page_ends and whole_book may be null.
COMPUTED: dict[str, tuple[str, Callable[[Column, Mapping[str, Column]], Column]]] = {
    "quality_score": ("computed_quality", lambda t, c: F.round(T.document_quality(t), 6)),
    "language_probability": ("computed_english", lambda t, c: T.english_probability(t)),
    "math_score": ("computed_equations", lambda t, c: _math_score(t)),
    "equation_integrity_passed": ("computed_equations", lambda t, c: E.equation_integrity(t)),
    "code_text_interleave": ("computed_interleave", lambda t, c: E.interleave_score(t)),
    "generated_file_probability": ("computed_generated", lambda t, c: E.generated_probability(t, c["path"])),
    "ocr_confidence": ("computed_pages", lambda t, c: E.pdf_evidence(t, c["page_ends"])["ocr_confidence"]),
    "repeated_header_footer_fraction": ("computed_pages", lambda t, c: E.pdf_evidence(t, c["page_ends"])["repeated_header_footer"]),
    "reading_order_passed": ("computed_pages", lambda t, c: E.pdf_evidence(t, c["page_ends"])["reading_order"]),
    "title_or_abstract": ("computed_structure", lambda t, c: E.has_title_or_abstract(t, c["title"])),
    "bibliography_body_ratio": ("computed_bibliography", lambda t, c: E.bibliography_ratio(t)),
    "open_access": ("computed_license", lambda t, c: E.open_access(c["license"])),
    "structurally_complete": ("computed_structure", lambda t, c: E.textbook_structure(t, c["title"], c["whole_book"]) | E.engineering_structure(t)),
    "chapter_integrity_passed": ("computed_structure", lambda t, c: E.chapter_integrity(t)),
    "question_and_answer": ("computed_structure", lambda t, c: E.has_question_and_answer(t)),
}
CONTEXT = {"title": "string", "path": "string", "license": "string", "page_ends": "array<int>", "whole_book": "boolean"}


def needed(limits: Mapping) -> list[str]:
    """The fields that a profile's rules read, in their order."""
    named = [f for table in (MINIMA, MAXIMA) for rule, f in table.items() if rule in limits]
    named += [f for rule, f in REQUIRED.items() if limits.get(rule)] + [f for rule, f in SCANS.items() if limits.get(rule) == "required"]
    return list(dict.fromkeys(named))


def derive(text: Column, fields: list[str], upstream: Mapping[str, Column], context: Mapping[str, Column] | None = None) -> dict[str, tuple[Column, Column]]:
    """(value, method) of each field: what came with the row, else what its text tells; null for both where neither does. Nothing that came is replaced."""
    c = {name: F.lit(None).cast(kind) for name, kind in CONTEXT.items()} | {"whole_book": F.lit(False)} | dict(context or {})
    out = {}
    for f in fields:
        way, told = COMPUTED[f] if f in COMPUTED else ("", None)
        own = upstream.get(f)
        values = [(F.lit("upstream_field"), own)] * (own is not None) + ([(F.lit(way), told(text, c))] if told else [])
        if not values:
            out[f] = F.lit(None).cast("string"), F.lit(None).cast("string")
        else:
            out[f] = F.coalesce(*[v for _, v in values]), F.coalesce(*[F.when(v.isNotNull(), m) for m, v in values])
    return out


def gate(rows: DataFrame, name: str, upstream: Mapping[str, Column] | None = None, context: Mapping[str, Column] | None = None, text: str = "text", **own) -> DataFrame:
    """rows with reason and decision under a named profile, from derived evidence; only what the profile reads is derived, once a row."""
    limits = profile(name, **own)
    t = F.col(text)
    found = derive(t, needed(limits), upstream or {}, context)
    kept = rows.columns
    made = rows.select("*", *[c.alias(f"_f_{k}") for k, c in T.features(t).items()], *[v.alias(f"_e_{k}") for k, (v, _) in found.items()])
    features, evidence = {k: F.col(f"_f_{k}") for k in T.features(t)}, {k: F.col(f"_e_{k}") for k in found}
    return decided(made, quality_reason(t, limits, evidence, features=features)).select(*kept, "reason", "decision")
