"""Extraction, text features, quality reasons, URLs, hashes."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import hashing as H
from ..functions import text as T
from ..functions import urls as U
from ..operators import reasons as R
from .registry import query, table

_W = r"[\p{L}\p{N}_]+"
_QW = T.QUALITY_WORD.replace("'", "''")
#: DuckDB: the stripped lines of a text that aren't blank.
LINES = f"list_filter(string_split(regexp_replace(text, '{T.EDGES}', chr(10), 'g'), chr(10)), lambda x: x <> '')"
#: DuckDB: the features of a text that the quality rules read.
FEATURES = rf"""
SELECT doc_id, lang, source, text, length(text) AS n, len(regexp_extract_all(text, '{_QW}')) AS words,
  length(text) - length(regexp_replace(text, '\p{{L}}', '', 'g')) AS alpha,
  length(text) - length(regexp_replace(text, '[^\p{{L}}\p{{N}}\s\x0b]', '', 'g')) AS symbols,
  {LINES} AS lines,
  len(regexp_extract_all(text, '(?i)https?://\S+')) AS urls
FROM documents"""


@query(f"""WITH f AS ({FEATURES}) SELECT doc_id, n AS chars, CAST(words AS BIGINT) AS words, round(alpha / greatest(n, 1), 6) AS alpha_fraction, round(symbols / greatest(n, 1), 6) AS symbol_fraction,
round(CASE WHEN len(lines) > 0 THEN 1 - len(list_distinct(lines)) / len(lines) ELSE 0 END, 6) AS repeated_line_fraction, round(100.0 * urls / greatest(words, 1), 6) AS url_density FROM f""")
def t7_text_features(spark, sf_dir):
    f = T.features(F.col("text"))
    rounded = {"alpha_fraction": "alpha_fraction", "symbol_fraction": "symbol_fraction", "repeated_line_fraction": "repeated_line_fraction", "url_density": "url_density_per_100_words"}
    return table(spark, sf_dir, "documents").select("doc_id", f["characters"].alias("chars"), f["words"].alias("words"), *[F.round(f[name], 6).alias(alias) for alias, name in rounded.items()])


_REASON = f"""SELECT doc_id, lang, text, CASE WHEN n < 300 THEN 'minimum_characters' WHEN n > 2000000 THEN 'maximum_characters' WHEN alpha / greatest(n, 1) < 0.45 THEN 'minimum_alpha_fraction'
 WHEN symbols / greatest(n, 1) > 0.35 THEN 'maximum_symbol_fraction' WHEN len(lines) > 0 AND 1 - len(list_distinct(lines)) / len(lines) > 0.20 THEN 'maximum_repeated_line_fraction' WHEN 100.0 * urls / greatest(words, 1) > 4.0 THEN 'maximum_url_density_per_100_words'
 WHEN regexp_matches(text, '-----BEGIN (?:RSA |EC |OPENSSH )?PRIVATE KEY-----') OR regexp_matches(text, '\\bAKIA[0-9A-Z]{{16}}\\b') OR regexp_matches(text, '\\b(ghp|github_pat)_[A-Za-z0-9_]{{20,}}\\b') OR regexp_matches(text, '\\bsk-[A-Za-z0-9_-]{{20,}}\\b') THEN 'secret'
 END AS reason FROM ({FEATURES})""".replace("\\\\", "\\")
_LIMITS = R.profile("web_general_v1", reject_personal_data=None, quality_score_minimum=None, language_probability_minimum=None)


@query(f"SELECT doc_id, reason FROM ({_REASON})")
def f1_quality_reason(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", R.quality_reason(F.col("text"), _LIMITS).alias("reason"))


@query(f"""WITH r AS ({_REASON}), d AS (SELECT *, CASE WHEN reason IS NULL AND row_number() OVER (PARTITION BY sha256(trim(regexp_replace(lower(text), '[\\s\\x0b]+', ' ', 'g'))), reason IS NULL ORDER BY doc_id % 100 DESC, doc_id) > 1 THEN 'exact_duplicate' ELSE reason END AS final FROM r)
SELECT lang, coalesce(final, 'accepted') AS reason, count(*) AS n FROM d GROUP BY ALL""")
def f1_quality_funnel(spark, sf_dir):
    """Accepted, de-duplicated documents per language and reason: texts are read once, duplicates are told by digests."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", R.quality_reason(F.col("text"), _LIMITS).alias("reason"), F.sha2(T.canonical(F.col("text")).cast("binary"), 256).alias("digest"))
    best = docs.where("reason IS NULL").groupBy("digest").agg(F.min_by("doc_id", F.struct(-(F.col("doc_id") % 100), "doc_id")).alias("winner"))
    judged = docs.join(best, "digest", "left").withColumn("reason", F.when(F.col("reason").isNull() & (F.col("doc_id") != F.col("winner")), "exact_duplicate").otherwise(F.col("reason")))
    return R.tally(judged, "lang")


@query(r"""SELECT d.doc_id, CASE WHEN length(text) < 400 THEN 'minimum_characters' WHEN l.quality IS NULL THEN 'missing_quality_score' WHEN l.quality < 0.72 THEN 'quality_score_minimum' END AS reason,
 CASE WHEN length(text) < 400 THEN 'minimum_characters' WHEN l.quality < 0.72 THEN 'quality_score_minimum' END AS open_reason FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id""")
def f2_profiles_and_missing_evidence(spark, sf_dir):
    """Missing evidence fails by itself, unless the profile is told not to."""
    rows = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels").select("doc_id", "quality"), "doc_id", "left")
    lax = R.profile("web_hq_v1", minimum_alpha_fraction=None, maximum_symbol_fraction=None, maximum_repeated_line_fraction=None, maximum_url_density_per_100_words=None, language_probability_minimum=None, reject_secrets=None, reject_personal_data=None)
    reason = lambda closed: R.quality_reason(F.col("text"), lax, {"quality_score": F.col("quality").cast("double")}, closed)
    return rows.select("doc_id", reason(True).alias("reason"), reason(False).alias("open_reason"))


def _evidence():
    """Evidence made from doc_id, so that every rule of every profile meets rows that have it, lack it and fail it."""
    d = F.col("doc_id")
    numbers = {f: F.when(d % 7 != i % 7, (d % 10) / 10.0 * (6 if f.endswith("al_score") or f in ("math_score", "component_count") else 1)) for i, f in enumerate([*R.MINIMA.values(), *R.MAXIMA.values()])}
    return numbers | {f: F.when(d % 11 != i % 11, "given").otherwise("") for i, f in enumerate(dict.fromkeys([*R.REQUIRED.values(), *R.SCANS.values()]))}


def _profile_sql(name: str) -> str:
    """The reason of a profile in DuckDB's words, for the features of f and the made evidence."""
    k, out = R.profile(name), []
    number = lambda i, f: f"(CASE WHEN doc_id % 7 <> {i % 7} THEN (doc_id % 10) / 10.0 * {6 if f.endswith('al_score') or f in ('math_score', 'component_count') else 1} END)"
    fields = [*R.MINIMA.values(), *R.MAXIMA.values()]
    flags = list(dict.fromkeys([*R.REQUIRED.values(), *R.SCANS.values()]))
    own = [("minimum_characters", "n < {}"), ("maximum_characters", "n > {}"), ("minimum_alpha_fraction", "alpha / greatest(n, 1) < {}"), ("maximum_symbol_fraction", "symbols / greatest(n, 1) > {}"), ("maximum_repeated_line_fraction", "len(lines) > 0 AND 1 - len(list_distinct(lines)) / len(lines) > {}"), ("maximum_url_density_per_100_words", "100.0 * urls / greatest(words, 1) > {}")]
    out += [(rule, test.format(k[rule])) for rule, test in own if rule in k]
    secret = "secret"
    if k.get("reject_secrets"):
        out.append(("secret", secret))
    if k.get("reject_personal_data"):
        out.append(("personal_data", f"contacts > {k.get('personal_data_maximum_contacts', 0)}"))
    if k.get("reject_probable_model_generated"):
        out.append(("probable_model_generated", "boilerplate"))
    for bounds, sign in ((R.MINIMA, "<"), (R.MAXIMA, ">")):
        for rule, f in bounds.items():
            if rule in k:
                v = number(fields.index(f), f)
                out += [(f"missing_{f}", f"{v} IS NULL"), (rule, f"{v} {sign} {float(k[rule])}")]
    absent = lambda f: f"doc_id % 11 = {flags.index(f) % 11}"
    out += [(f"missing_{f}", absent(f)) for rule, f in R.REQUIRED.items() if k.get(rule)]
    out += [("secret", secret)] * (k.get("secret_scan") == "required") + [("personal_data", "contacts > 0")] * (k.get("pii_scan") == "required")
    out += [(f"missing_{f}", absent(f)) for rule, f in R.SCANS.items() if k.get(rule) == "required"]
    return "CASE " + " ".join(f"WHEN {test} THEN '{reason}'" for reason, test in out) + " END"


_ROLES = ", ".join(f"'{r}'" for r in T.ROLE_MAILBOXES)
_CONTACTS = rf"""len(list_distinct(list_transform(list_filter(regexp_extract_all(text, '{T.EMAIL}'), lambda e: NOT list_contains([{_ROLES}], lower(split_part(e, '@', 1))) AND NOT regexp_matches(split_part(e, '@', 2), '{T.RESERVED_DOMAIN}')), lambda e: lower(e))))
 + len(list_distinct(list_transform(regexp_extract_all(text, '{T.PHONE_PUNCTUATED}') || regexp_extract_all(text, '{T.PHONE_ANNOUNCED}'), lambda p: right(regexp_replace(p, '\D', '', 'g'), 10)))) + len(list_distinct(regexp_extract_all(text, '{T.SSN}')))"""
_SECRET = " OR ".join(f"regexp_matches(text, '{p}')" for p in T.SECRETS.values())


@query(f"""WITH f AS ({FEATURES}), g AS MATERIALIZED (SELECT * EXCLUDE text, {_CONTACTS} AS contacts, {_SECRET} AS secret, regexp_matches(text, '{T.MODEL_BOILERPLATE}') AS boilerplate FROM f)
""" + " UNION ALL ".join(f"SELECT doc_id, '{name}' AS profile, {_profile_sql(name)} AS reason FROM g" for name in R.PROFILES))
def f1_f2_every_profile(spark, sf_dir):
    """The reason of each document under each of the named profiles; the text's features are taken once."""
    t = F.col("text")
    rows = table(spark, sf_dir, "documents").select("doc_id", *[c.alias(f"f_{name}") for name, c in T.features(t).items()])
    features = {name: F.col(f"f_{name}") for name in T.features(t)}
    reasons = F.array(*[F.struct(F.lit(name).alias("profile"), R.quality_reason(t, R.profile(name), _evidence(), features=features).alias("reason")) for name in R.PROFILES])
    return rows.select("doc_id", F.explode(reasons).alias("r")).select("doc_id", "r.profile", "r.reason")


@query(r"""SELECT doc_id, regexp_matches(text, '\bAKIA[0-9A-Z]{16}\b|\b(ghp|github_pat)_[A-Za-z0-9_]{20,}\b|\bsk-[A-Za-z0-9_-]{20,}\b|-----BEGIN (RSA |EC |OPENSSH )?PRIVATE KEY-----') AS secret,
CAST(len(regexp_extract_all(text, '\b\d{3}-\d{2}-\d{4}\b')) AS BIGINT) AS ssns,
CAST(len(list_distinct(list_transform(list_filter(regexp_extract_all(text, '(?i)\b[A-Z0-9._%+-]+@[A-Z0-9.-]+\.[A-Z]{2,}\b'), lambda e: NOT list_contains(['abuse','admin','billing','contact','customerservice','editor','editorial','enquiries','feedback','help','hello','info','inquiries','legal','mail','media','office','orders','permissions','postmaster','press','privacy','sales','security','service','support','team','webmaster','noreply','no-reply','donotreply','do-not-reply'], lower(split_part(e, '@', 1))) AND NOT regexp_matches(split_part(e, '@', 2), '(?i)^(.+\.)?(example\.(com|net|org)|example|test|invalid|localhost)$')), lambda e: lower(e)))) AS BIGINT) AS emails,
CAST(len(list_distinct(list_transform(regexp_extract_all(text, '(\+1[-. ]?)?(\(\d{3}\)[-. ]?|\d{3}[-.])\d{3}[-.]\d{4}\b') || regexp_extract_all(text, '(?i)(phone|telephone|tel|fax|mobile|cell|call|contact)\b[^\d\n]{0,24}(\+?1[-. ]?)?\(?\d{3}\)?[-. ]\d{3}[-. ]\d{4}\b'), lambda p: right(regexp_replace(p, '\D', '', 'g'), 10)))) AS BIGINT) AS phones FROM documents""")
def t8_t10_secrets_and_contacts(spark, sf_dir):
    t = F.col("text")
    return table(spark, sf_dir, "documents").select("doc_id", T.has_secret(t).alias("secret"), F.size(T.found(t, T.SSN)).cast("bigint").alias("ssns"), F.size(T.personal_emails(t)).cast("bigint").alias("emails"), F.size(T.phones(t)).cast("bigint").alias("phones"))


@query(r"SELECT doc_id, regexp_matches(text, '(?i)\b(as an ai language model|i do not have personal opinions|here (is|are) (a|the) (five|seven|ten)-section)\b') AS boilerplate FROM documents")
def t11_model_boilerplate(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.col("text").rlike(T.MODEL_BOILERPLATE).alias("boilerplate"))


@query(r"""SELECT doc_id, CAST(len(regexp_extract_all(text, '[\p{L}\p{N}_]+')) AS BIGINT) AS words, CAST(len(regexp_extract_all(text, '[\p{L}\p{N}_](?:[\p{L}\p{N}_''-]*[\p{L}\p{N}_])?')) AS BIGINT) AS quality_words,
CAST(len(regexp_extract_all(text, '[\p{L}\p{N}_]+|[^\p{L}\p{N}_\s\x0b]')) AS BIGINT) AS words_or_marks, CAST(len(regexp_extract_all(text, '[\s\x0b]+|[\p{L}\p{N}_]+|[^\p{L}\p{N}_\s\x0b]')) AS BIGINT) AS spaced FROM documents""")
def t3_t6_tokens(spark, sf_dir):
    t = F.col("text")
    return table(spark, sf_dir, "documents").select("doc_id", T.number_of(t, T.WORD).alias("words"), T.number_of(t, T.QUALITY_WORD).alias("quality_words"), T.number_of(t, T.WORD_OR_MARK).alias("words_or_marks"), T.number_of(t, T.SPACED_TOKEN).alias("spaced"))


_CANON = r"trim(regexp_replace(lower(text), '[\s\x0b]+', ' ', 'g'))"


@query(f"SELECT doc_id, sha256({_CANON}) AS digest FROM documents")
def t1_t2_canonical_digest(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", H.sha256(T.canonical(F.col("text"))).alias("digest"))


@query()
def t1_canonical_nfkc(spark, sf_dir):
    """With NFKC and case folding, which SQL lacks; tested against Python."""
    return table(spark, sf_dir, "documents").select("doc_id", H.sha256(T.canonical_nfkc("text")).alias("digest"))


@query()
def t50_canonical_tokens(spark, sf_dir):
    """Distinct accent-free tokens with dense ids by first appearance; the vocabulary is ranked in ranges, not in one task."""
    tokens = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(T.found(T.plain_token("text"), T.WORD)).alias("pos", "token")).groupBy("token").agg(F.min(F.struct("doc_id", "pos")).alias("first"), F.count("*").alias("n"))
    return tokens.select("token", "first.doc_id", "first.pos", "n")


_SENT = r"list_filter(list_transform(regexp_split_to_array(regexp_replace(text, '([.!?]+)([\s\x0b]+|$)', '\1' || chr(1), 'g'), '[\x01\n]'), lambda s: trim(regexp_replace(s, '[\s\x0b]+', ' ', 'g'))), lambda s: s <> '')"


@query(f"SELECT doc_id, CAST(len({_SENT}) AS BIGINT) AS n, sha256(array_to_string({_SENT}, chr(30))) AS digest FROM documents")
def t12_sentences(spark, sf_dir):
    s = T.sentences(F.col("text"))
    return table(spark, sf_dir, "documents").select("doc_id", F.size(s).cast("bigint").alias("n"), H.sha256(F.array_join(s, "\x1e")).alias("digest"))


@query(f"""WITH s AS (SELECT doc_id, {_SENT} AS s FROM documents), w AS (SELECT doc_id, unnest(range(1, len(s) - 1)) AS i, s FROM s WHERE len(s) >= 3)
SELECT doc_id, CAST(i - 1 AS INTEGER) AS pos, sha256(lower(array_to_string(s[i:i+2], chr(30)))) AS digest FROM w WHERE len(regexp_extract_all(array_to_string(s[i:i+2], ' '), '[\\p{{L}}\\p{{N}}_]+')) >= 24""")
def t13_t14_sentence_windows(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(T.windows(T.sentences(F.col("text")), 3)).alias("pos", "w"))
    return rows.where(T.number_of(F.array_join("w", " "), T.WORD) >= 24).select("doc_id", "pos", H.sha256(F.lower(F.array_join("w", "\x1e"))).alias("digest"))


@query(r"""SELECT doc_id, sha256(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, '\r\n?', chr(10), 'g'), '[\x00-\x08\x0b\x0c\x0e-\x1f\x7f]', '', 'g'), '[ \t]+\n', chr(10), 'g'), '[ \t]{2,}', ' ', 'g'), '\n{3,}', chr(10) || chr(10), 'g'), '^\s+|\s+$', '', 'g')) AS cleaned,
sha256(COLLAPSED) AS collapsed FROM documents""".replace("COLLAPSED", T.collapsed_sql("text")))
def t16_t17_clean_text(spark, sf_dir):
    t = F.col("text")
    return table(spark, sf_dir, "documents").select("doc_id", H.sha256(T.cleaned(t)).alias("cleaned"), H.sha256(T.collapsed(t)).alias("collapsed"))


@query(r"""WITH s AS (SELECT doc_id, text, regexp_replace(text, '[\s\x0b]+', '', 'g') AS solid, length(text) - length(regexp_replace(text, '\p{L}', '', 'g')) AS letters FROM documents)
SELECT doc_id, round(CASE WHEN length(solid) > 0 THEN letters / length(solid) ELSE 0 END, 6) AS alpha_ratio, round(CASE WHEN letters > 0 THEN (length(text) - length(regexp_replace(text, '[A-Za-z]', '', 'g'))) / letters ELSE 1 END, 6) AS latin_ratio,
CAST(len(regexp_extract_all(text, 'http://|https://|www\.')) AS BIGINT) AS urls FROM s""")
def t18_ratios(spark, sf_dir):
    t = F.col("text")
    return table(spark, sf_dir, "documents").select("doc_id", F.round(T.alpha_ratio(t), 6).alias("alpha_ratio"), F.round(T.latin_ratio(t), 6).alias("latin_ratio"), T.url_count(t).alias("urls"))


@query()
def t18_longest_run(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", T.longest_run(F.col("text")).alias("longest_run"))


_EN = ",".join(f"'{w}'" for w in T.ENGLISH_WORDS)


@query(rf"""WITH w AS (SELECT doc_id, text, list_transform(regexp_extract_all(left(text, 250000), '{T.ENGLISH_WORD.replace("'", "''")}'), lambda x: lower(x)) AS words, length(text) - length(regexp_replace(text, '\p{{L}}', '', 'g')) AS letters, length(text) - length(regexp_replace(text, '{T.LATIN}', '', 'g')) AS latin FROM documents),
h AS (SELECT *, list_filter(words, lambda x: list_contains([{_EN}], x)) AS hits FROM w)
SELECT doc_id, CASE WHEN letters >= 40 AND len(words) >= 12 THEN round(0.5 * least(1.0, CAST(latin AS DOUBLE) / letters / 0.985) + 0.3 * least(1.0, len(list_distinct(hits)) / least(12.0, greatest(3.0, len(words) / CAST(2.5 AS DOUBLE)))) + 0.2 * least(1.0, len(hits) / len(words) / CAST(0.11 AS DOUBLE)), 6) END AS english FROM h""")
def t20_english_probability(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", T.english_probability(F.col("text")).alias("english"))


@query(f"""WITH f AS ({FEATURES}), g AS (SELECT *, n - length(regexp_replace(text, '[\\x{{FFFD}}\\x00-\\x08\\x0b\\x0c\\x0e-\\x1f\\x7f-\\x{{9f}}]', '', 'g')) AS broken FROM f)
SELECT doc_id, round(greatest(0.0, least(1.0, 0.20 * least(1.0, sqrt(n / 2000.0)) + 0.25 * greatest(0.0, least(1.0, (alpha / greatest(n, 1) - CAST(0.30 AS DOUBLE)) / 0.35)) + 0.20 * greatest(0.0, 1 - CASE WHEN len(lines) > 0 THEN 1 - len(list_distinct(lines)) / len(lines) ELSE 0 END) + 0.15 * greatest(0.0, 1 - (100.0 * urls / greatest(words, 1)) / 4.0) + 0.20 * greatest(0.0, 1 - broken / greatest(n, 1) * 250.0))), 6) AS score FROM g""")
def t21_document_quality(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.round(T.document_quality(F.col("text")), 6).alias("score"))


_LICENSED = "WITH t AS (SELECT doc_id, lower(regexp_replace(CASE doc_id % 9 WHEN 0 THEN 'Apache License\n Version 2.0 ' WHEN 1 THEN 'Permission is hereby granted, free of charge ... THE SOFTWARE IS PROVIDED \"AS IS\" ' WHEN 2 THEN 'Redistribution and use in source and binary forms ' WHEN 3 THEN 'CC0 1.0 Universal ... public domain ' WHEN 4 THEN 'GNU General Public License ' ELSE '' END || text, '[\\s\\x0b]+', ' ', 'g')) AS t FROM documents)"
_HOLDS = lambda phrases: " AND ".join("contains(t, '{}')".format(p.replace("'", "''")) for p in phrases)


@query(_LICENSED.replace("\\n", "' || chr(10) || '") + " SELECT doc_id, CASE " + f"WHEN {' OR '.join(_HOLDS([p]) for p in T.STRONG_COPYLEFT)} THEN NULL " + " ".join(f"WHEN {_HOLDS(p)} THEN '{name}'" for name, p in T.LICENSE_PHRASES) + " END AS license FROM t")
def t29_license_family(spark, sf_dir):
    """Documents with heads of licences, by the phrases that a licence text holds."""
    heads = ["Apache License\n Version 2.0 ", 'Permission is hereby granted, free of charge ... THE SOFTWARE IS PROVIDED "AS IS" ', "Redistribution and use in source and binary forms ", "CC0 1.0 Universal ... public domain ", "GNU General Public License "]
    head = F.coalesce(*[F.when(F.col("doc_id") % 9 == i, F.lit(x)) for i, x in enumerate(heads)], F.lit(""))
    return table(spark, sf_dir, "documents").select("doc_id", T.license_family(F.concat(head, "text")).alias("license"))


_MANY = lambda flags, p, least: f"len(regexp_extract_all(text, '{flags}{p}')) >= {least}"
_POINT = lambda test: f"(CASE WHEN {test} THEN 1 ELSE 0 END)"


@query(f"""SELECT doc_id, CAST({_POINT("length(text) >= 32768")} + {_POINT("length(text) >= 131072")} + {_POINT(_MANY("(?im)", T.HEADING, 4) + " OR len(list_filter(regexp_split_to_array(text, '" + chr(92) + "n" + chr(92) + "s*" + chr(92) + "n'), lambda p: trim(p) <> '')) >= 24")}
 + {_POINT(_MANY("(?i)", T.LONG_REFERENCE, 4) + " OR " + _MANY("(?m)", T.CODE_DEPENDENCY, 8))} + {_POINT("doc_id % 3 = 0")} AS BIGINT) AS score FROM documents""")
def t42_structural_evidence(spark, sf_dir):
    """Every third document is of a repository."""
    repository = F.when(F.col("doc_id") % 3 == 0, "a/b")
    return table(spark, sf_dir, "documents").select("doc_id", T.structural_evidence(F.col("text"), repository.isNotNull()).alias("score"))


@query(r"""SELECT conv_id, turn, CASE WHEN lower(trim(role)) IN ('human', 'user') THEN 'user' WHEN lower(trim(role)) IN ('gpt', 'assistant', 'model') THEN 'assistant' ELSE lower(trim(role)) END AS role FROM conversations""")
def t44_role(spark, sf_dir):
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", T.role(F.col("role")).alias("role"))


@query(r"""SELECT doc_id, sha256(source || chr(0) || doc_id || chr(0) || 'text') AS row_id, sha256(regexp_replace(regexp_replace(text, '^\x{FEFF}', ''), '\r\n?', chr(10), 'g')) AS content_hash, coalesce(nullif(lang, ''), 'und') AS language FROM documents""")
def p4_normalized_identity(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", H.keyed(F.col("source"), F.col("doc_id"), F.lit("text")).alias("row_id"), H.sha256(T.raw_form(F.col("text"))).alias("content_hash"), F.coalesce(F.nullif("lang", F.lit("")), F.lit("und")).alias("language"))


@query(r"""SELECT doc_id, sha256(coalesce(CASE WHEN doc_id % 3 <> 0 AND trim(text) <> '' THEN text END, CASE WHEN trim(source) <> '' THEN source END)) AS body, sha256('Problem:' || chr(10) || source || chr(10) || chr(10) || 'Proof:' || chr(10) || text) AS sections FROM documents""")
def p1_p10_extraction(spark, sf_dir):
    """The first field that is not blank; sections of those that are there."""
    from ..sources.readers import first_text, sections

    blank = F.when(F.col("doc_id") % 3 == 0, "").otherwise(F.col("text"))
    whole = sections({"Problem": F.col("source"), "Formal statement": F.lit(""), "Proof": F.col("text")})
    return table(spark, sf_dir, "documents").select("doc_id", H.sha256(first_text(blank, F.col("source"))).alias("body"), H.sha256(whole).alias("sections"))


@query(r"""SELECT vec_id, CAST(list_position(embedding, list_max(embedding)) AS INTEGER) AS best, round(CAST(list_max(embedding) AS DOUBLE), 6) AS prob FROM embeddings""")
def p5_argmax(spark, sf_dir):
    """The label of the largest of two aligned arrays, the first of equals."""
    top = F.array_max("embedding")
    return table(spark, sf_dir, "embeddings").select("vec_id", F.array_position("embedding", top).cast("int").alias("best"), F.round(top.cast("double"), 6).alias("prob"))


@query(r"""SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k, coalesce(json_extract_string(props, '$.missing.path'), 'none') AS other FROM events""")
def p9_nested_path(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", F.get_json_object("props", "$.k").cast("bigint").alias("k"), F.coalesce(F.get_json_object("props", "$.missing.path"), F.lit("none")).alias("other"))


@query(r"""WITH p AS (SELECT doc_id, string_split(text, chr(10) || chr(10)) AS parts, text, source FROM documents), f AS (SELECT doc_id, unnest([struct_pack(kind := 'question', part := left(text, 200)), struct_pack(kind := 'answer', part := right(text, 200)), struct_pack(kind := 'other', part := source)], recursive := true) FROM p)
SELECT doc_id, kind, sha256(part) AS digest FROM f WHERE kind <> 'other' OR length(part) >= 24""")
def p11_p13_fragments(spark, sf_dir):
    """One row a field family; other fields need 24 characters."""
    kinds = F.array(F.struct(F.lit("question").alias("kind"), F.substring("text", 1, 200).alias("part")), F.struct(F.lit("answer").alias("kind"), F.right("text", F.lit(200)).alias("part")), F.struct(F.lit("other").alias("kind"), F.col("source").alias("part")))
    return table(spark, sf_dir, "documents").select("doc_id", F.explode(kinds).alias("f")).where("f.kind <> 'other' OR length(f.part) >= 24").select("doc_id", "f.kind", H.sha256(F.col("f.part")).alias("digest"))


@query(r"SELECT CAST((row_number() OVER (ORDER BY doc_id) - 1) % 4 AS INTEGER) AS part, doc_id FROM documents")
def p16_split_by_modulo(spark, sf_dir):
    """doc_id is dense, so its rank is itself: no global window."""
    return table(spark, sf_dir, "documents").select((F.col("doc_id") % 4).cast("int").alias("part"), "doc_id")


@query(r"""SELECT page_id, regexp_matches(url, '(?i)(?:^|/)(?:account|accounts|auth|cart|checkout|comments?|feed|login|logout|register|search|signin|signup|sitemap|tag|tags|wp-admin)(?:/|$)|(?:^|[?&])(?:page|paged|replytocom|session|sid)=|\.(?:7z|apk|avi|bin|bmp|css|dmg|docx?|epub|exe|gif|gz|ico|iso|jar|jpe?g|m4a|mkv|mov|mp3|mp4|mpeg|ogg|pdf|png|pptx?|rar|svg|tar|tiff?|webm|webp|woff2?|xlsx?|xml|xz|zip)(?:$|[?#])') AS rejected FROM pages""")
def u5_rejected_path(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", F.col("url").rlike(U.REJECTED_PATH).alias("rejected"))


_KEYS = ",".join(f"'{k}'" for k in U.TRACKING_KEYS)


@query(rf"""WITH p AS (SELECT page_id, lower(regexp_extract(url, '^([A-Za-z]+)://', 1)) AS s, regexp_replace(lower(regexp_extract(url, '^[A-Za-z]+://([^/?#:]*)', 1)), '^\.+|\.+$', '', 'g') AS h, regexp_extract(url, '^[A-Za-z]+://[^/?#]*([^?#]*)', 1) AS p, regexp_extract(url, '^[^?#]*\?([^#]*)', 1) AS q FROM pages),
n AS (SELECT *, array_to_string(list_transform(list_sort(list_filter(list_transform(list_filter(string_split(q, '&'), lambda x: x <> ''), lambda x: struct_pack(k := url_decode(replace(split_part(x, '=', 1), '+', ' ')), v := url_decode(replace(CASE WHEN contains(x, '=') THEN substr(x, position('=' IN x) + 1) ELSE '' END, '+', ' ')))), lambda x: NOT list_contains([{_KEYS}], lower(x.k)) AND NOT starts_with(lower(x.k), 'utm_'))), lambda x: replace(url_encode(x.k), '%20', '+') || '=' || replace(url_encode(x.v), '%20', '+')), '&') AS nq FROM p),
o AS (SELECT *, regexp_replace('/' || p, '/+', '/', 'g') AS np FROM n)
SELECT page_id, CASE WHEN s IN ('http', 'https') AND contains(h, '.') THEN s || '://' || h || CASE WHEN np = '/' THEN '/' ELSE regexp_replace(np, '/+$', '') END || CASE WHEN nq = '' THEN '' ELSE '?' || nq END END AS url, h AS host FROM o""")
def u1_u3_canonical_url(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", U.canonical_url(F.col("url")).alias("url"), U.normal_host(F.col("url")).alias("host"))


_TOKENS = lambda words: "[" + ", ".join(f"'{w}'" for w in words) + "]"


@query(rf"""WITH p AS (SELECT page_id, lower(regexp_extract(url, '^[A-Za-z]+://([^/?#:]*)', 1)) AS h, lower(regexp_extract(url, '^[A-Za-z]+://[^/?#]*([^?#]*)', 1)) AS p, CASE page_id % 13 WHEN 0 THEN 'gov.uk' WHEN 1 THEN 'ac.uk' ELSE 'com' END AS suffix FROM pages), t AS (SELECT *, regexp_split_to_array(h, '[._-]') || regexp_split_to_array(p, '[/._-]') AS t FROM p)
SELECT page_id, CASE WHEN list_contains({_TOKENS(U.GOVERNMENT_SUFFIXES)}, suffix) OR ends_with(h, '.gov') OR contains(h, '.gov.') THEN 'government' WHEN list_contains({_TOKENS(U.EDUCATION_SUFFIXES)}, suffix) OR ends_with(h, '.edu') THEN 'education' {" ".join(f"WHEN list_has_any(t, {_TOKENS(words)}) THEN '{name}'" for name, words in U.CATEGORY_TOKENS)} WHEN regexp_matches(p, '{U.DATE_PATH}') THEN 'reporting' ELSE 'general' END AS category FROM t""")
def u4_category(spark, sf_dir):
    """With the registry suffix that a crawl index has, made from page_id."""
    suffix = F.when(F.col("page_id") % 13 == 0, "gov.uk").when(F.col("page_id") % 13 == 1, "ac.uk").otherwise("com")
    return table(spark, sf_dir, "pages").select("page_id", U.category(F.col("url"), suffix).alias("category"))


@query(r"""WITH p AS (SELECT page_id, CASE page_id % 9 WHEN 0 THEN replace(url, '://', '://user@') WHEN 1 THEN regexp_replace(url, '^([a-z]+://[^/?#]*)', '\1:8080') WHEN 2 THEN upper(url) WHEN 3 THEN 'http://localhost/' WHEN 4 THEN url || ' x' ELSE url END AS u FROM pages) SELECT page_id, regexp_matches(lower(u), '^https?://[a-z0-9]([a-z0-9-]*[a-z0-9])?(\.[a-z0-9]([a-z0-9-]*[a-z0-9])?)+(:[0-9]{0,5})?([/?#][^ ]*)?$') AS published FROM p""")
def u6_published_url(spark, sf_dir):
    """With users, ports, upper case, one-label hosts and white space in some."""
    u, m = F.col("url"), F.col("page_id") % 9
    odd = F.when(m == 0, F.replace(u, F.lit("://"), F.lit("://user@"))).when(m == 1, F.regexp_replace(u, "^([a-z]+://[^/?#]*)", "$1:8080")).when(m == 2, F.upper(u)).when(m == 3, "http://localhost/").when(m == 4, F.concat(u, F.lit(" x"))).otherwise(u)
    return table(spark, sf_dir, "pages").select("page_id", U.published(odd).alias("published"))


@query(r"""SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%S.%f') AS iso, epoch_us(ts) AS micros, CASE WHEN event_id % 8 = 7 THEN NULL ELSE CAST(ts AS DATE) END AS day FROM events""")
def u7_u8_times(spark, sf_dir):
    """Days from times, ISO dates with - and /, month day year, day month year, short months, and none from others."""
    from ..functions import dates as D

    ts, m = F.col("ts"), F.col("event_id") % 8
    shown = F.when(m == 0, D.iso(ts))
    for k, form in enumerate(("yyyy-MM-dd HH:mm", "yyyy/M/d", "MMMM d, yyyy", "MMM d, yyyy", "d MMMM yyyy", "d MMM yyyy"), 1):
        shown = shown.when(m == k, F.date_format(ts, form))
    return table(spark, sf_dir, "events").select("event_id", D.iso(ts).alias("iso"), D.micros(ts.cast("timestamp")).alias("micros"), D.publication_date(shown.otherwise("in spring")).alias("day"))


@query(r"""SELECT doc_id, round(CAST('0x' || left(sha256('7' || chr(0) || source || chr(0) || doc_id), 13) AS BIGINT) / 4503599627370496.0, 9) AS fraction, CASE WHEN CAST('0x' || left(sha1(CAST(doc_id AS VARCHAR)), 8) AS BIGINT) / 4294967295.0 < 0.1 THEN 'val' ELSE 'train' END AS split, CAST(CAST('0x' || left(sha256(text), 15) AS BIGINT) % 64 AS BIGINT) AS bucket FROM documents""")
def u17_u19_stable_hashes(spark, sf_dir):
    d = F.col("doc_id")
    return table(spark, sf_dir, "documents").select("doc_id", F.round(H.stable_fraction(F.lit(7), F.col("source"), d), 9).alias("fraction"), H.split_name(d, 0.1).alias("split"), H.bucket(H.sha256(F.col("text")), 64).alias("bucket"))


@query(r"SELECT d.doc_id, CAST(greatest(1, least(65535, 500 * (d.doc_id % 100) + floor(250 * coalesce(l.quality, 0)) + 200 + 150 + 100)) AS BIGINT) AS score FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id")
def u20_priority_score(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select("doc_id").join(table(spark, sf_dir, "labels").select("doc_id", "quality"), "doc_id", "left")
    yes, no = F.lit(True), F.lit(False)
    return rows.select("doc_id", R.priority_score(F.col("doc_id") % 100, F.coalesce("quality", F.lit(0)), yes, yes, yes, no).alias("score"))


@query(r"""WITH w AS (SELECT doc_id, list_transform(regexp_extract_all(text, '[\p{L}\p{N}_]+'), lambda x: lower(x)) AS w FROM documents), g AS (SELECT doc_id, CASE WHEN len(w) >= 5 THEN list_distinct(list_transform(range(1, len(w) - 3), lambda i: md5(array_to_string(w[i:i+4], ' ')))) ELSE [] END AS g FROM w)
SELECT doc_id, CAST(len(g) AS BIGINT) AS grams, list_min(g) AS least FROM g""")
def u9_u14_shingles(spark, sf_dir):
    from ..operators.decontam import ngrams

    g = F.array_distinct(ngrams(F.col("text"), 5))
    return table(spark, sf_dir, "documents").select("doc_id", F.size(g).cast("bigint").alias("grams"), F.array_min(g).alias("least"))


@query()
def u11_simhash(spark, sf_dir):
    """64 bits of md5, by majority over 5-word shingles; tested against Python."""
    words = F.transform(T.found(F.col("text"), T.WORD), F.lower)
    return H.word_simhashes(table(spark, sf_dir, "documents").select("doc_id", F.array_join(words, " ").alias("words")), 5, "doc_id", "words")


@query(r"SELECT a.vec_id, bit_count(xor(a.vec_id * 2654435761, (a.vec_id + 1) * 40503)) AS distance FROM embeddings a")
def u12_hamming(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").select("vec_id", H.hamming(F.col("vec_id") * 2654435761, (F.col("vec_id") + 1) * 40503).cast("tinyint").alias("distance"))


@query()
def u13_affine_minhash(spark, sf_dir):
    """128 minima modulo 2^61 - 1 over 5-word shingles, empty for short texts."""
    return table(spark, sf_dir, "documents").select("doc_id", H.affine_minhash()(T.found(F.col("text"), T.WORD)).alias("signature"))


@query(r"""WITH w AS (SELECT doc_id, lang, list_transform(regexp_extract_all(text, '[\p{L}\p{N}_]+'), lambda x: lower(x)) AS w FROM documents), g AS (SELECT doc_id, lang, unnest(list_distinct(list_transform(range(1, len(w) - 3), lambda i: CAST('0x' || left(md5(array_to_string(w[i:i+4], ' ')), 8) AS BIGINT)))) AS h FROM w WHERE len(w) >= 5),
ab AS (SELECT k, CAST((k + 1) * 2654435761 % 1073741789 AS BIGINT) AS a, CAST((k + 1) * 40503 * 65537 % 1073741827 AS BIGINT) AS b FROM (SELECT unnest(range(0, 128)) AS k)), s AS (SELECT doc_id, lang, k, min((a * h + b) % 2147483647) AS m FROM g, ab GROUP BY ALL)
SELECT doc_id, CAST(k // 8 AS INTEGER) AS band, sha256(lang || '|' || k // 8 || '|' || string_agg(m, ',' ORDER BY k)) AS key FROM s GROUP BY doc_id, lang, k // 8""")
def u13_u16_minhash_bands(spark, sf_dir):
    """Keys of 16 bands of 8 of 128 minima, with the comparison's scope in them."""
    from ..operators.dedup import band_keys, signatures

    words = F.transform(T.found(F.col("text"), T.WORD), F.lower)
    shingles = F.array_distinct(F.transform(T.windows(words, 5), lambda w: H.short_hash(F.array_join(w, " "))))
    signed = signatures(table(spark, sf_dir, "documents").select("doc_id", "lang", shingles.alias("s")), "s", 128)
    return signed.select("doc_id", F.posexplode(band_keys(F.col("s"), 8, F.col("lang"))).alias("band", "key"))


@query(r"SELECT doc_id, CAST(greatest(2, ceil(0.002 * length(text))) AS BIGINT) AS required FROM documents")
def u22_required_matches(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.greatest(F.lit(2), F.ceil(F.length("text") * 0.002)).cast("bigint").alias("required"))


@query(r"SELECT p_partkey, regexp_replace(lower(p_brand), '[^a-z0-9]+', '', 'g') AS key, regexp_replace(lower(p_brand), '[^a-z0-9]+', '', 'g') IN ('brand12', 'brand23') AS known FROM part")
def u23_genealogy(spark, sf_dir):
    from ..operators.decontam import genealogy_key

    k = genealogy_key(F.col("p_brand"))
    return table(spark, sf_dir, "part").select("p_partkey", k.alias("key"), k.isin("brand12", "brand23").alias("known"))


@query(r"SELECT doc_id, sha256(source || '|' || lang) AS scope, sha256(coalesce(CASE WHEN doc_id % 2 = 0 THEN source END, lang)) AS group_id FROM documents")
def u16_u25_scopes(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", H.sha256(F.concat_ws("|", "source", "lang")).alias("scope"), H.sha256(F.coalesce(F.when(F.col("doc_id") % 2 == 0, F.col("source")), F.col("lang"))).alias("group_id"))


@query(r"SELECT event_id, try_cast(json_extract_string(props, '$.k') AS DOUBLE) AS rating, try_cast(event_type AS DOUBLE) AS not_a_number FROM events")
def t48_u26_coercions(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", F.expr("try_cast(get_json_object(props, '$.k') AS DOUBLE)").alias("rating"), F.expr("try_cast(event_type AS DOUBLE)").alias("not_a_number"))


@query(r"""WITH t AS (SELECT doc_id, text, list_transform(regexp_split_to_array(regexp_replace(text, '(\r\n|[LB])$', ''), '\r\n|[LB]'), lambda x: length(x)) AS n FROM documents) SELECT doc_id, CASE WHEN doc_id % 17 = 0 THEN 'repository_fork' WHEN doc_id % 29 = 0 THEN 'vendored_file' WHEN doc_id % 31 = 0 THEN 'generated_file' WHEN doc_id % 19 = 0 THEN 'lockfile' WHEN doc_id % 13 = 0 THEN 'vendored_or_build_tree' WHEN doc_id % 11 = 0 THEN 'generated_or_minified_path'
 WHEN regexp_matches(lower(left(text, 4000)), '@generated|auto-generated|automatically generated') THEN 'generated_file_header' WHEN doc_id % 23 = 0 OR doc_id % 37 = 0 THEN 'benchmark_solution_repository' WHEN list_max(n) > 20000 OR (list_sum(n) / len(n) > 500 AND len(n) >= 8) THEN 'probable_minified_or_blob' END AS reason FROM t""".replace("LB", T.LINE_ENDS))
def f11_code_hygiene(spark, sf_dir):
    d = F.col("doc_id")
    where = F.when(d % 19 == 0, "app\\Yarn.lock").when(d % 13 == 0, "./src/node_modules/a.js").when(d % 11 == 0, "web/site.min.js").otherwise("src/main.py")
    name = F.when(d % 23 == 0, "me/MMLU-Pro").when(d % 37 == 0, "you/my-leetcode-solutions").otherwise("me/mmluck")
    reason = R.code_hygiene_reason(F.col("text"), where, name, d % 17 == 0, F.lit(False), vendored=d % 29 == 0, generated=d % 31 == 0)
    return table(spark, sf_dir, "documents").where("text IS NOT NULL").select("doc_id", reason.alias("reason"))


@query(r"""SELECT doc_id FROM documents WHERE n_chars >= 500 AND lang IN ('en', 'de') AND NOT contains(source, '7') AND (length(text) - length(regexp_replace(text, '\p{L}', '', 'g'))) / greatest(length(regexp_replace(text, '[\s\x0b]+', '', 'g')), 1) >= 0.6""")
def f12_f16_row_filters(spark, sf_dir):
    rules = [F.col("n_chars") >= 500, F.col("lang").isin("en", "de"), ~F.contains("source", F.lit("7")), T.alpha_ratio(F.col("text")) >= 0.6]
    out = table(spark, sf_dir, "documents")
    for rule in rules:
        out = out.where(rule)
    return out.select("doc_id")


@query(r"""SELECT source, count(*) AS total, count(*) FILTER (length(text) >= 400) AS accepted, count(*) FILTER (length(text) >= 400) >= 0.9 * count(*) AS admitted FROM documents GROUP BY source""")
def f22_admission(spark, sf_dir):
    accepted = F.count(F.when(F.length("text") >= 400, 1))
    return table(spark, sf_dir, "documents").groupBy("source").agg(F.count("*").alias("total"), accepted.alias("accepted")).withColumn("admitted", F.col("accepted") >= F.col("total") * 0.9)
