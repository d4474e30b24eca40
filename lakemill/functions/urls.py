"""URLs as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Query keys that only track, and what a rejected path holds.
TRACKING_KEYS = ["_ga", "_gl", "fbclid", "gclid", "mc_cid", "mc_eid", "ref", "ref_src", "source", "utm_campaign", "utm_content", "utm_medium", "utm_source", "utm_term"]
REJECTED_PATH = (
    r"(?i)(?:^|/)(?:account|accounts|auth|cart|checkout|comments?|feed|login|logout|register|search|signin|signup|sitemap|tag|tags|wp-admin)(?:/|$)"
    r"|(?:^|[?&])(?:page|paged|replytocom|session|sid)="
    r"|\.(?:7z|apk|avi|bin|bmp|css|dmg|docx?|epub|exe|gif|gz|ico|iso|jar|jpe?g|m4a|mkv|mov|mp3|mp4|mpeg|ogg|pdf|png|pptx?|rar|svg|tar|tiff?|webm|webp|woff2?|xlsx?|xml|xz|zip)(?:$|[?#])"
)
# Tokens of host and path for each category, in order of precedence; registry suffixes; and dates in paths.
CATEGORY_TOKENS = [
    ("official_docs", ["docs", "documentation", "developer", "developers", "api", "apis", "reference", "manual"]),
    ("official_docs", ["standards", "standard", "spec", "specification", "rfc"]),
    ("science", ["research", "science", "scientific", "laboratory", "journal", "preprint", "publication"]),
    ("software", ["changelog", "release", "releases", "engineering", "software", "package", "migration"]),
    ("technical", ["blog"]),
    ("technical", ["technical", "technology", "architecture"]),
    ("reporting", ["news"]),
]
GOVERNMENT_SUFFIXES = ["gov", "gov.uk", "gc.ca", "gouv.fr"]
EDUCATION_SUFFIXES = ["edu", "ac.uk", "edu.au", "ac.jp", "edu.cn"]
DATE_PATH = r"/(?:20(?:2[5-9]|[3-9][0-9]))/(?:0?[1-9]|1[0-2])(?:/|$)"


_START = r"^\s*([A-Za-z][A-Za-z0-9+.-]*)://"
#: User, host (in brackets or not) and port after the scheme.
_AUTHORITY = _START + r"(?:[^/?#]*@)?(\[[^\]/?#]*\]|[^/?#:@\[\]]*)(?::([^/?#]*))?(?=[/?#]|\s*$)"


def scheme(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, _START, 1))


def host(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))


def port(url: Column) -> Column:
    return F.regexp_extract(url, _AUTHORITY, 3)


def path(url: Column) -> Column:
    return F.regexp_extract(url, r"^\s*[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)", 1)


def query(url: Column) -> Column:
    return F.regexp_extract(url, r"^[^?#]*\?([^#]*)", 1)


def normal_host(url: Column) -> Column:
    """The host in ASCII (IDNA by the JVM), without dots at its ends; null if it isn't one: two labels or more of letters, digits and inner hyphens, 63
    characters each and 253 together, or an address of version 6."""
    given = F.regexp_extract(url, _AUTHORITY, 2)
    bare = F.regexp_replace(F.lower(F.regexp_replace(given, r"^\[|\]$", "")), r"^\.+|\.+$", "")
    ascii_ = F.when(bare.rlike(r"^[\x00-\x7f]*$"), bare).otherwise(F.try_reflect(F.lit("java.net.IDN"), F.lit("toASCII"), bare))
    labels = (F.length(ascii_) <= 253) & ascii_.rlike(r"^[a-z0-9](?:[a-z0-9-]{0,61}[a-z0-9])?(?:\.[a-z0-9](?:[a-z0-9-]{0,61}[a-z0-9])?)+$")
    six = given.startswith("[") & ascii_.rlike(r"^(?=.*:)(?!.*:::)(?!.*::.*::)[0-9a-f]{0,4}(?::[0-9a-f]{0,4}){2,7}$")
    return F.when(labels | six, ascii_)


def normal_path(p: Column) -> Column:
    """Slashes squeezed, none at the end but the root's."""
    squeezed = F.regexp_replace(F.concat(F.lit("/"), p), "/{2,}", "/")
    return F.when(squeezed.rlike("^/+$"), "/").otherwise(F.regexp_replace(squeezed, "/+$", ""))


def _decoded(x: Column) -> Column:
    """Plus signs and percent escapes; a percent sign that begins no escape stands for itself."""
    return F.url_decode(F.regexp_replace(x, "%(?![0-9A-Fa-f]{2})", "%25"))


def _encoded(x: Column) -> Column:
    """Letters, digits and _.-~ stay, a space is a plus sign."""
    return F.replace(F.replace(F.url_encode(x), F.lit("*"), F.lit("%2A")), F.lit("%7E"), F.lit("~"))


def normal_query(q: Column, drop_tracking: bool = True) -> Column:
    """Decoded pairs sorted and encoded again, without tracking keys; a bare key gets an equals sign."""
    pairs = F.transform(F.filter(F.split(q, "&"), lambda p: p != ""), lambda p: F.struct(_decoded(F.substring_index(p, "=", 1)).alias("k"), _decoded(F.when(F.contains(p, F.lit("=")), F.substr(p, F.locate("=", p) + 1)).otherwise("")).alias("v")))
    if drop_tracking:
        pairs = F.filter(pairs, lambda p: ~F.lower(p["k"]).isin(TRACKING_KEYS) & ~F.lower(p["k"]).startswith("utm_"))
    return F.array_join(F.transform(F.array_sort(pairs), lambda p: F.concat(_encoded(p["k"]), F.lit("="), _encoded(p["v"]))), "&")


def canonical_url(url: Column) -> Column:
    """ASCII form: lower-case scheme and host, no default port, squeezed path, sorted query without tracking, no fragment; null if not http,
    or without a valid host and port."""
    s, h, p, q = scheme(url), normal_host(url), port(url), normal_query(query(url))
    shown = F.when(F.contains(h, F.lit(":")), F.concat(F.lit("["), h, F.lit("]"))).otherwise(h)
    number = F.regexp_replace(p, "^0+(?=[0-9])", "")
    plain = (number == "") | (number == "0") | ((s == "http") & (number == "80")) | ((s == "https") & (number == "443"))
    whole = F.concat(s, F.lit("://"), shown, F.when(plain, "").otherwise(F.concat(F.lit(":"), number)), normal_path(path(url)), F.when(q == "", "").otherwise(F.concat(F.lit("?"), q)))
    return F.when(s.isin("http", "https") & h.isNotNull() & p.rlike("^[0-9]{0,5}$") & (F.coalesce(number.try_cast("int"), F.lit(0)) <= 65535), whole)


def published(url: Column) -> Column:
    """True for an http URL without white space or user, with a valid host and port."""
    u = F.trim(url)
    return F.coalesce(~u.rlike(r"[\s\x00-\x1f]") & scheme(u).isin("http", "https") & ~u.rlike(r"^[^/?#]*//[^/?#]*@") & normal_host(u).isNotNull() & port(u).rlike("^[0-9]{0,5}$") & (F.coalesce(port(u).try_cast("int"), F.lit(0)) <= 65535), F.lit(False))


def category(url: Column, registry_suffix: Column | None = None) -> Column:
    h, p = host(url), F.lower(path(url))
    suffix = F.lower(F.coalesce(registry_suffix, F.lit(""))) if registry_suffix is not None else F.lit("")
    tokens = F.filter(F.concat(F.split(h, r"[.\-_]"), F.split(p, r"[/._\-]")), lambda x: x != "")
    out = F.when(suffix.isin(GOVERNMENT_SUFFIXES) | h.endswith(".gov") | F.contains(h, F.lit(".gov.")), "government").when(suffix.isin(EDUCATION_SUFFIXES) | h.endswith(".edu"), "education")
    for name, words in CATEGORY_TOKENS:
        out = out.when(F.arrays_overlap(tokens, F.array(*map(F.lit, words))), name)
    return out.when(p.rlike(DATE_PATH), "reporting").otherwise("general")


def suffixes(h: Column) -> Column:
    """The host and every domain above it."""
    labels = F.split(h, r"\.")
    return F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))


def in_domain(h: Column, domain: Column) -> Column:
    return (h == domain) | h.endswith(F.concat(F.lit("."), domain))
