"""Text functions for directory records, as column expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# The Turkish letters and what they fold to.
TURKISH, ASCII_SAME, ASCII_LOWER = "çÇğĞıİöÖşŞüÜ", "cCgGiIoOsSuU", "ccggiioossuu"
# Name endings that are dropped, and tokens that are replaced (an empty one is dropped).
NAME_ENDINGS = "ECZANESI|ECZANELERÎ|ECZANELERI|ECZÂNESI|ECZANELERE|ECZANE|ECZÂNE|ECZ.|ECZ"
NAME_TOKENS = {"DR": "DOKTOR", "AV": "AVUKAT", "NO:": "", "NO": ""}
# Endings of district names, dropped in this order.
DISTRICT_ENDINGS = ["ilcesi", "ilces", "merkezi", "belediyesi", "beldesi"]
SEVERITIES = {"high": "critical", "medium": "warning", "low": "info", "critical": "critical", "warning": "warning", "info": "info"}
LEVEL_POINTS = {"exact": 15, "normalized": 12, "alias": 10, "fuzzy": 6, "fallback": 2, "none": 0}
MONTHS = ["Ocak", "Şubat", "Mart", "Nisan", "Mayıs", "Haziran", "Temmuz", "Ağustos", "Eylül", "Ekim", "Kasım", "Aralık"]


def lookup(key: Column, pairs: dict, default) -> Column:
    """The value of key in a small fixed table."""
    made = F.create_map(*[F.lit(x) for kv in pairs.items() for x in kv])
    return F.coalesce(F.try_element_at(made, key), F.lit(default))


def held(f: Callable[..., Column], *values: Column) -> Column:
    """f of values that are computed once, however often f names them: an expression in a lambda is computed wherever it is
    named."""
    names = [f"v{k}" for k in range(len(values))]
    made = F.array(F.struct(*[v.alias(n) for v, n in zip(values, names, strict=True)]))
    return F.get(F.transform(made, lambda v: f(*[v[n] for n in names])), 0)


def squeezed(s: Column) -> Column:
    return F.trim(F.regexp_replace(s, r"\s+", " "))


def trimmed(s: Column) -> Column:
    """Without white space of any kind at the ends."""
    return F.regexp_replace(s, r"^\s+|\s+$", "")


def slugify(s: Column) -> Column:
    """Lower case ASCII; runs of anything else become one dash, none at the ends."""
    s = F.lower(F.translate(F.trim(s), TURKISH, ASCII_LOWER))
    return F.regexp_replace(F.regexp_replace(s, "[^a-z0-9]+", "-"), "^-+|-+$", "")


def province_slug(s: Column) -> Column:
    """Folds after lowering; white space becomes dashes and other characters go."""
    s = F.translate(F.lower(s), TURKISH, ASCII_LOWER)
    return F.regexp_replace(F.regexp_replace(s, r"\s+", "-"), "[^a-z0-9-]", "")


def turkish_slug(s: Column) -> Column:
    """Lowers as Turkish does (I to dotless i) and strips one dash at each end."""
    s = F.translate(F.lower(F.translate(s, "Iİ", "ıi")), TURKISH, ASCII_LOWER)
    return F.regexp_replace(F.regexp_replace(s, "[^a-z0-9]+", "-"), "^-|-$", "")


def normalize_text(s: Column) -> Column:
    """Lower case with Turkish letters folded; a dotted capital I keeps its combining dot."""
    return squeezed(F.translate(F.lower(s), "çğıöşü", "cgiosu"))


def district_name(s: Column) -> Column:
    s = F.lower(F.translate(F.trim(F.coalesce(s, F.lit(""))), TURKISH, ASCII_SAME))
    for ending in DISTRICT_ENDINGS:
        s = F.regexp_replace(s, rf"\s+{ending}\s*$", "")
    return squeezed(s)


def pharmacy_name(s: Column) -> Column:
    """Upper case ASCII without punctuation, bracketed remarks, the trade's endings and duty prefixes. Dots go before the
    list number and the dotted short forms are looked for, so these stay."""
    s = F.upper(F.translate(F.trim(F.coalesce(s, F.lit(""))), TURKISH, ASCII_SAME))
    s = F.regexp_replace(s, r"[.,'/\\]+", " ")
    s = F.regexp_replace(s, r"\([^)]{0,40}\)", " ")
    s = F.regexp_replace(s, rf"\s+({NAME_ENDINGS})\s*$", "")
    s = F.regexp_replace(F.regexp_replace(s, r"^\d+\.\s+", ""), r"^NOBETCI\s+", "")
    tokens = F.transform(F.split(s, r"\s+"), lambda t: lookup_token(t))
    return F.array_join(F.filter(tokens, lambda t: t != ""), " ")


def lookup_token(t: Column) -> Column:
    out = t
    for k, v in NAME_TOKENS.items():
        out = F.when(t == k, F.lit(v)).otherwise(out)
    return out


def script_name(s: Column) -> Column:
    """The plainer form of names that offline lists use: hyphens become spaces, endings go one after the other."""
    s = F.upper(F.translate(F.trim(F.coalesce(s, F.lit(""))), TURKISH + "i", ASCII_SAME + "I"))
    s = F.regexp_replace(s, r"[.,'/\\-]+", " ")
    for ending in ("ECZANESI", "ECZANE", "ECZ"):
        s = F.regexp_replace(s, rf"\s+{ending}\s*$", "")
    return squeezed(s)


def strip_tags(s: Column) -> Column:
    return squeezed(F.regexp_replace(s, "<[^>]+>", " "))


def decode_entities(s: Column) -> Column:
    """Named ones in this order, so a doubly escaped bracket is decoded; numbers; any other becomes a space."""
    for name, char in (("nbsp", " "), ("amp", "&"), ("lt", "<"), ("gt", ">"), ("quot", '"'), ("#39", "'")):
        s = F.regexp_replace(s, f"(?i)&{name};", char)
    numbers = F.array_distinct(F.regexp_extract_all(s, F.lit(r"&#(\d{1,7});"), F.lit(1)))
    s = F.aggregate(numbers, s, lambda acc, n: F.replace(acc, F.concat(F.lit("&#"), n, F.lit(";")), F.char(n.cast("long"))))
    return F.regexp_replace(s, "(?i)&[a-z]+;", " ")


def clean_phone(s: Column) -> Column:
    return squeezed(F.regexp_replace(s, r"[^\d+() -]", ""))


def digits(s: Column) -> Column:
    return F.regexp_replace(F.coalesce(s, F.lit("")), r"\D", "")


def fold_turkish(s: Column) -> Column:
    return F.translate(s, TURKISH, ASCII_SAME)


def escape_xml(s: Column) -> Column:
    for char, name in (("&", "amp"), ("<", "lt"), (">", "gt"), ('"', "quot"), ("'", "apos")):
        s = F.replace(s, F.lit(char), F.lit(f"&{name};"))
    return s


def severity(s: Column) -> Column:
    return lookup(F.lower(trimmed(s)), SEVERITIES, "warning")


def title_from_slug(s: Column) -> Column:
    return F.initcap(F.replace(s, F.lit("-"), F.lit(" ")))


def turkish_title(s: Column) -> Column:
    """Each word with its first letter upper and the rest lower, i and I by the Turkish rules."""
    upper = lambda x: F.upper(F.translate(x, "iı", "İI"))
    lower = lambda x: F.lower(F.translate(x, "Iİ", "ıi"))
    return F.array_join(F.transform(F.split(s, " "), lambda w: F.concat(upper(F.substring(w, 1, 1)), lower(w.substr(F.lit(2), F.length(w))))), " ")


def cap(s: Column, most: int) -> Column:
    """Cut at a word so that it fits with an ellipsis."""
    cut = F.regexp_replace(F.substring(s, 1, most - 1), r"\s+\S*\z", "")
    return F.when(F.length(s) <= most, s).otherwise(F.concat(cut, F.lit("…")))


def first_fit(candidates: list[Column], most: int) -> Column:
    """The first that is short enough, else the last one cut."""
    return F.coalesce(*[F.when(F.length(c) <= most, c) for c in candidates], cap(candidates[-1], most))


def map_coordinates(href: Column) -> tuple[Column, Column]:
    """Latitude and longitude of a map link; null if there are none."""
    pattern = r"[?&]q=(-?\d+(?:\.\d+)?),(-?\d+(?:\.\d+)?)"
    return tuple(F.nullif(F.regexp_extract(href, pattern, k), F.lit("")).cast("double") for k in (1, 2))


def feed_name(s: Column) -> tuple[Column, Column]:
    """'districts-2' is base districts, page 2; without a number it is page 1."""
    page = F.nullif(F.regexp_extract(s, r"-(\d+)$", 1), F.lit("")).cast("int")
    return F.regexp_replace(s, r"-\d+$", ""), F.coalesce(page, F.lit(1))


def client_address(real: Column, forwarded: Column, socket: Column) -> Column:
    last = F.trim(F.element_at(F.split(forwarded, ","), -1))
    return F.coalesce(F.nullif(F.trim(real), F.lit("")), F.nullif(last, F.lit("")), socket)


# Hosts and endings of hosts that must not be fetched, and the private ranges of address literals.
BLOCKED_HOSTS = ["localhost", "metadata.google.internal", "169.254.169.254", "169.254.170.2"]
BLOCKED_ENDINGS = [".local", ".internal", ".localhost"]
PRIVATE_RANGES = [r"^127\.", r"^10\.", r"^172\.(1[6-9]|2\d|3[01])\.", r"^192\.168\.", r"^169\.254\.", "^::1$", "(?i)^fc00:", "(?i)^fe80:"]


def url_host(url: Column) -> Column:
    """The host in lower case without a dot at its end; an address given as one number is written with dots."""
    raw = F.regexp_extract(F.trim(url), r"(?i)^[a-z][a-z0-9+.-]*:[/\\]*(?:[^/\\?#@]*@)?(\[[^\]]*\]|[^/\\:?#]*)", 1)
    host = F.regexp_replace(F.lower(raw), r"\.$", "")
    number = F.when(host.rlike(r"^\d{1,10}$"), host.cast("long"))
    dotted = F.concat_ws(".", *[F.shiftright(number, k).bitwiseAND(255).cast("string") for k in (24, 16, 8, 0)])
    return F.when(number < 1 << 32, dotted).otherwise(host)


def url_fault(url: Column) -> Column:
    """ok, or why a URL must not be fetched: invalid, protocol, blocked_host, tld, private_ip. Ranges hold for address
    literals only, so a name that begins like one is a name."""
    protocol, host = F.lower(F.regexp_extract(F.trim(url), "(?i)^([a-z][a-z0-9+.-]*):", 1)), url_host(url)
    bare = F.regexp_replace(host, r"^\[|\]$", "")
    literal = host.rlike(r"^[\d.]+$|^\[[\da-f:]+\]$")
    ending, private = host.endswith(BLOCKED_ENDINGS[0]), bare.rlike(PRIVATE_RANGES[0])
    for e in BLOCKED_ENDINGS[1:]:
        ending = ending | host.endswith(e)
    for r in PRIVATE_RANGES[1:]:
        private = private | bare.rlike(r)
    return (
        F.when(url.isNull() | (protocol == ""), "invalid")
        .when(~protocol.isin("http", "https"), "protocol")
        .when(host == "", "invalid")
        .when(host.isin(BLOCKED_HOSTS), "blocked_host")
        .when(ending, "tld")
        .when(literal & private, "private_ip")
        .otherwise("ok")
    )


# Parts of the messages of fetch errors that may pass by themselves.
TRANSIENT = ["aborted", "timed out", "timeout", "fetch failed", "socket", "network"]


def transient(message: Column, name: Column | None = None) -> Column:
    """Whether a fetch error may pass by itself, by its message, or its name if that tells of an abort."""
    found = F.lower(F.coalesce(name if name is not None else F.lit(""), F.lit(""))).contains("abort")
    for part in TRANSIENT:
        found = found | F.lower(F.coalesce(message, F.lit(""))).contains(part)
    return found


def recovery_message(status: Column, missing: Column, extra: Column, mismatch: Column) -> Column:
    """Why a run isn't settled: unknown without a status, the differences if there are any, else the status."""
    counts = F.format_string("recovery_unresolved_diff:missing=%d,extra=%d,mismatch=%d", missing, extra, mismatch)
    return F.when(status.isNull(), "recovery_unresolved:unknown").when(missing + extra + mismatch > 0, counts).otherwise(F.concat(F.lit("recovery_unresolved_status:"), status))


# Types of sources by what they offer, and weights of the types.
SOURCE_TYPES = {"chamber_html": "pharmacists_chamber", "json_api": "pharmacists_chamber", "third_party_html": "health_directorate"}
WEIGHTS = {"pharmacists_chamber": 90, "health_directorate": 85, "official_integration": 85, "manual": 70}


def source_type(official: Column) -> tuple[Column, Column]:
    """The type of a source and its weight; others are manual."""
    kind = F.coalesce(*[F.when(official == k, F.lit(v)) for k, v in SOURCE_TYPES.items()], F.lit("manual"))
    return kind, F.coalesce(*[F.when(kind == k, F.lit(v)) for k, v in WEIGHTS.items()])
