"""Scores, distances and dates, as column expressions. Times are UTC; as_of stands for now."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lantern.functions.text import LEVEL_POINTS, MONTHS, lookup

EARTH_KM, DEGREE_KM = 6371.0, 111.12
WARNING_MINUTES, CRITICAL_MINUTES = 130, 370
ZONE = "Europe/Istanbul"


def clamp(x: Column, low, high) -> Column:
    return F.least(F.greatest(x, F.lit(low)), F.lit(high))


def half_up(x: Column) -> Column:
    """Rounds half towards plus infinity."""
    return F.floor(x + 0.5)


def confidence(similarity: Column, weight: Column, level: Column, sources: Column) -> Column:
    """0 to 100: up to 50 for the match, 20 for the source's weight (1 to 10), 15 for the district's level, 15 for more sources."""
    match = half_up(clamp(F.coalesce(similarity, F.lit(0.0)), 0.0, 1.0) * 50)
    authority = half_up(clamp(F.when(weight != 0, weight).otherwise(5).cast("double"), 1.0, 10.0) / 10 * 20)
    more = clamp(F.when(sources != 0, sources).otherwise(1), 1, 4) * 5 - 5
    return clamp(match + authority + lookup(level, LEVEL_POINTS, 0) + more, 0, 100).cast("int")


def base_confidence(weight: Column) -> Column:
    """Of a row that comes from one source as it is: a whole match, its district by name."""
    return confidence(F.lit(1.0), weight, F.lit("normalized"), F.lit(1))


def distance_km(lat: Column, lng: Column, lat0: float, lng0: float) -> Column:
    """Great circle by the law of cosines; the cosine is cut to 1, as rounding can exceed it."""
    r = F.radians
    cosine = F.cos(r(F.lit(lat0))) * F.cos(r(lat)) * F.cos(r(lng) - r(F.lit(lng0))) + F.sin(r(F.lit(lat0))) * F.sin(r(lat))
    return F.lit(EARTH_KM) * F.acos(F.least(F.lit(1.0), cosine))


def in_box(lat: Column, lng: Column, lat0: float, lng0: float, km: float = 50.0) -> Column:
    """A square around a point; nothing cuts its corners."""
    dlat = km / DEGREE_KM
    dlng = F.lit(dlat) / F.cos(F.radians(F.lit(lat0)))
    return lat.between(lat0 - dlat, lat0 + dlat) & lng.between(F.lit(lng0) - dlng, F.lit(lng0) + dlng)


def minutes_since(ts: Column, as_of: Column) -> Column:
    return (F.unix_micros(as_of.cast("timestamp")) - F.unix_micros(ts.cast("timestamp"))) / 6e7


def freshness(minutes: Column) -> Column:
    return F.when(minutes.isNull(), "never").when(minutes > CRITICAL_MINUTES, "critical").when(minutes > WARNING_MINUTES, "warning").otherwise("ok")


def fixed_day(ts: Column, hours: int = 3) -> Column:
    """The calendar day so many hours ahead of UTC, whatever the zone's rules were at that time."""
    return F.to_date(ts + F.make_interval(hours=F.lit(hours)))


def active_date(ts: Column) -> Column:
    """The calendar day in Istanbul."""
    return F.to_date(F.from_utc_timestamp(ts, ZONE))


def duty_window(day: Column) -> tuple[Column, Column]:
    start = F.to_utc_timestamp(day.cast("timestamp"), "+03:00")
    return start, start + F.expr("interval 24 hours")


def date_fault(day: Column, as_of: Column) -> Column:
    """ok, tarih_invalid, tarih_too_old (over 90 days back) or tarih_too_future (over 7 days ahead), for a text."""
    parsed = F.when(day.rlike(r"^\d{4}-\d{2}-\d{2}$"), F.try_to_date(day, "yyyy-MM-dd"))
    back = F.datediff(as_of, parsed)
    return F.when(parsed.isNull(), "tarih_invalid").when(back > 90, "tarih_too_old").when(back < -7, "tarih_too_future").otherwise("ok")


def long_date(day: Column) -> Column:
    return F.concat_ws(" ", F.dayofmonth(day).cast("string"), F.element_at(F.array(*map(F.lit, MONTHS)), F.month(day)), F.year(day).cast("string"))


def time_ago(minutes: Column) -> Column:
    m = F.floor(minutes)
    text = lambda x, unit: F.concat(x.cast("string"), F.lit(f" {unit} önce"))
    return F.when(m < 1, "Az önce").when(m < 60, text(m, "dk")).when(m < 1440, text(F.floor(m / 60), "saat")).otherwise(text(F.floor(m / 1440), "gün"))


def fuzzy_distance(a: Column, b: Column) -> Column:
    """How many edits two names may differ by, by the shorter one's length."""
    return distance_for(F.least(F.length(a), F.length(b)))


def distance_for(n: Column) -> Column:
    """How many edits a name of so many letters may differ by."""
    return F.when(n <= 6, 1).when(n <= 10, 2).when(n <= 16, 3).when(n <= 22, 4).otherwise(5)


def phone_signal(a: Column, b: Column) -> Column:
    """1 for equal digits, 0.8 for equal last seven, else 0."""
    both = (F.length(a) > 0) & (F.length(b) > 0)
    return F.when(both & (a == b), 1.0).when((F.length(a) >= 7) & (F.length(b) >= 7) & (F.right(a, F.lit(7)) == F.right(b, F.lit(7))), 0.8).otherwise(0.0)


def match_type(score: Column) -> Column:
    return F.when(score < 0.5, "no_match").when(score >= 0.95, "exact").when(score >= 0.75, "fuzzy").otherwise("normalized")


# The weights of the signals of a match.
NAME_WEIGHT, PHONE_WEIGHT, DISTRICT_WEIGHT = 0.6, 0.25, 0.15


def match_score(name: Column, district: Column, phone: Column) -> Column:
    """The weighted sum of three signals; a missing one counts 0, the weights stay as they are."""
    zero = F.lit(0.0)
    return F.coalesce(name, zero) * NAME_WEIGHT + F.coalesce(district, zero) * DISTRICT_WEIGHT + F.coalesce(phone, zero) * PHONE_WEIGHT


def coverage(found: Column, expected: Column) -> Column:
    """Severity of a source that covers less than expected; null from 0.8 on."""
    ratio = found / F.nullif(expected, F.lit(0))
    return F.when(ratio < 0.5, "high").when(ratio < 0.8, "medium")


def coordinate_fault(lat: Column, lng: Column) -> Column:
    ok = lat.isNotNull() & lng.isNotNull() & ~F.isnan(lat) & ~F.isnan(lng) & (F.abs(lat) <= 90) & (F.abs(lng) <= 180)
    return F.when(ok, "ok").otherwise("invalid_coordinates")


# Patterns of dates and how today is written in each.
DATE_PATTERNS = [(r"^\d{4}-\d{2}-\d{2}$", "yyyy-MM-dd"), (r"^\d{2}/\d{2}/\d{4}$", "dd/MM/yyyy"), (r"^\d{2}-\d{2}-\d{4}$", "dd-MM-yyyy"), (r"^\d{4}/\d{2}/\d{2}$", "yyyy/MM/dd")]


def coerced_date(given: Column, today: Column) -> Column:
    """Today in the pattern of the given date; with dots, also where it is in none of the patterns."""
    out = F.date_format(today, "dd.MM.yyyy")
    for pattern, written in reversed(DATE_PATTERNS):
        out = F.when(given.rlike(pattern), F.date_format(today, written)).otherwise(out)
    return out


def to_iso(value: Column, now: Column) -> Column:
    """A time in ISO form with milliseconds, of UTC; now if there is none."""
    ts = F.coalesce(F.try_to_timestamp(F.nullif(F.trim(value), F.lit(""))), now.cast("timestamp"))
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")
