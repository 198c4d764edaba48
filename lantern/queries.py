"""Queries of the directory operators on the supplied tables, each with SQL for comparison where SQL can express it.

The tables stand for those of a directory: nations for provinces, segments for districts, customers for places, orders
for duties, lines for evidence, suppliers for sources, parts for endpoints and events for runs.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lantern.functions import numbers, similarity, text
from lantern.operators import matching, ranges, reports, upsert
from lantern.sources import pages
from lantern.streaming import state

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}
FLAGSHIP = "jn2_active_duties"


def query(sql: str | None = None):
    """Registers a query, and the SQL that gives the same rows."""

    def add(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


AS_OF = "2024-01-31 00:00:00"
RAW_NAMES = [
    "AKSU ECZANESI", "Güneş Eczanesi", "KONAK ECZANE", "çelik ecz.", "AKSU (MERKEZ) ECZANESI", "1. KONAK ECZANE", "NÖBETÇİ AKSU ECZANESI",
    "DR. AHMET ECZANESI", "AV. MEHMET ECZANE", "ÇELIK NO: 3 ECZANESI", "ÇELIK/ÖZKAN ECZANE", "A.B.C ECZANE", "AKSU   MERKEZ  ECZANE", "  ", "Işık-Su Eczanesi",
]
RAW_DISTRICTS = ["Bornova Belediyesi", "Merkez İlçesi", "KONAK ILCESI", "Bakırköy Merkezi", "Karacabey Beldesi", "  BUCA   ", "Üsküdar", "Çiğli ilçesi", ""]


def quoted(values: list[str]) -> str:
    return "[" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + "]"


def picked(values: list[str], key: str) -> Column:
    return F.element_at(F.array(*map(F.lit, values)), (F.col(key) % len(values) + 1).cast("int"))


def sql_picked(values: list[str], key: str) -> str:
    return f"{quoted(values)}[{key} % {len(values)} + 1]"


SLUG = "regexp_replace(regexp_replace(lower(translate(trim({0}), 'çÇğĞıİöÖşŞüÜ', 'ccggiioossuu')), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g')"
FOLD = "translate({0}, 'çÇğĞıİöÖşŞüÜ', 'cCgGiIoOsSuU')"
SQUEEZE = "trim(regexp_replace({0}, '\\s+', ' ', 'g'))"


# scalar functions
@query(f"SELECT p_partkey, {SLUG.format(sql_picked(RAW_NAMES, 'p_partkey') + " || ' ' || p_name")} AS slug FROM part")
def sc1_slugify(spark, d):
    return table(spark, d, "part").select("p_partkey", text.slugify(F.concat(picked(RAW_NAMES, "p_partkey"), F.lit(" "), "p_name")).alias("slug"))


@query(r"SELECT p_partkey, regexp_replace(regexp_replace(lower(p_type || ' & ' || p_name), '\s+', '-', 'g'), '[^a-z0-9-]', '', 'g') AS slug FROM part")
def sc2_province_slug(spark, d):
    return table(spark, d, "part").select("p_partkey", text.province_slug(F.concat("p_type", F.lit(" & "), "p_name")).alias("slug"))


@query(f"SELECT p_partkey, regexp_replace(regexp_replace(translate(lower(translate({sql_picked(RAW_NAMES, 'p_partkey')}, 'Iİ', 'ıi')), 'çğıöşü', 'cgiosu'), '[^a-z0-9]+', '-', 'g'), '^-|-$', '', 'g') AS slug FROM part")
def sc3_turkish_slug(spark, d):
    return table(spark, d, "part").select("p_partkey", text.turkish_slug(picked(RAW_NAMES, "p_partkey")).alias("slug"))


@query("SELECT p_partkey, " + SQUEEZE.format("lower(p_brand || '   ' || p_name || ' ')") + " AS norm FROM part")
def sc4_normalize_text(spark, d):
    return table(spark, d, "part").select("p_partkey", text.normalize_text(F.concat("p_brand", F.lit("   "), "p_name", F.lit(" "))).alias("norm"))


_DISTRICT = "lower(" + FOLD.format("trim({0})") + ")"
for _ending in text.DISTRICT_ENDINGS:
    _DISTRICT = f"regexp_replace({_DISTRICT}, '\\s+{_ending}\\s*$', '')"


@query(f"SELECT c_custkey, {SQUEEZE.format(_DISTRICT.format(sql_picked(RAW_DISTRICTS, 'c_custkey')))} AS district FROM customer")
def sc5_district_name(spark, d):
    return table(spark, d, "customer").select("c_custkey", text.district_name(picked(RAW_DISTRICTS, "c_custkey")).alias("district"))


_NAME = "upper(" + FOLD.format("trim({0})") + ")"
_NAME = f"regexp_replace(regexp_replace({_NAME}, '[.,''/\\\\]+', ' ', 'g'), '\\([^)]{{{{0,40}}}}\\)', ' ', 'g')"
_NAME = f"regexp_replace(regexp_replace(regexp_replace({_NAME}, '\\s+({text.NAME_ENDINGS})\\s*$', ''), '^\\d+\\.\\s+', ''), '^NOBETCI\\s+', '')"
_TOKEN = "CASE t WHEN 'DR' THEN 'DOKTOR' WHEN 'AV' THEN 'AVUKAT' WHEN 'NO:' THEN '' WHEN 'NO' THEN '' ELSE t END"


@query(f"SELECT c_custkey, array_to_string(list_filter(list_transform(string_split_regex({_NAME.format(sql_picked(RAW_NAMES, 'c_custkey'))}, '\\s+'), lambda t: {_TOKEN}), lambda t: t <> ''), ' ') AS norm FROM customer")
def sc6_pharmacy_name(spark, d):
    return table(spark, d, "customer").select("c_custkey", text.pharmacy_name(picked(RAW_NAMES, "c_custkey")).alias("norm"))


_QUIRKS = ["12. KONAK ECZX", "ECZANE", "Çelik-Öz ECZ.", "DR. AHMET", "AKSU (" + "u" * 41 + ")", "AKSU (kısa) ECZANELERİ", "Nöbetçi A.B/C NO: 3"]


@query(f"SELECT c_custkey, array_to_string(list_filter(list_transform(string_split_regex({_NAME.format(f"({sql_picked(_QUIRKS, 'c_custkey')} || CASE WHEN c_custkey % 2 = 0 THEN '' ELSE ' ' || c_mktsegment END)")}, '\\s+'), lambda t: {_TOKEN}), lambda t: t <> ''), ' ') AS norm FROM customer")
def sc6q_name_quirks(spark, d):
    """Dots go first, so list numbers and dotted titles stay; the ending ECZ. takes any letter; a bare ECZANE stays."""
    name = F.concat(picked(_QUIRKS, "c_custkey"), F.when(F.col("c_custkey") % 2 == 0, "").otherwise(F.concat(F.lit(" "), "c_mktsegment")))
    return table(spark, d, "customer").select("c_custkey", text.pharmacy_name(name).alias("norm"))


@query("SELECT event_id, CASE WHEN event_id % 5 IN (1, 3) THEN json_extract_string(props, '$.k') END AS k, CAST(CASE WHEN event_id % 5 IN (1, 3) THEN len(json_keys(props)) ELSE 0 END AS INT) AS n FROM events")
def js5_safe_json(spark, d):
    """Whole objects, cut ones, lists and nulls."""
    k, props = F.col("event_id") % 5, F.col("props")
    raw = F.when(k == 0, F.expr("substring(props, 1, length(props) - 1)")).when(k == 2, F.concat(F.lit("["), props, F.lit("]"))).when(k != 4, props)
    fields = pages.safe_json(raw)
    return table(spark, d, "events").select("event_id", F.try_element_at(fields, F.lit("k")).alias("k"), F.size(fields).alias("n"))


@query()
def sc7_script_name(spark, d):
    return table(spark, d, "customer").select("c_custkey", text.script_name(picked(RAW_NAMES, "c_custkey")).alias("norm"))


@query("SELECT page_id, md5(trim(regexp_replace(regexp_replace(html, '<[^>]+>', ' ', 'g'), '[ \\t\\n\\r\\f\\v]+', ' ', 'g'))) AS digest FROM pages")
def sc8_strip_tags(spark, d):
    return table(spark, d, "pages").select("page_id", F.md5(text.strip_tags(F.col("html"))).alias("digest"))


@query("SELECT page_id, md5(regexp_replace(replace(replace(replace(replace(replace(replace(html, '&nbsp;', ' '), '&amp;', '&'), '&lt;', '<'), '&gt;', '>'), '&quot;', '\"'), '&#39;', ''''), '&[a-zA-Z]+;', ' ', 'g')) AS digest FROM pages")
def sc9_decode_entities(spark, d):
    return table(spark, d, "pages").select("page_id", F.md5(text.decode_entities(F.col("html"))).alias("digest"))


@query("SELECT c_custkey, trim(regexp_replace('Tel: +90 ' || c_name || ' (' || c_custkey || ')', '[^0-9+() -]', '', 'g')) AS phone, regexp_replace(c_name, '[^0-9]', '', 'g') AS digits FROM customer")
def sc10_phones(spark, d):
    raw = F.concat(F.lit("Tel: +90 "), "c_name", F.lit(" ("), F.col("c_custkey").cast("string"), F.lit(")"))
    return table(spark, d, "customer").select("c_custkey", text.clean_phone(raw).alias("phone"), text.digits(F.col("c_name")).alias("digits"))


@query(f"SELECT p_partkey, {FOLD.format(sql_picked(RAW_NAMES, 'p_partkey'))} AS folded FROM part")
def sc11_fold(spark, d):
    return table(spark, d, "part").select("p_partkey", text.fold_turkish(picked(RAW_NAMES, "p_partkey")).alias("folded"))


@query("SELECT page_id, md5(replace(replace(replace(replace(replace(url || html, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;'), '''', '&apos;')) AS digest FROM pages")
def sc12_escape_xml(spark, d):
    return table(spark, d, "pages").select("page_id", F.md5(text.escape_xml(F.concat("url", "html"))).alias("digest"))


_PAIRS = "FROM part a JOIN part b ON b.p_partkey = a.p_partkey + 1"


def neighbours(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "part").select("p_partkey", "p_name")
    return p.join(p.select((F.col("p_partkey") - 1).alias("p_partkey"), F.col("p_name").alias("other")), "p_partkey")


@query(f"SELECT a.p_partkey, CAST(levenshtein(a.p_name, b.p_name) AS INT) AS edits, round(1 - levenshtein(a.p_name, b.p_name) / greatest(length(a.p_name), length(b.p_name))::DOUBLE, 9) AS sim {_PAIRS}")
def sc13_levenshtein(spark, d):
    a, b = F.col("p_name"), F.col("other")
    return neighbours(spark, d).select("p_partkey", F.levenshtein(a, b).alias("edits"), F.round(similarity.levenshtein_similarity(a, b), 9).alias("sim"))


def winkler_sql(pairs: str) -> str:
    """SQL for the Jaro-Winkler similarity s of each row of pairs (id, a, b): letters of a take the first free equal one of b
    within reach, one after the other; transpositions count half."""
    step = """list_reduce(list_prepend({'free': string_split(b, ''), 'mine': [''], 'i': 0::BIGINT, 'c': ''}, list_transform(range(1, length(a) + 1), lambda i: {'free': [''], 'mine': [''], 'i': i, 'c': a[i]})),
      lambda t, e: CASE WHEN coalesce(list_position(t.free[greatest(1, e.i - reach):e.i + reach], e.c), 0) > 0
        THEN {'free': list_transform(t.free, lambda x, k: CASE WHEN k = greatest(1, e.i - reach) - 1 + list_position(t.free[greatest(1, e.i - reach):e.i + reach], e.c) THEN '' ELSE x END), 'mine': list_append(t.mine, e.c), 'i': t.i, 'c': ''}
        ELSE {'free': t.free, 'mine': t.mine, 'i': t.i, 'c': ''} END)"""
    return f"""SELECT id, CASE WHEN a = b THEN 1 WHEN m = 0 THEN 0 ELSE jaro + 0.1::DOUBLE * prefix * (1 - jaro) END AS s FROM (
      SELECT *, (m / length(a) + m / length(b) + (m - len(list_filter(list_zip(mine, theirs), lambda z: z[1] <> z[2])) / 2.0::DOUBLE) / m) / 3 AS jaro FROM (
        SELECT id, a, b, prefix, len(mine)::DOUBLE AS m, mine, list_transform(list_filter(list_zip(string_split(b, ''), state.free), lambda z: z[2] = ''), lambda z: z[1]) AS theirs FROM (
          SELECT *, state.mine[2:] AS mine, CASE WHEN length(a) = 0 OR length(b) = 0 OR a[1] <> b[1] THEN 0 WHEN a[:2] <> b[:2] OR least(length(a), length(b)) < 2 THEN 1 WHEN a[:3] <> b[:3] OR least(length(a), length(b)) < 3 THEN 2 WHEN a[:4] <> b[:4] OR least(length(a), length(b)) < 4 THEN 3 ELSE 4 END AS prefix
          FROM (SELECT *, {step} AS state FROM (SELECT id, a, b, greatest(length(a), length(b)) // 2 - 1 AS reach FROM ({pairs}))))))"""


def _token_pairs(pairs: str) -> str:
    """SQL for the pairs of texts that the token set similarity compares."""
    return f"""SELECT id, unnest([array_to_string(common, ' '), array_to_string(common, ' '), array_to_string(x, ' ')]) AS a, unnest([array_to_string(x, ' '), array_to_string(y, ' '), array_to_string(y, ' ')]) AS b
      FROM (SELECT id, x, y, list_sort(list_intersect(x, y)) AS common FROM (SELECT id, list_sort(list_distinct(list_filter(string_split(a, ' '), lambda t: t <> ''))) AS x, list_sort(list_distinct(list_filter(string_split(b, ' '), lambda t: t <> ''))) AS y FROM ({pairs})))"""


_NAMES = f"SELECT a.p_partkey AS id, a.p_name AS a, b.p_name AS b {_PAIRS}"


@query(f"SELECT id AS p_partkey, s AS sim FROM ({winkler_sql(_NAMES)})")
def sc14_jaro_winkler(spark, d):
    return neighbours(spark, d).select("p_partkey", similarity.jaro_winkler(F.col("p_name"), F.col("other")).alias("sim"))


@query(f"SELECT id AS p_partkey, max(s)::DOUBLE AS sim FROM ({winkler_sql(_token_pairs(_NAMES))}) GROUP BY id")
def sc15_token_set(spark, d):
    return neighbours(spark, d).select("p_partkey", similarity.token_set(F.col("p_name"), F.col("other")).alias("sim"))


@query(f"""SELECT id AS p_partkey, max(s)::DOUBLE AS sim FROM ({winkler_sql(f"{_token_pairs(_NAMES)} UNION ALL {_NAMES}")}
  UNION ALL SELECT id, 1 - levenshtein(a, b) / greatest(length(a), length(b))::DOUBLE FROM ({_NAMES})) GROUP BY id""")
def sc16_best_similarity(spark, d):
    return neighbours(spark, d).select("p_partkey", similarity.best_similarity(F.col("p_name"), F.col("other")).alias("sim"))


_SHORTER = "least(length(a.p_name), length(b.p_name))"


@query(f"SELECT a.p_partkey, CASE WHEN {_SHORTER} <= 6 THEN 1 WHEN {_SHORTER} <= 10 THEN 2 WHEN {_SHORTER} <= 16 THEN 3 WHEN {_SHORTER} <= 22 THEN 4 ELSE 5 END AS most {_PAIRS}")
def sc17_fuzzy_distance(spark, d):
    return neighbours(spark, d).select("p_partkey", numbers.fuzzy_distance(F.col("p_name"), F.col("other")).alias("most"))


@query("SELECT c_custkey, CAST(CASE WHEN c_custkey % 10 = c_custkey THEN 1.0 WHEN right(lpad(CAST(c_custkey AS VARCHAR), 9, '0'), 7) = right(lpad(CAST(c_custkey % 10 AS VARCHAR), 10, '9'), 7) THEN 0.8 ELSE 0 END AS DOUBLE) AS signal FROM customer")
def sc18_phone_signal(spark, d):
    key = F.col("c_custkey")
    a = F.lpad(key.cast("string"), 9, "0")
    b = F.when(key % 10 == key, a).otherwise(F.lpad((key % 10).cast("string"), 10, "9"))
    return table(spark, d, "customer").select("c_custkey", numbers.phone_signal(a, b).alias("signal"))


@query("SELECT p_partkey, array_to_string(list_transform(string_split(replace(p_name, '-', ' '), ' '), lambda w: upper(w[1]) || lower(w[2:])), ' ') AS title FROM part")
def sc19_title(spark, d):
    return table(spark, d, "part").select("p_partkey", text.title_from_slug(F.replace("p_name", F.lit(" "), F.lit("-"))).alias("title"))


@query(r"SELECT doc_id, CASE WHEN length(text) <= 60 THEN text ELSE regexp_replace(substring(text, 1, 59), '\s+\S*$', '') || '…' END AS short FROM documents")
def sc20_cap(spark, d):
    return table(spark, d, "documents").select("doc_id", text.cap(F.col("text"), 60).alias("short"))


@query("SELECT c_custkey, c_acctbal AS lat, CAST(c_nationkey AS DOUBLE) AS lng FROM customer")
def sc21_map_coordinates(spark, d):
    href = F.concat(F.lit("https://maps.example/?z=1&q="), F.col("c_acctbal").cast("string"), F.lit(","), F.col("c_nationkey").cast("string"))
    lat, lng = text.map_coordinates(href)
    return table(spark, d, "customer").select("c_custkey", lat.alias("lat"), lng.alias("lng"))


@query("SELECT p_partkey, 'districts' AS base, CAST(CASE WHEN p_size % 2 = 0 THEN p_size ELSE 1 END AS INT) AS page FROM part")
def sc22_feed_name(spark, d):
    raw = F.when(F.col("p_size") % 2 == 0, F.concat(F.lit("districts-"), F.col("p_size").cast("string"))).otherwise("districts")
    base, page = text.feed_name(raw)
    return table(spark, d, "part").select("p_partkey", base.alias("base"), page.alias("page"))


@query("SELECT event_id, lower(split_part('alert:' || upper(event_type) || ':x', ':', 2)) AS issue FROM events")
def sc23_issue_slug(spark, d):
    raw = F.concat(F.lit("alert:"), F.upper("event_type"), F.lit(":x"))
    return table(spark, d, "events").select("event_id", F.lower(F.split_part(raw, F.lit(":"), F.lit(2))).alias("issue"))


@query("SELECT event_id, '[' || upper(CASE event_type WHEN 'error' THEN 'critical' ELSE 'warning' END) || '] ' || replace('run_' || event_type, '_', ' ') || ': ' || substring(props, 1, 200) || ' (' || strftime(ts + INTERVAL 3 HOUR, '%d.%m.%Y %H:%M') || ')' AS line FROM events")
def sc24_alert_text(spark, d):
    level = text.severity(F.when(F.col("event_type") == "error", "high").otherwise("medium"))
    kind = F.replace(F.concat(F.lit("run_"), "event_type"), F.lit("_"), F.lit(" "))
    when = F.date_format(F.col("ts") + F.expr("interval 3 hours"), "dd.MM.yyyy HH:mm")
    return table(spark, d, "events").select("event_id", F.concat(F.lit("["), F.upper(level), F.lit("] "), kind, F.lit(": "), F.substring("props", 1, 200), F.lit(" ("), when, F.lit(")")).alias("line"))


_LEVELS = ["high", "medium", " Low ", "critical", "", "x", "HIGH\t"]


@query(f"SELECT event_id, CASE trim(lower({sql_picked(_LEVELS, 'event_id')}), chr(9) || ' ') WHEN 'high' THEN 'critical' WHEN 'critical' THEN 'critical' WHEN 'low' THEN 'info' ELSE 'warning' END AS severity FROM events")
def sc25_severity(spark, d):
    return table(spark, d, "events").select("event_id", text.severity(picked(_LEVELS, "event_id")).alias("severity"))


@query("SELECT event_id, CASE WHEN event_id % 3 = 0 THEN 'r' || user_id WHEN event_id % 3 = 1 THEN 'l' || user_id ELSE 's' END AS address FROM events")
def sc26_client_address(spark, d):
    k, user = F.col("event_id") % 3, F.col("user_id").cast("string")
    real = F.when(k == 0, F.concat(F.lit("r"), user)).otherwise("")
    forwarded = F.when(k == 1, F.concat(F.lit("first, l"), user))
    return table(spark, d, "events").select("event_id", text.client_address(real, forwarded, F.lit("s")).alias("address"))


@query()
def or13_turkish_title(spark, d):
    return table(spark, d, "customer").select("c_custkey", text.turkish_title(picked(RAW_NAMES, "c_custkey")).alias("title"))


_URLS = [
    "http://10.0.0.1/a", "ftp://a.example/b", "http://x.local", "https://ok.example/p?q=1", "http://localhost:80/", "http://172.20.1.1/", "no url", "http://10.example.com/", "http://localhost./",
    "https://user@metadata.google.internal/x", "http://[::1]/", "http://[FE80::1]:8080/", "http://8.8.8.8/", "http://172.32.0.1/", "HTTPS://A.INTERNAL./", "http:///", "http://169.254.170.2/", "http://2130706433/",
]
_HOST = r"regexp_replace(regexp_extract(lower(trim(url)), '^[a-z][a-z0-9+.-]*:[/\\]*([^/\\?#@]*@)?(\[[^\]]*\]|[^/\\:?#]*)', 2), '\.$', '')"
_DOTTED = "CASE WHEN regexp_full_match(h, '\\d{1,10}') THEN concat_ws('.', h::BIGINT >> 24, (h::BIGINT >> 16) & 255, (h::BIGINT >> 8) & 255, h::BIGINT & 255) ELSE h END"


@query(f"""SELECT c_custkey, CASE WHEN p = '' THEN 'invalid' WHEN p NOT IN ('http', 'https') THEN 'protocol' WHEN host = '' THEN 'invalid'
  WHEN host IN ('localhost', 'metadata.google.internal', '169.254.169.254', '169.254.170.2') THEN 'blocked_host' WHEN host LIKE '%.local' OR host LIKE '%.internal' OR host LIKE '%.localhost' THEN 'tld'
  WHEN regexp_matches(host, '^[0-9.]+$|^\\[[0-9a-f:]+\\]$') AND regexp_matches(trim(host, '[]'), '^(127\\.|10\\.|172\\.(1[6-9]|2[0-9]|3[01])\\.|192\\.168\\.|169\\.254\\.|::1$|fc00:|fe80:)') THEN 'private_ip' ELSE 'ok' END AS fault
  FROM (SELECT c_custkey, regexp_extract(lower(trim(url)), '^([a-z][a-z0-9+.-]*):', 1) AS p, {_DOTTED} AS host FROM (SELECT *, {_HOST} AS h FROM (SELECT c_custkey, {sql_picked(_URLS, 'c_custkey')} AS url FROM customer)))""")
def src10_url_check(spark, d):
    return table(spark, d, "customer").select("c_custkey", text.url_fault(picked(_URLS, "c_custkey")).alias("fault"))


_ERRORS = ["fetch failed", "ETIMEDOUT: timeout of 10s", "404 Not Found", "ECONNRESET", "bad json", "The operation was Aborted", "Socket closed", "NetworkError", "request timed out", "ENOTFOUND host"]
_ERROR_NAMES = ["Error", "AbortError", "TypeError"]


@query(f"""SELECT event_id, contains(lower({sql_picked(_ERROR_NAMES, 'event_id')}), 'abort') OR regexp_matches(lower({sql_picked(_ERRORS, 'event_id')}), 'aborted|timed out|timeout|fetch failed|socket|network') AS transient FROM events""")
def src3_transient(spark, d):
    return table(spark, d, "events").select("event_id", text.transient(picked(_ERRORS, "event_id"), picked(_ERROR_NAMES, "event_id")).alias("transient"))


# numbers and dates
_POINT = (1.0, 0.9)


def located(df: DataFrame) -> DataFrame:
    return df.withColumn("lat", (F.col("c_custkey") % 1000) / 100.0).withColumn("lng", (F.col("c_custkey") % 777) / 111.0)


_LOC = "(SELECT *, (c_custkey % 1000) / 100.0::DOUBLE AS lat, (c_custkey % 777) / 111.0::DOUBLE AS lng FROM customer)"
_DIST = "6371.0 * acos(least(1.0, cos(radians(1.0)) * cos(radians(lat)) * cos(radians(lng) - radians(0.9)) + sin(radians(1.0)) * sin(radians(lat))))"
_BOX = "lat BETWEEN 1.0 - 50 / 111.12 AND 1.0 + 50 / 111.12 AND lng BETWEEN 0.9 - 50 / 111.12 / cos(radians(1.0)) AND 0.9 + 50 / 111.12 / cos(radians(1.0))"


@query(f"SELECT c_custkey, round({_DIST}, 3) AS distance_km FROM {_LOC}")
def nu1_distance(spark, d):
    return located(table(spark, d, "customer")).select("c_custkey", F.round(numbers.distance_km(F.col("lat"), F.col("lng"), *_POINT), 3).alias("distance_km"))


@query(f"SELECT c_custkey FROM {_LOC} WHERE {_BOX}")
def nu2_bounding_box(spark, d):
    return located(table(spark, d, "customer")).where(numbers.in_box(F.col("lat"), F.col("lng"), *_POINT)).select("c_custkey")


@query(f"SELECT c_custkey, round({_DIST}, 3) AS distance_km FROM {_LOC} WHERE {_BOX} ORDER BY {_DIST}, c_custkey LIMIT 10")
def so1_nearest(spark, d):
    return reports.nearest(located(table(spark, d, "customer")), "c_custkey", *_POINT, n=10).select("c_custkey", "distance_km")


@query("""SELECT p_partkey, CAST(least(greatest(floor(least(greatest(p_retailprice / 2000, 0), 1) * 50 + 0.5) + floor(least(greatest(p_size, 1), 10) / 10.0 * 20 + 0.5)
  + [15, 12, 10, 6, 2, 0][p_partkey % 6 + 1] + least(greatest(p_partkey % 6, 1), 4) * 5 - 5, 0), 100) AS INT) AS score FROM part""")
def nu4_confidence(spark, d):
    level = picked(list(text.LEVEL_POINTS), "p_partkey")
    return table(spark, d, "part").select("p_partkey", numbers.confidence(F.col("p_retailprice") / 2000, F.col("p_size"), level, F.col("p_partkey") % 6).alias("score"))


@query("SELECT p_partkey, CAST(least(greatest(floor(50.5) + floor(least(greatest(p_size, 1), 10) / 10.0 * 20 + 0.5) + 12, 0), 100) AS INT) AS score FROM part")
def nu5_base_confidence(spark, d):
    return table(spark, d, "part").select("p_partkey", numbers.base_confidence(F.col("p_size")).alias("score"))


_SIGNALS = "SELECT p_partkey, coalesce(CASE WHEN p_partkey % 9 > 0 THEN p_partkey % 101 / 100.0::DOUBLE END, 0) * 0.6::DOUBLE + coalesce(CASE WHEN p_partkey % 4 > 0 THEN CAST(p_partkey % 2 AS DOUBLE) END, 0) * 0.15::DOUBLE + coalesce(CAST(([NULL, 0, 0.8, 1.0])[p_partkey % 4 + 1] AS DOUBLE), 0) * 0.25::DOUBLE AS s FROM part"
_KIND = "CASE WHEN s < 0.5 THEN 'no_match' WHEN s >= 0.95 THEN 'exact' WHEN s >= 0.75 THEN 'fuzzy' ELSE 'normalized' END"


def signalled(part: DataFrame) -> DataFrame:
    """Parts with the score of three signals of their keys, some of them missing."""
    key = F.col("p_partkey")
    name, district = F.when(key % 9 > 0, (key % 101) / 100.0), F.when(key % 4 > 0, (key % 2).cast("double"))
    phone = F.element_at(F.array(F.lit(None).cast("double"), F.lit(0.0), F.lit(0.8), F.lit(1.0)), (key % 4 + 1).cast("int"))
    return part.select("p_partkey", numbers.match_score(name, district, phone).alias("s"))


@query(f"SELECT p_partkey, {_KIND} AS kind, CASE WHEN s >= 0.5 THEN round(s, 3) ELSE s END AS confidence FROM ({_SIGNALS})")
def nu6_match_type(spark, d):
    s, kind = F.col("s"), numbers.match_type(F.col("s"))
    return signalled(table(spark, d, "part")).select("p_partkey", kind.alias("kind"), F.when(kind != "no_match", F.round(s, 3)).otherwise(s).alias("confidence"))


@query("SELECT p_partkey, CAST(least(greatest(trunc(p_retailprice / 100), 10), 15) AS INT) AS n FROM part")
def nu7_clamp(spark, d):
    return table(spark, d, "part").select("p_partkey", numbers.clamp((F.col("p_retailprice") / 100).cast("int"), 10, 15).alias("n"))


@query("SELECT c_nationkey, CASE WHEN count(*) / 100.0 < 0.5 THEN 'high' WHEN count(*) / 100.0 < 0.8 THEN 'medium' END AS severity FROM customer GROUP BY c_nationkey")
def nu8_coverage(spark, d):
    return table(spark, d, "customer").groupBy("c_nationkey").agg(F.count("*").alias("n")).select("c_nationkey", numbers.coverage(F.col("n"), F.lit(100)).alias("severity"))


@query(f"SELECT user_id, CAST(floor((epoch_us(TIMESTAMP '{AS_OF}') - epoch_us(max(ts))) / 6e7 + 0.5) AS BIGINT) AS minutes FROM events GROUP BY user_id")
def nu9_minutes_since(spark, d):
    m = numbers.minutes_since(F.max("ts"), F.lit(AS_OF).cast("timestamp"))
    return table(spark, d, "events").groupBy("user_id").agg(numbers.half_up(m).alias("minutes"))


@query("SELECT n_nationkey, CAST((row_number() OVER (ORDER BY n_name) - 1) % 4 AS INT) AS shard FROM nation")
def nu10_shards(spark, d):
    return ranges.placed(table(spark, d, "nation").select("n_nationkey", "n_name"), [], [F.col("n_name")]).select("n_nationkey", ((F.col("place") - 1) % 4).alias("shard"))


@query("SELECT event_id, CAST(ts + INTERVAL 3 HOUR AS DATE) AS day FROM events")
def dt1_active_date(spark, d):
    return table(spark, d, "events").select("event_id", numbers.active_date(F.col("ts")).alias("day"))


@query("SELECT o_orderkey, o_orderdate - INTERVAL 3 HOUR AS starts, o_orderdate + INTERVAL 21 HOUR AS ends FROM orders")
def dt2_duty_window(spark, d):
    start, end = numbers.duty_window(F.to_date("o_orderdate"))
    return table(spark, d, "orders").select("o_orderkey", start.alias("starts"), end.alias("ends"))


@query("SELECT o_orderkey, strftime(o_orderdate, '%d.%m.%Y') AS dotted, day(o_orderdate) || ' ' || " + quoted(text.MONTHS) + "[month(o_orderdate)] || ' ' || year(o_orderdate) AS long FROM orders")
def dt4_formats(spark, d):
    return table(spark, d, "orders").select("o_orderkey", F.date_format("o_orderdate", "dd.MM.yyyy").alias("dotted"), numbers.long_date(F.col("o_orderdate")).alias("long"))


@query("SELECT p_partkey, CASE WHEN m < 1 THEN 'Az önce' WHEN m < 60 THEN m || ' dk önce' WHEN m < 1440 THEN m // 60 || ' saat önce' ELSE m // 1440 || ' gün önce' END AS ago FROM (SELECT p_partkey, p_partkey * 7 % 5000 AS m FROM part)")
def dt5_time_ago(spark, d):
    return table(spark, d, "part").select("p_partkey", numbers.time_ago(F.col("p_partkey") * 7 % 5000).alias("ago"))


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 7 = 0 THEN 'tarih_invalid' WHEN date_diff('day', o_orderdate::DATE, DATE '1998-01-01') > 90 THEN 'tarih_too_old' WHEN date_diff('day', o_orderdate::DATE, DATE '1998-01-01') < -7 THEN 'tarih_too_future' ELSE 'ok' END AS fault FROM orders")
def flt12_date_range(spark, d):
    day = F.when(F.col("o_orderkey") % 7 == 0, F.lit("1998-13-45")).otherwise(F.date_format("o_orderdate", "yyyy-MM-dd"))
    return table(spark, d, "orders").select("o_orderkey", numbers.date_fault(day, F.lit("1998-01-01").cast("date")).alias("fault"))


@query("SELECT c_custkey, CASE WHEN abs(c_acctbal) <= 90 AND c_nationkey <= 180 THEN 'ok' ELSE 'invalid_coordinates' END AS fault FROM customer")
def flt13_coordinates(spark, d):
    return table(spark, d, "customer").select("c_custkey", numbers.coordinate_fault(F.col("c_acctbal"), F.col("c_nationkey").cast("double")).alias("fault"))


# filters
@query("SELECT p_partkey, regexp_matches(p_name, '^[a-z][a-z0-9-]{1,39}$') AS valid FROM part")
def flt11_slug_valid(spark, d):
    return table(spark, d, "part").select("p_partkey", F.col("p_name").rlike("^[a-z][a-z0-9-]{1,39}$").alias("valid"))


@query("SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING' AND c_acctbal > 0 AND c_nationkey = 3")
def flt1_equality(spark, d):
    return table(spark, d, "customer").where("c_mktsegment = 'BUILDING' and c_acctbal > 0 and c_nationkey = 3").select("c_custkey")


@query("SELECT s_suppkey FROM supplier WHERE s_nationkey IN (SELECT n_nationkey FROM nation WHERE n_regionkey = 1)")
def flt3_any(spark, d):
    return table(spark, d, "supplier").join(table(spark, d, "nation").where("n_regionkey = 1"), F.col("s_nationkey") == F.col("n_nationkey"), "left_semi").select("s_suppkey")


@query("SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT DISTINCT o_custkey FROM orders WHERE o_custkey IS NOT NULL AND o_totalprice > 200000)")
def flt5_not_in(spark, d):
    return table(spark, d, "customer").join(table(spark, d, "orders").where("o_totalprice > 200000"), F.col("c_custkey") == F.col("o_custkey"), "left_anti").select("c_custkey")


@query("SELECT p_partkey FROM part WHERE p_name ILIKE '%RING%'")
def flt7_ilike(spark, d):
    return table(spark, d, "part").where(F.col("p_name").ilike("%RING%")).select("p_partkey")


@query(f"SELECT event_id FROM events WHERE ts > TIMESTAMP '{AS_OF}' - INTERVAL 24 HOUR")
def flt8_recent(spark, d):
    return table(spark, d, "events").where(F.col("ts") > F.lit(AS_OF).cast("timestamp") - F.expr("interval 24 hours")).select("event_id")


@query("SELECT p_partkey FROM (SELECT p_partkey FROM part WHERE contains(p_name, 'red') OR contains(lower(p_type), 'red') ORDER BY p_partkey LIMIT 10)")
def flt16_search(spark, d):
    hit = F.col("p_name").contains("red") | F.lower("p_type").contains("red")
    return table(spark, d, "part").where(hit).orderBy("p_partkey").limit(10).select("p_partkey")


# joins
@query("SELECT s_suppkey, n_name, r_name FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey")
def jn1_three_way(spark, d):
    s, n, r = (table(spark, d, t) for t in ("supplier", "nation", "region"))
    return s.join(n, s["s_nationkey"] == n["n_nationkey"]).join(r, n["n_regionkey"] == r["r_regionkey"]).select("s_suppkey", "n_name", "r_name")


@query("""SELECT o_orderkey, c_name, n_name, r_name, string_agg(DISTINCT s_name, ', ' ORDER BY s_name) AS sources, min(l_shipdate) AS first_seen, count(DISTINCT l_suppkey) AS n_sources
  FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
  JOIN lineitem ON l_orderkey = o_orderkey JOIN supplier ON l_suppkey = s_suppkey WHERE o_orderdate = DATE '1998-01-05' GROUP BY ALL""")
def jn2_active_duties(spark, d):
    return reports.active_duties(*(table(spark, d, t) for t in ("orders", "customer", "nation", "region", "lineitem", "supplier")), day="1998-01-05")


@query("""SELECT o_orderkey, l_suppkey, l_shipdate FROM orders LEFT JOIN LATERAL (SELECT l_suppkey, l_shipdate FROM lineitem WHERE l_orderkey = o_orderkey
  ORDER BY l_shipdate DESC, l_suppkey, l_linenumber LIMIT 1) ON true""")
def jn4_latest_evidence(spark, d):
    top = upsert.latest(table(spark, d, "lineitem"), ["l_orderkey"], [F.desc("l_shipdate"), F.asc("l_suppkey"), F.asc("l_linenumber")])
    o = table(spark, d, "orders").select("o_orderkey")
    return o.join(top, o["o_orderkey"] == top["l_orderkey"], "left").select("o_orderkey", "l_suppkey", "l_shipdate")


@query(f"SELECT n_nationkey, count(event_id) AS n FROM nation LEFT JOIN events ON user_id % 25 = n_nationkey AND event_type = 'error' AND ts > TIMESTAMP '{AS_OF}' - INTERVAL 24 HOUR GROUP BY n_nationkey")
def jn5_filtered_left(spark, d):
    e = table(spark, d, "events").where(F.col("event_type") == "error").where(F.col("ts") > F.lit(AS_OF).cast("timestamp") - F.expr("interval 24 hours"))
    return table(spark, d, "nation").join(e, F.col("user_id") % 25 == F.col("n_nationkey"), "left").groupBy("n_nationkey").agg(F.count("event_id").alias("n"))


@query("SELECT n_nationkey FROM nation LEFT JOIN supplier ON s_nationkey = n_nationkey AND s_acctbal < 2000 GROUP BY n_nationkey HAVING count(s_suppkey) = 0")
def jn7_without_rows(spark, d):
    return table(spark, d, "nation").join(table(spark, d, "supplier").where("s_acctbal < 2000"), F.col("s_nationkey") == F.col("n_nationkey"), "left_anti").select("n_nationkey")


@query("""SELECT n_nationkey, (SELECT count(*) FROM events WHERE user_id % 25 = n_nationkey AND event_type = 'error') AS open,
  (SELECT round(avg(v), 6) FROM (SELECT value AS v, row_number() OVER (PARTITION BY user_id % 25 ORDER BY ts DESC, event_id) AS k, user_id % 25 AS n FROM events) WHERE n = n_nationkey AND k <= 50) AS mean FROM nation""")
def jn9_scalar_subqueries(spark, d):
    e = table(spark, d, "events").withColumn("n_nationkey", F.col("user_id") % 25)
    opened = e.groupBy("n_nationkey").agg(F.count_if(F.col("event_type") == "error").alias("open"))
    last = upsert.latest(e, ["n_nationkey"], [F.desc("ts"), F.asc("event_id")], 50).groupBy("n_nationkey").agg(F.round(F.avg("value"), 6).alias("mean"))
    n = table(spark, d, "nation").select("n_nationkey")
    return n.join(opened, "n_nationkey", "left").join(last, "n_nationkey", "left").select("n_nationkey", F.coalesce("open", F.lit(0)).alias("open"), "mean")


def _catalog(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    p = table(spark, d, "part").select(F.col("p_partkey").alias("key"), F.col("p_name").alias("url"), F.col("p_type").alias("format"))
    return p.where("key % 10 <> 1"), p.where("key % 10 <> 2").withColumn("url", F.when(F.col("key") % 10 == 3, F.upper("url")).otherwise(F.col("url")))


@query("SELECT p_partkey AS key, CASE p_partkey % 10 WHEN 1 THEN 'unknown' WHEN 2 THEN 'insert' WHEN 3 THEN 'update' ELSE 'none' END AS action, CASE p_partkey % 10 WHEN 3 THEN 'url' ELSE '' END AS drift FROM part")
def jn12_catalog_drift(spark, d):
    return upsert.sync_actions(*_catalog(spark, d), "key", ["url", "format"])


def _lists(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Two lists of names for each nation; every seventh of ours is misspelt and every eleventh missing."""
    c = table(spark, d, "customer").select(F.col("c_nationkey").alias("block"), F.col("c_custkey").alias("ord"), F.concat(F.replace("c_name", F.lit("#"), F.lit(" ")), F.lit(" Eczanesi")).alias("name"))
    ours = c.where("ord % 11 <> 0").withColumn("name", F.when(F.col("ord") % 7 == 0, F.replace("name", F.lit("tom"), F.lit("tm"))).otherwise(F.col("name")))
    return ours, c.where("ord % 13 <> 0")


@query("""WITH n AS (SELECT c_custkey AS k, c_nationkey AS block, c_mktsegment AS seg, c_name, upper(c_name) AS cand, upper(replace(c_name, 'tom', 'tm')) AS mine, replace(c_name, 'tom', 'tm') || ' Ecz' AS name FROM customer),
  p AS (SELECT r.k AS row_id, r.name, c.c_name, c.k AS ord, 0.6::DOUBLE * greatest(1 - levenshtein(r.mine, c.cand) / greatest(length(r.mine), length(c.cand))::DOUBLE, jaro_winkler_similarity(r.mine, c.cand)) + 0.15::DOUBLE * CASE WHEN r.seg = c.seg THEN 1 ELSE jaro_winkler_similarity(lower(r.seg), lower(c.seg)) END AS score FROM n r JOIN n c ON c.block = r.block),
  b AS (SELECT row_id, any_value(name) AS name, max({'s': score, 'o': -ord}).s AS s, arg_max(c_name, {'s': score, 'o': -ord}) AS match FROM p GROUP BY row_id)
  SELECT row_id, name, CASE WHEN s >= 0.5 THEN match END AS match, CASE WHEN s < 0.5 THEN 'no_match' WHEN s >= 0.95 THEN 'exact' WHEN s >= 0.75 THEN 'fuzzy' ELSE 'normalized' END AS match_type, CASE WHEN s >= 0.5 THEN round(s, 3) ELSE s END AS confidence FROM b""")
def jn13_best_match(spark, d):
    c = table(spark, d, "customer")
    near = c.select(F.col("c_nationkey").alias("block"), F.col("c_custkey").alias("row_id"), F.concat(F.replace("c_name", F.lit("tom"), F.lit("tm")), F.lit(" Ecz")).alias("name"), F.col("c_mktsegment").alias("district"), F.lit("").alias("phone"))
    names = c.select(F.col("c_nationkey").alias("block"), F.col("c_custkey").alias("ord"), F.col("c_name").alias("canonical_name"), F.col("c_mktsegment").alias("district_name"), F.lit("").alias("phone"))
    return matching.best_match(near, names, ["block"])


# pairs in their order, one after the other, with what is used so far
_DIFFERENCE = """WITH RECURSIVE c AS (SELECT c_nationkey AS block, c_custkey AS k, replace(c_name, '#', ' ') || ' Eczanesi' AS name FROM customer),
  ours AS (SELECT block, name AS ours, upper(replace(name, ' Eczanesi', '')) AS norm FROM (SELECT block, CASE WHEN k % 7 = 0 THEN replace(name, 'tom', 'tm') ELSE name END AS name FROM c WHERE k % 11 <> 0)),
  official AS (SELECT block, name AS official, upper(replace(name, ' Eczanesi', '')) AS norm FROM c WHERE k % 13 <> 0),
  both_ AS (SELECT coalesce(o.block, u.block) AS block, coalesce(o.norm, u.norm) AS norm, official, ours FROM official o FULL JOIN ours u ON u.block = o.block AND u.norm = o.norm),
  near AS (SELECT *, row_number() OVER (PARTITION BY block ORDER BY distance, a, b) AS n FROM (SELECT m.block, m.norm AS a, x.norm AS b, levenshtein(m.norm, x.norm) AS distance, least(length(m.norm), length(x.norm)) AS size FROM both_ m JOIN both_ x ON x.block = m.block WHERE m.ours IS NULL AND x.official IS NULL)
    WHERE distance <= CASE WHEN size <= 6 THEN 1 WHEN size <= 10 THEN 2 WHEN size <= 16 THEN 3 WHEN size <= 22 THEN 4 ELSE 5 END),
  g AS (SELECT DISTINCT block, 0::BIGINT AS n, ['']::VARCHAR[] AS used_a, ['']::VARCHAR[] AS used_b, ''::VARCHAR AS a, ''::VARCHAR AS b, false AS taken FROM near
    UNION ALL SELECT g.block, near.n, CASE WHEN ok THEN list_append(used_a, near.a) ELSE used_a END, CASE WHEN ok THEN list_append(used_b, near.b) ELSE used_b END, near.a, near.b, ok
      FROM g JOIN near ON near.block = g.block AND near.n = g.n + 1, LATERAL (SELECT NOT list_contains(g.used_a, near.a) AND NOT list_contains(g.used_b, near.b) AS ok)),
  pairs AS (SELECT g.block, g.a, g.b, near.distance FROM g JOIN near ON near.block = g.block AND near.n = g.n WHERE taken),
  diff AS (SELECT block, 'matched' AS kind, official, ours, 0 AS distance FROM both_ WHERE official IS NOT NULL AND ours IS NOT NULL
    UNION ALL SELECT p.block, 'mismatch', m.official, x.ours, p.distance FROM pairs p JOIN both_ m ON m.block = p.block AND m.norm = p.a JOIN both_ x ON x.block = p.block AND x.norm = p.b
    UNION ALL SELECT b.block, CASE WHEN ours IS NULL THEN 'missing' ELSE 'extra' END, official, ours, NULL FROM both_ b WHERE (ours IS NULL AND NOT EXISTS (SELECT 1 FROM pairs p WHERE p.block = b.block AND p.a = b.norm)) OR (official IS NULL AND NOT EXISTS (SELECT 1 FROM pairs p WHERE p.block = b.block AND p.b = b.norm)))"""


@query(f"{_DIFFERENCE} SELECT block, kind, official, ours, CAST(distance AS INT) AS distance FROM diff")
def jn14_name_difference(spark, d):
    ours, official = _lists(spark, d)
    return matching.name_difference(ours, official, "block")


@query(f"""{_DIFFERENCE} SELECT block, n_matched, n_mismatch, n_missing, n_extra, CASE WHEN n_missing + n_extra > 0 THEN 'high' WHEN n_mismatch > 0 THEN 'medium' ELSE 'low' END AS severity
  FROM (SELECT block, count_if(kind = 'matched') AS n_matched, count_if(kind = 'mismatch') AS n_mismatch, count_if(kind = 'missing') AS n_missing, count_if(kind = 'extra') AS n_extra FROM diff GROUP BY block)""")
def or1_difference_severity(spark, d):
    ours, official = _lists(spark, d)
    return matching.difference_severity(matching.name_difference(ours, official, "block"), "block")


def _districts(spark: SparkSession, d: str) -> DataFrame:
    s = table(spark, d, "customer").select(F.col("c_nationkey").alias("block"), F.col("c_mktsegment").alias("name")).distinct()
    order = F.row_number().over(Window.partitionBy("block").orderBy("name"))
    return s.withColumn("ord", order).withColumn("id", F.col("block") * 100 + order).withColumn("slug", text.slugify(F.col("name")))


@query(f"""WITH d AS (SELECT *, block * 100 + ord AS id, {SLUG.format('name')} AS slug, lower(name) AS d_name FROM (SELECT c_nationkey AS block, c_mktsegment AS name, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_mktsegment) AS ord FROM (SELECT DISTINCT c_nationkey, c_mktsegment FROM customer))),
  r AS (SELECT c_custkey AS row_id, c_nationkey AS block, [c_mktsegment, c_mktsegment || ' Belediyesi', 'X' || c_mktsegment, 'İl Merkezi', ''][c_custkey % 5 + 1] AS raw FROM customer),
  m AS (SELECT r.*, {SLUG.format('raw')} AS r_slug, regexp_replace(regexp_replace(lower(translate(trim(raw), 'İ', 'I')), '\\s+merkezi\\s*$', ''), '\\s+belediyesi\\s*$', '') AS r_name FROM r),
  f AS (SELECT row_id, min(d.id) FILTER (raw <> '' AND d.slug = r_slug) AS exact, min(d.id) FILTER (raw <> '' AND d_name = r_name) AS normalized,
    arg_max(d.id, {{'s': jaro_winkler_similarity(r_name, d_name), 'o': -ord}}) FILTER (length(r_name) >= 4 AND jaro_winkler_similarity(r_name, d_name) >= 0.85) AS fuzzy, arg_min(d.id, ord) AS other FROM m JOIN d USING (block) GROUP BY row_id)
  SELECT row_id, coalesce(exact, normalized, fuzzy, other) AS district_id, CASE WHEN exact IS NOT NULL THEN 'exact' WHEN normalized IS NOT NULL THEN 'normalized' WHEN fuzzy IS NOT NULL THEN 'fuzzy' ELSE 'fallback' END AS level FROM f""")
def jn17_resolve_districts(spark, d):
    raw = F.element_at(F.array(F.col("c_mktsegment"), F.concat("c_mktsegment", F.lit(" Belediyesi")), F.concat(F.lit("X"), "c_mktsegment"), F.lit("İl Merkezi"), F.lit("")), (F.col("c_custkey") % 5 + 1).cast("int"))
    rows = table(spark, d, "customer").select(F.col("c_custkey").alias("row_id"), F.col("c_nationkey").alias("block"), raw.alias("raw"))
    return matching.resolve_districts(rows, _districts(spark, d), "block")


@query("SELECT event_id, last_value(CASE WHEN event_type = 'signup' THEN event_id END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS header FROM events")
def jn19_as_of_header(spark, d):
    signups = F.when(F.col("event_type") == "signup", F.col("event_id"))
    return ranges.carried(table(spark, d, "events").select("user_id", "ts", "event_id", "event_type"), ["user_id"], [F.col("ts"), F.col("event_id")], signups, "header").select("event_id", "header")


@query("SELECT a.n_nationkey, b.n_nationkey AS near FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey AND a.n_nationkey <> b.n_nationkey QUALIFY row_number() OVER (PARTITION BY a.n_nationkey ORDER BY b.n_name) <= 3")
def jn20_neighbours(spark, d):
    n = table(spark, d, "nation")
    other = n.select("n_regionkey", F.col("n_nationkey").alias("near"), F.col("n_name").alias("near_name"))
    return upsert.latest(n.join(other, "n_regionkey").where("near <> n_nationkey"), ["n_nationkey"], [F.asc("near_name")], 3).select("n_nationkey", "near")


# aggregates
@query("SELECT o_custkey, string_agg(DISTINCT o_orderpriority, ', ' ORDER BY o_orderpriority) AS priorities, min(o_orderdate) AS first_day FROM orders GROUP BY o_custkey")
def ag1_string_agg(spark, d):
    return table(spark, d, "orders").groupBy("o_custkey").agg(F.array_join(F.array_sort(F.collect_set("o_orderpriority")), ", ").alias("priorities"), F.min("o_orderdate").alias("first_day"))


@query("SELECT user_id, max(ts) FILTER (WHERE event_type <> 'error') AS last_success FROM events GROUP BY user_id")
def ag2_filtered_max(spark, d):
    return table(spark, d, "events").groupBy("user_id").agg(F.max(F.when(F.col("event_type") != "error", F.col("ts"))).alias("last_success"))


@query(f"SELECT user_id FROM events GROUP BY user_id HAVING max(ts) FILTER (WHERE event_type = 'purchase') IS NULL OR max(ts) FILTER (WHERE event_type = 'purchase') < TIMESTAMP '{AS_OF}' - INTERVAL 7 DAY")
def ag3_having(spark, d):
    last = F.max(F.when(F.col("event_type") == "purchase", F.col("ts")))
    old = F.col("last").isNull() | (F.col("last") < F.lit(AS_OF).cast("timestamp") - F.expr("interval 7 days"))
    return table(spark, d, "events").groupBy("user_id").agg(last.alias("last")).where(old).select("user_id")


@query("SELECT user_id, CAST(sum(CASE WHEN event_type = 'error' THEN 1 ELSE 0 END) AS BIGINT) AS failed, CAST(sum(CASE WHEN event_type = 'click' THEN 1 ELSE 0 END) AS BIGINT) AS partial, count(*) AS n, max(ts) AS last FROM events GROUP BY user_id")
def ag4_conditional_counts(spark, d):
    n = lambda t: F.count_if(F.col("event_type") == t)
    return table(spark, d, "events").groupBy("user_id").agg(n("error").alias("failed"), n("click").alias("partial"), F.count("*").alias("n"), F.max("ts").alias("last"))


@query("SELECT count(DISTINCT l_suppkey) AS suppliers, count(DISTINCT l_partkey) AS parts, count(*) AS n FROM lineitem")
def ag7_count_distinct(spark, d):
    return table(spark, d, "lineitem").agg(F.countDistinct("l_suppkey").alias("suppliers"), F.countDistinct("l_partkey").alias("parts"), F.count("*").alias("n"))


@query("SELECT o_orderstatus, count(*) AS n FROM orders GROUP BY o_orderstatus")
def ag8_count_per_group(spark, d):
    return table(spark, d, "orders").groupBy("o_orderstatus").agg(F.count("*").alias("n"))


@query("SELECT user_id, round(avg(CAST(json_extract_string(props, '$.k') AS INT)), 1) AS mean FROM events GROUP BY user_id")
def ag9_json_average(spark, d):
    k = F.get_json_object("props", "$.k").cast("int")
    return table(spark, d, "events").groupBy("user_id").agg(F.round(F.avg(k), 1).alias("mean"))


@query("SELECT DISTINCT c_nationkey, c_mktsegment FROM customer")
def ag10_distinct(spark, d):
    return table(spark, d, "customer").select("c_nationkey", "c_mktsegment").distinct()


@query("SELECT user_id, max(ts) AS last, bool_or(event_type = 'error') AS degraded, CASE WHEN count(*) = 0 THEN 'no_data' ELSE 'ok' END AS status FROM events GROUP BY user_id")
def ag11_result_status(spark, d):
    return table(spark, d, "events").groupBy("user_id").agg(F.max("ts").alias("last"), F.bool_or(F.col("event_type") == "error").alias("degraded"), F.when(F.count("*") == 0, "no_data").otherwise("ok").alias("status"))


@query(f"""SELECT count(*) AS total, CAST(count_if(k = 'exact') AS BIGINT) AS exact, CAST(count_if(k IN ('fuzzy', 'normalized')) AS BIGINT) AS fuzzy, CAST(count_if(k = 'no_match') AS BIGINT) AS no_match, round(avg(s), 2) AS mean
  FROM (SELECT s, {_KIND} AS k FROM ({_SIGNALS}))""")
def ag12_match_summary(spark, d):
    return reports.match_summary(signalled(table(spark, d, "part")).select(F.col("s").alias("confidence"), numbers.match_type(F.col("s")).alias("match_type")))


@query("""SELECT c_nationkey, COUNT(*) FILTER (c_mktsegment = 'AUTOMOBILE') AS AUTOMOBILE, COUNT(*) FILTER (c_mktsegment = 'BUILDING') AS BUILDING,
  COUNT(*) FILTER (c_mktsegment = 'HOUSEHOLD') AS HOUSEHOLD, COUNT(*) FILTER (c_mktsegment = 'FURNITURE') AS FURNITURE, COUNT(*) FILTER (c_mktsegment = 'MACHINERY') AS MACHINERY FROM customer GROUP BY c_nationkey""")
def ag13_level_histogram(spark, d):
    kinds = ["AUTOMOBILE", "BUILDING", "HOUSEHOLD", "FURNITURE", "MACHINERY"]
    return table(spark, d, "customer").groupBy("c_nationkey").pivot("c_mktsegment", kinds).count().na.fill(0, kinds)


@query("""SELECT CASE WHEN m IS NULL THEN 'never' WHEN m > 370 THEN 'critical' WHEN m > 130 THEN 'warning' ELSE 'ok' END AS bucket, count(*) AS n
  FROM (SELECT (epoch_us(TIMESTAMP '2024-01-31 00:00:00') - epoch_us(max(ts) FILTER (WHERE event_type = 'purchase'))) / 6e7 AS m FROM events GROUP BY user_id) GROUP BY ALL""")
def ag16_freshness(spark, d):
    last = F.max(F.when(F.col("event_type") == "purchase", F.col("ts")))
    per = table(spark, d, "events").groupBy("user_id").agg(last.alias("last"))
    return per.groupBy(numbers.freshness(numbers.minutes_since(F.col("last"), F.lit(AS_OF).cast("timestamp"))).alias("bucket")).agg(F.count("*").alias("n"))


@query("SELECT p_type || '::' || p_name AS endpoint, count(*) AS n, min(p_partkey) AS first FROM part GROUP BY ALL HAVING count(*) > 1")
def ag17_shared_endpoints(spark, d):
    return table(spark, d, "part").groupBy(F.concat_ws("::", "p_type", "p_name").alias("endpoint")).agg(F.count("*").alias("n"), F.min("p_partkey").alias("first")).where("n > 1")


@query(f"SELECT c_nationkey, round(avg(lat), 9) AS lat, round(avg(lng), 9) AS lng, min(lat) AS south, max(lat) AS north FROM {_LOC} GROUP BY c_nationkey")
def ag18_centroids(spark, d):
    return located(table(spark, d, "customer")).groupBy("c_nationkey").agg(F.round(F.avg("lat"), 9).alias("lat"), F.round(F.avg("lng"), 9).alias("lng"), F.min("lat").alias("south"), F.max("lat").alias("north"))


@query("SELECT p_name, min_by(p_brand, p_partkey) AS brand FROM part GROUP BY p_name")
def ag19_first_wins(spark, d):
    return table(spark, d, "part").groupBy("p_name").agg(F.min_by("p_brand", "p_partkey").alias("brand"))


@query("SELECT c_nationkey, count(*) AS n, substring(md5(string_agg(c_name, '|' ORDER BY c_name)), 1, 8) AS fingerprint FROM customer GROUP BY c_nationkey")
def ag23_fingerprint_whole(spark, d):
    """Of the whole list of a nation, read as a stream."""
    return reports.fingerprints(table(spark, d, "customer").select(F.col("c_nationkey").cast("string").alias("key"), F.col("c_name").alias("name"))).select(F.col("key").cast("int").alias("c_nationkey"), "n", "fingerprint")


@query("SELECT c_nationkey, c_custkey // 1000 AS page, substring(md5(string_agg(c_name, '|' ORDER BY c_name)), 1, 8) AS fingerprint FROM customer GROUP BY ALL")
def ag23_fingerprint(spark, d):
    """Of lists of up to a thousand names; whole nations have ag23_fingerprint_sums."""
    return table(spark, d, "customer").groupBy("c_nationkey", F.floor(F.col("c_custkey") / 1000).alias("page")).agg(F.substring(F.md5(F.array_join(F.array_sort(F.collect_list("c_name")), "|")), 1, 8).alias("fingerprint"))


@query("SELECT c_nationkey, count(c_name) AS n, CAST(sum(('0x' || substring(md5(c_name), 1, 8))::BIGINT) AS BIGINT) AS low, CAST(sum(('0x' || substring(md5(c_name), 9, 8))::BIGINT) AS BIGINT) AS high FROM customer GROUP BY c_nationkey")
def ag23_fingerprint_sums(spark, d):
    """A fingerprint that needs no order, and no row with all names of a nation."""
    part = lambda at: F.sum(F.conv(F.substring(F.md5("c_name"), at, 8), 16, 10).cast("long"))
    return table(spark, d, "customer").groupBy("c_nationkey").agg(F.count("c_name").alias("n"), part(1).alias("low"), part(9).alias("high"))


# windows, order and sets
@query("SELECT p_brand, p_partkey FROM part QUALIFY row_number() OVER (PARTITION BY p_brand ORDER BY CASE WHEN p_type = 'ECONOMY' THEN 0 ELSE 1 END, CASE WHEN p_size > 10 THEN 0 ELSE 1 END, p_retailprice DESC, p_partkey) = 1")
def wn4_priority_pick(spark, d):
    order = [F.when(F.col("p_type") == "ECONOMY", 0).otherwise(1), F.when(F.col("p_size") > 10, 0).otherwise(1), F.desc("p_retailprice"), F.col("p_partkey")]
    return upsert.latest(table(spark, d, "part"), ["p_brand"], order).select("p_brand", "p_partkey")


@query("SELECT event_id, lead(event_id) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS following, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS place FROM events")
def wn7_next_heading(spark, d):
    by, order = ["user_id"], [F.col("ts"), F.col("event_id")]
    e = ranges.following(table(spark, d, "events").select("user_id", "ts", "event_id"), by, order, F.col("event_id"), "following")
    return ranges.placed(e, by, order).select("event_id", "following", F.col("place").cast("long").alias("place"))


@query("SELECT event_id FROM events ORDER BY CASE event_type WHEN 'error' THEN 0 WHEN 'click' THEN 1 ELSE 2 END, ts DESC, event_id LIMIT 200")
def so4_top_alerts(spark, d):
    bucket = F.when(F.col("event_type") == "error", 0).when(F.col("event_type") == "click", 1).otherwise(2)
    return table(spark, d, "events").orderBy(bucket, F.desc("ts"), "event_id").limit(200).select("event_id")


@query("SELECT c_custkey FROM customer ORDER BY c_name, c_custkey LIMIT 100 OFFSET 200")
def so5_page(spark, d):
    return table(spark, d, "customer").orderBy("c_name", "c_custkey").offset(200).limit(100).select("c_custkey")


@query("SELECT c_nationkey, c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F')")
def set1_except(spark, d):
    """By nation."""
    return table(spark, d, "customer").select("c_nationkey", "c_custkey").join(table(spark, d, "orders").where("o_orderstatus = 'F'"), F.col("c_custkey") == F.col("o_custkey"), "left_anti").distinct()


@query("SELECT count(*) AS n FROM (SELECT c_custkey FROM customer INTERSECT SELECT o_custkey FROM orders)")
def set2_intersect(spark, d):
    return table(spark, d, "customer").select("c_custkey").intersect(table(spark, d, "orders").select("o_custkey")).agg(F.count("*").alias("n"))


@query("SELECT c_custkey FROM customer EXCEPT SELECT o_custkey FROM orders WHERE o_orderstatus = 'F'")
def set1_except_whole(spark, d):
    return table(spark, d, "customer").select("c_custkey").subtract(table(spark, d, "orders").where("o_orderstatus = 'F'").select("o_custkey"))


@query("SELECT c_nationkey, count(*) AS n FROM (SELECT DISTINCT c_nationkey, c_custkey FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders)) GROUP BY c_nationkey")
def set2_intersect_whole(spark, d):
    """By nation."""
    c = table(spark, d, "customer").select("c_nationkey", "c_custkey").distinct()
    return c.join(table(spark, d, "orders"), F.col("c_custkey") == F.col("o_custkey"), "left_semi").groupBy("c_nationkey").agg(F.count("*").alias("n"))


@query("SELECT user_id FROM events WHERE event_type = 'error' UNION SELECT user_id FROM events WHERE event_type = 'signup'")
def set5_union(spark, d):
    e = table(spark, d, "events")
    return e.where("event_type = 'error'").select("user_id").unionByName(e.where("event_type = 'signup'").select("user_id")).distinct()


@query("SELECT p_partkey, 'missing_config' AS kind FROM part WHERE p_partkey % 10 = 1 UNION ALL SELECT p_partkey, 'unknown_config_code' FROM part WHERE p_partkey % 10 = 2")
def set9_coverage(spark, d):
    config, known = _catalog(spark, d)
    a = known.join(config, "key", "left_anti").select(F.col("key").alias("p_partkey"), F.lit("missing_config").alias("kind"))
    return a.unionByName(config.join(known, "key", "left_anti").select(F.col("key").alias("p_partkey"), F.lit("unknown_config_code").alias("kind")))


# changes of tables
@query("""SELECT b.c_nationkey AS district_id, b.c_name AS normalized_name, CASE WHEN b.c_custkey % 2 = 0 THEN 'New ' || b.c_name ELSE b.c_name END AS canonical_name,
  CASE WHEN b.c_custkey % 2 = 0 AND b.c_custkey % 4 <> 0 THEN 'new' WHEN b.c_custkey % 3 <> 0 THEN 'old' ELSE NULL END AS address, CASE WHEN b.c_custkey % 3 <> 0 THEN 'p' END AS phone,
  CASE WHEN b.c_custkey % 2 = 0 THEN 2.0 WHEN b.c_custkey % 3 <> 0 THEN 1.0 END::DOUBLE AS lat, CAST(NULL AS DOUBLE) AS lng, b.c_custkey % 2 = 0 AS is_active FROM customer b WHERE b.c_custkey % 2 = 0 OR b.c_custkey % 3 <> 0""")
def snk1_upsert_places(spark, d):
    c = table(spark, d, "customer").select(F.col("c_custkey").alias("ord"), F.col("c_nationkey").alias("district_id"), F.col("c_name").alias("normalized_name"))
    none = F.lit(None).cast("double")
    old = c.where("ord % 3 <> 0").select("district_id", "normalized_name", F.col("normalized_name").alias("canonical_name"), F.lit("old").alias("address"), F.lit("p").alias("phone"), F.lit(1.0).alias("lat"), none.alias("lng"), F.lit(False).alias("is_active"))
    new = c.where("ord % 2 = 0").withColumns({"canonical_name": F.concat(F.lit("New "), "normalized_name"), "address": F.when(F.col("ord") % 4 == 0, "").otherwise("new"), "phone": F.lit(""), "lat": F.lit(2.0), "lng": none})
    return upsert.upsert_places(old, new)


@query("""SELECT o_custkey AS place_id, CAST(o_orderdate AS DATE) AS duty_date, CAST(max(o_orderkey % 100) AS BIGINT) AS confidence, count(*) AS sources, coalesce(max_by(o_orderkey % 7, o_orderkey) FILTER (o_orderkey % 2 = 0), max_by(o_orderkey % 7, o_orderkey)) AS district_id,
  bool_and(o_orderkey % 2 = 1) AS is_degraded FROM orders GROUP BY ALL""")
def snk2_upsert_duties(spark, d):
    o = table(spark, d, "orders").select(F.col("o_custkey").alias("place_id"), F.to_date("o_orderdate").alias("duty_date"), F.col("o_orderkey").alias("ord"), (F.col("o_orderkey") % 100).alias("confidence"), (F.col("o_orderkey") % 7).alias("district_id"))
    old = o.where("ord % 2 = 1").groupBy("place_id", "duty_date").agg(F.max("confidence").alias("confidence"), F.count("*").alias("sources"), F.max_by("district_id", "ord").alias("district_id"), F.lit(True).alias("is_degraded"))
    return upsert.upsert_duties(old, o.where("ord % 2 = 0"))


@query("SELECT l_orderkey, l_suppkey, max(l_shipdate) AS seen_at, min_by(l_returnflag, struct_pack(a := l_shipdate, b := l_returnflag)) AS payload FROM lineitem GROUP BY ALL")
def snk3_upsert_evidence(spark, d):
    log = table(spark, d, "lineitem").select("l_orderkey", "l_suppkey", F.col("l_shipdate").alias("seen_at"), F.col("l_returnflag").alias("payload"))
    return upsert.upsert_evidence(log, ["l_orderkey", "l_suppkey"])


@query("SELECT c_nationkey, c_custkey FROM customer WHERE c_nationkey % 3 = 0 OR c_custkey % 5 <> 0 OR c_nationkey NOT IN (SELECT c_nationkey FROM customer WHERE c_custkey % 5 <> 0)")
def snk4_delete_stale(spark, d):
    c = table(spark, d, "customer").select("c_nationkey", "c_custkey")
    return upsert.delete_stale(c, c.where("c_custkey % 5 <> 0").withColumn("complete", F.col("c_nationkey") % 3 != 0), ["c_nationkey"], "c_custkey")


@query("""WITH e AS (SELECT user_id, ts, event_type <> 'error' AS ok FROM events), l AS (SELECT user_id, max(ts) FILTER (ok) AS last_success_at, max(ts) AS last_attempt_at FROM e GROUP BY user_id)
  SELECT l.user_id, last_success_at, last_attempt_at, count(e.ts) AS consecutive_failures, count(e.ts) = 0 OR (last_success_at IS NOT NULL AND count(e.ts) < 3) AS is_healthy
  FROM l LEFT JOIN e ON e.user_id = l.user_id AND (last_success_at IS NULL OR e.ts > last_success_at) GROUP BY l.user_id, last_success_at, last_attempt_at""")
def str1_health(spark, d):
    return upsert.failures_in_a_row(table(spark, d, "events"), "user_id", "ts", F.col("event_type") != "error")


@query("SELECT p_partkey AS id, p_size AS source_id, p_partkey = (SELECT min(p_partkey) FROM part q WHERE q.p_size = part.p_size) AND p_partkey % 2 = 0 AS is_primary, p_partkey % 2 = 0 AND p_partkey <> (SELECT min(p_partkey) FROM part q WHERE q.p_size = part.p_size) AS changed FROM part")
def snk9_demote_others(spark, d):
    p = table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.col("p_size").alias("source_id"), (F.col("p_partkey") % 2 == 0).alias("is_primary"))
    return upsert.demote_others(p, p.groupBy("source_id").agg(F.min("id").alias("keep_id")))


@query("SELECT '<url><loc>https://x.example/' || lower(n_name) || '</loc><lastmod>' || strftime(coalesce(max(o_orderdate), DATE '2024-01-31'), '%Y-%m-%d') || '</lastmod></url>' AS xml, n_nationkey FROM nation LEFT JOIN customer ON c_nationkey = n_nationkey LEFT JOIN orders ON o_custkey = c_custkey GROUP BY n_name, n_nationkey")
def or22_sitemap(spark, d):
    n, c, o = (table(spark, d, t) for t in ("nation", "customer", "orders"))
    last = c.join(o, c["c_custkey"] == o["o_custkey"]).groupBy(F.col("c_nationkey").alias("n_nationkey")).agg(F.max("o_orderdate").alias("last"))
    return reports.sitemap_urls(n.join(last, "n_nationkey", "left"), F.concat(F.lit("https://x.example/"), F.lower("n_name")), F.col("last"), "2024-01-31").select("xml", "n_nationkey")


@query("SELECT user_id, coalesce(m > 130, true) AS is_stale, coalesce(m > 370, false) AS is_critical FROM (SELECT user_id, (epoch_us(TIMESTAMP '2024-01-31 00:00:00') - epoch_us(max(ts) FILTER (WHERE event_type = 'purchase'))) / 6e7 AS m FROM events GROUP BY user_id)")
def or15_flags(spark, d):
    last = F.max(F.when(F.col("event_type") == "purchase", F.col("ts")))
    m = numbers.minutes_since(F.col("last"), F.lit(AS_OF).cast("timestamp"))
    return table(spark, d, "events").groupBy("user_id").agg(last.alias("last")).select("user_id", F.coalesce(m > 130, F.lit(True)).alias("is_stale"), F.coalesce(m > 370, F.lit(False)).alias("is_critical"))


@query("SELECT c_custkey, day, CASE WHEN day = DATE '1998-01-05' THEN 'today' WHEN day IS NULL THEN 'no_data' ELSE 'latest' END AS status FROM (SELECT c_custkey, coalesce(max(o_orderdate) FILTER (WHERE o_orderdate = DATE '1998-01-05'), max(o_orderdate))::DATE AS day FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY c_custkey)")
def str9_latest_day(spark, d):
    c, o = table(spark, d, "customer"), table(spark, d, "orders")
    return reports.day_or_latest(c.select("c_custkey"), o.select(F.col("o_custkey").alias("c_custkey"), F.to_date("o_orderdate").alias("day")), "c_custkey", "1998-01-05")


@query("SELECT event_id, json_extract_string(props, '$.k')::INT AS k FROM events")
def js1_json_field(spark, d):
    return table(spark, d, "events").select("event_id", F.get_json_object("props", "$.k").cast("int").alias("k"))


@query("SELECT page_id, CAST(len(regexp_extract_all(html, '<p[ >]')) AS INT) AS paragraphs, CAST(len(regexp_extract_all(html, '<a ')) AS INT) AS links FROM pages")
def or32_page_statistics(spark, d):
    return table(spark, d, "pages").select("page_id", F.regexp_count("html", F.lit("<p[ >]")).alias("paragraphs"), F.regexp_count("html", F.lit("<a ")).alias("links"))


_WINDOWS = """SELECT doc_id, CAST(place AS INT) AS place, CAST(spot AS INT) AS at, {0} AS context FROM (SELECT doc_id, text, place, 3 * (place - 1) + 1 + length(array_to_string(parts[1:place], '')) AS spot
  FROM (SELECT doc_id, text, parts, unnest(range(1, least(len(parts), 11))) AS place FROM (SELECT doc_id, text, string_split({1}, 'the') AS parts FROM documents)))"""


def windows(df: DataFrame, searched: Column) -> DataFrame:
    """Adds place and at of the first ten occurrences of a keyword in each text."""
    parts = df.withColumn("parts", F.split(searched, "the", 11))
    ends = F.transform(F.slice("parts", 1, F.size("parts") - 1), F.length)
    starts = F.transform(ends, lambda x, k: F.aggregate(F.slice(ends, 1, k + 1), F.lit(0), lambda a, b: a + b) + 3 * k + 1)
    return parts.select("doc_id", "text", F.posexplode(starts).alias("place", "at")).withColumn("place", F.col("place") + 1)


@query(_WINDOWS.format("trim(regexp_replace(substring(text, greatest(spot - 30, 1), spot + 50 - greatest(spot - 30, 1)), '\\s+', ' ', 'g'))", "lower(text)"))
def or33_keyword_context(spark, d):
    """In any case of letters; from 30 characters before to 50 after the keyword's begin, white space squeezed."""
    low = F.greatest(F.col("at") - 30, F.lit(1))
    return windows(table(spark, d, "documents"), F.lower("text")).select("doc_id", "place", "at", text.squeezed(F.col("text").substr(low, F.col("at") + 50 - low)).alias("context"))


@query(_WINDOWS.format("substring(text, greatest(spot - 20, 1), 43)", "text"))
def or33_keyword_contexts(spark, d):
    """Windows around the first ten occurrences."""
    return windows(table(spark, d, "documents"), F.col("text")).select("doc_id", "place", "at", F.col("text").substr(F.greatest(F.col("at") - 20, F.lit(1)), F.lit(43)).alias("context"))


@query("SELECT c_custkey, c_name AS name, c_mktsegment AS district, '' AS address, '0232' AS phone FROM customer")
def prs14_json_rows(spark, d):
    c = table(spark, d, "customer")
    item = F.to_json(F.struct(F.array(F.struct(F.col("c_name").alias("eczane"), F.col("c_mktsegment").alias("ilce"), F.lit("tel 0232").alias("telefon"))).alias("data")))
    rows = pages.json_rows(item)
    return c.select("c_custkey", F.explode(rows).alias("r")).select("c_custkey", "r.name", "r.district", "r.address", "r.phone")


@query("""WITH RECURSIVE e AS (SELECT user_id, ts, row_number() OVER (PARTITION BY user_id ORDER BY ts) AS n FROM events),
  r AS (SELECT user_id, ts, n, ts AS start, 1 AS used FROM e WHERE n = 1
    UNION ALL SELECT e.user_id, e.ts, e.n, CASE WHEN e.ts - r.start >= INTERVAL 3600 SECOND THEN e.ts ELSE r.start END, CASE WHEN e.ts - r.start >= INTERVAL 3600 SECOND THEN 1 ELSE r.used + 1 END FROM r JOIN e ON e.user_id = r.user_id AND e.n = r.n + 1)
  SELECT user_id AS key, ts, used <= 2 AS allowed FROM r""")
def str2_rate_limit(spark, d):
    return state.rate_limit(table(spark, d, "events").select(F.col("user_id").alias("key"), "ts"), limit=2, seconds=3600.0)


# further filters, projections and joins
_ISSUES = ["telefon_yanlis", "adres_yanlis", "nobette_degil", "kapali", "diger", "baska", " kapali ", ""]


@query(f"SELECT c_custkey, length(trim(il)) >= 2 AND length(trim(c_name)) >= 2 AND trim({sql_picked(_ISSUES, 'c_custkey')}) IN ('telefon_yanlis', 'adres_yanlis', 'nobette_degil', 'kapali', 'diger') AS valid, length(substring(trim(repeat(c_name || ' ', c_custkey % 80)), 1, 1000)) AS note FROM (SELECT *, [' İ ', 'Bo', c_mktsegment][c_custkey % 3 + 1] AS il FROM customer)")
def flt14_report_valid(spark, d):
    c = table(spark, d, "customer")
    il = F.element_at(F.array(F.lit(" İ "), F.lit("Bo"), F.col("c_mktsegment")), (F.col("c_custkey") % 3 + 1).cast("int"))
    note = reports.report_note(F.expr("repeat(c_name || ' ', cast(c_custkey % 80 as int))"))
    return c.select("c_custkey", reports.report_valid(il, F.col("c_name"), picked(_ISSUES, "c_custkey")).alias("valid"), F.length(note).cast("long").alias("note"))


@query("SELECT event_id FROM events e WHERE user_id NOT IN (SELECT o_custkey FROM orders WHERE o_totalprice > 400000)")
def flt4_not_all(spark, d):
    rich = table(spark, d, "orders").where("o_totalprice > 400000").select(F.col("o_custkey").alias("user_id"))
    return table(spark, d, "events").join(rich, "user_id", "left_anti").select("event_id")


@query("SELECT n_nationkey, EXISTS (SELECT 1 FROM supplier WHERE s_nationkey = n_nationkey AND s_acctbal < 0) AS any_debt FROM nation")
def flt10_exists(spark, d):
    debt = table(spark, d, "supplier").where("s_acctbal < 0").select(F.col("s_nationkey").alias("n_nationkey")).distinct().withColumn("hit", F.lit(True))
    return table(spark, d, "nation").join(debt, "n_nationkey", "left").select("n_nationkey", F.coalesce("hit", F.lit(False)).alias("any_debt"))


@query("SELECT c_custkey, coalesce(nullif(CASE WHEN c_custkey % 4 = 0 THEN '' ELSE c_mktsegment END, ''), 'Merkez') AS district, strftime(TIMESTAMP '2024-01-30 21:30:00' + INTERVAL 3 HOUR, '%Y-%m-%d') AS day FROM customer")
def prj3_defaults(spark, d):
    raw = F.when(F.col("c_custkey") % 4 == 0, "").otherwise(F.col("c_mktsegment"))
    day = F.date_format(numbers.active_date(F.lit("2024-01-30 21:30:00").cast("timestamp")), "yyyy-MM-dd")
    return table(spark, d, "customer").select("c_custkey", F.coalesce(F.nullif(raw, F.lit("")), F.lit("Merkez")).alias("district"), day.alias("day"))


@query(f"SELECT c_custkey, {SLUG.format('n_name')} || '-' || {SLUG.format('c_mktsegment')} || '-' || (row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) - 1) AS id FROM customer JOIN nation ON c_nationkey = n_nationkey")
def prj6_row_ids(spark, d):
    c = ranges.placed(table(spark, d, "customer").select("c_custkey", "c_nationkey", "c_mktsegment"), ["c_nationkey"], [F.col("c_custkey")])
    c = c.join(table(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    return c.select("c_custkey", F.concat_ws("-", text.slugify(F.col("n_name")), text.slugify(F.col("c_mktsegment")), (F.col("place") - 1).cast("string")).alias("id"))


@query("SELECT o_orderkey, c_name, n_name, r_name FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey WHERE o_orderdate >= TIMESTAMP '1998-01-01'")
def jn3_snowflake(spark, d):
    o, c, n, r = (table(spark, d, t) for t in ("orders", "customer", "nation", "region"))
    near = o.where("o_orderdate >= timestamp'1998-01-01'").join(c, o["o_custkey"] == c["c_custkey"]).join(n, c["c_nationkey"] == n["n_nationkey"])
    return near.join(r, n["n_regionkey"] == r["r_regionkey"]).select("o_orderkey", "c_name", "n_name", "r_name")


@query("SELECT c_custkey, n AS orders FROM customer LEFT JOIN (SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey) ON o_custkey = c_custkey")
def jn6_keyed_state(spark, d):
    state_ = table(spark, d, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("*").alias("orders"))
    return table(spark, d, "customer").select("c_custkey").join(state_, "c_custkey", "left")


@query("SELECT count(*) AS orders, count(l_orderkey) AS with_lines FROM orders LEFT JOIN (SELECT DISTINCT l_orderkey FROM lineitem WHERE l_quantity > 45) ON l_orderkey = o_orderkey")
def jn8_evidence_coverage(spark, d):
    proof = table(spark, d, "lineitem").where("l_quantity > 45").select(F.col("l_orderkey").alias("o_orderkey")).distinct().withColumn("hit", F.lit(1))
    return table(spark, d, "orders").join(proof, "o_orderkey", "left").agg(F.count("*").alias("orders"), F.count("hit").alias("with_lines"))


@query("SELECT (SELECT count(*) FROM orders) AS orders, (SELECT max(ts) FROM events) AS last_event, (SELECT count(*) FROM supplier WHERE s_acctbal < 0) AS debts")
def jn10_single_values(spark, d):
    each = [table(spark, d, "orders").agg(F.count("*").alias("orders")), table(spark, d, "events").agg(F.max("ts").alias("last_event")), table(spark, d, "supplier").where("s_acctbal < 0").agg(F.count("*").alias("debts"))]
    return each[0].join(each[1], F.lit(True)).join(each[2], F.lit(True))  # a row each


@query("SELECT l.s_suppkey, arg_min(n.n_name, levenshtein(upper(l.name), n.n_name) * 1000 + n.n_nationkey) AS closest FROM (SELECT s_suppkey, substring(n_name, 2) AS name, n_regionkey FROM supplier JOIN nation ON s_nationkey = n_nationkey) l JOIN nation n ON n.n_regionkey = l.n_regionkey WHERE levenshtein(upper(l.name), n.n_name) <= 2 GROUP BY l.s_suppkey")
def jn16_closest_name(spark, d):
    n = table(spark, d, "nation")
    s = table(spark, d, "supplier").join(n, F.col("s_nationkey") == F.col("n_nationkey")).select("s_suppkey", F.upper(F.expr("substring(n_name, 2)")).alias("name"), "n_regionkey")
    far = F.levenshtein("name", "n_name", 2)
    near = s.join(n, "n_regionkey").withColumn("far", far).where("far >= 0")
    return near.groupBy("s_suppkey").agg(F.min_by("n_name", F.struct("far", "n_nationkey")).alias("closest"))


# further aggregates, windows, orders and sets
@query("SELECT user_id, max(ts) AS last, count(*) FILTER (WHERE event_type = 'error') AS errors FROM events GROUP BY user_id")
def ag5_last_and_count(spark, d):
    return table(spark, d, "events").groupBy("user_id").agg(F.max("ts").alias("last"), F.count_if(F.col("event_type") == "error").alias("errors"))


@query("SELECT user_id, count(*) AS found, count(*) FILTER (WHERE event_type <> 'error') AS upserted, count(DISTINCT event_type) AS covered, array_to_string(list(event_id ORDER BY ts, event_id) FILTER (WHERE event_type = 'error')[1:3], ',') AS first_errors FROM events GROUP BY user_id")
def ag14_run_summary(spark, d):
    e = table(spark, d, "events").withColumn("bad", F.col("event_type") == "error")
    nth = F.row_number().over(Window.partitionBy("user_id", "bad").orderBy("ts", "event_id"))
    first = F.collect_list(F.when(F.col("bad") & (F.col("nth") <= 3), F.struct("nth", "event_id")))  # at most three a user
    out = e.withColumn("nth", nth).groupBy("user_id").agg(F.count("*").alias("found"), F.count_if(~F.col("bad")).alias("upserted"), F.countDistinct("event_type").alias("covered"), first.alias("first"))
    joined = F.array_join(F.transform(F.array_sort("first"), lambda x: x["event_id"].cast("string")), ",")
    return out.select("user_id", "found", "upserted", "covered", F.nullif(joined, F.lit("")).alias("first_errors"))


@query("SELECT o_orderpriority, count(*) FILTER (WHERE o_orderstatus = 'F') AS f, count(*) FILTER (WHERE o_orderstatus = 'O') AS o, count(*) FILTER (WHERE o_orderstatus = 'P') AS p FROM orders GROUP BY o_orderpriority")
def ag15_status_counts(spark, d):
    return table(spark, d, "orders").groupBy("o_orderpriority").agg(*[F.count_if(F.col("o_orderstatus") == s).alias(s.lower()) for s in "FOP"])


@query("SELECT c_nationkey, arg_max(c_custkey, orders * 10000000 - c_custkey) AS c_custkey FROM (SELECT c_custkey, c_nationkey, count(o_orderkey) AS orders FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY ALL) GROUP BY c_nationkey")
def ag20_most_rows(spark, d):
    c, o = table(spark, d, "customer"), table(spark, d, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("*").alias("n"))
    best = F.max_by("c_custkey", F.struct(F.coalesce("n", F.lit(0)), -F.col("c_custkey")))
    return c.join(o, "c_custkey", "left").groupBy("c_nationkey").agg(best.alias("c_custkey"))


@query("SELECT coalesce(sum(CASE WHEN event_type = 'purchase' THEN 1 END), 0)::BIGINT AS upserted, count(*) AS found FROM events")
def ag22_totals(spark, d):
    return table(spark, d, "events").agg(F.coalesce(F.sum(F.when(F.col("event_type") == "purchase", 1)), F.lit(0)).alias("upserted"), F.count("*").alias("found"))


@query("SELECT o_custkey, o_orderkey, o_orderdate::DATE AS day FROM orders QUALIFY o_orderdate::DATE = max(o_orderdate::DATE) OVER (PARTITION BY o_custkey)")
def wn5_latest_day(spark, d):
    o = table(spark, d, "orders").select("o_custkey", "o_orderkey", F.to_date("o_orderdate").alias("day"))
    last = o.groupBy("o_custkey").agg(F.max("day").alias("day"))
    return o.join(last, ["o_custkey", "day"]).select("o_custkey", "o_orderkey", "day")


@query("SELECT l_orderkey, l_linenumber, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS position FROM lineitem")
def wn8_position(spark, d):
    at = F.row_number().over(Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey"))
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", at.alias("position"))


@query("SELECT c_custkey FROM customer ORDER BY CASE WHEN c_mktsegment = 'BUILDING' THEN 0 ELSE 1 END, CASE WHEN c_acctbal > 0 THEN 0 ELSE 1 END, c_acctbal DESC, c_custkey LIMIT 1")
def so2_priority_pick(spark, d):
    return table(spark, d, "customer").orderBy(F.when(F.col("c_mktsegment") == "BUILDING", 0).otherwise(1), F.when(F.col("c_acctbal") > 0, 0).otherwise(1), F.desc("c_acctbal"), "c_custkey").select("c_custkey").limit(1)


@query("SELECT s_suppkey, s_name, CASE WHEN s_acctbal < 0 THEN 'critical' WHEN s_acctbal < 1000 THEN 'warning' ELSE 'ok' END AS bucket FROM supplier ORDER BY CASE WHEN s_acctbal < 0 THEN 0 WHEN s_acctbal < 1000 THEN 1 ELSE 2 END, s_name")
def so3_severity_order(spark, d):
    bucket = F.when(F.col("s_acctbal") < 0, "critical").when(F.col("s_acctbal") < 1000, "warning").otherwise("ok")
    rank = F.when(F.col("bucket") == "critical", 0).when(F.col("bucket") == "warning", 1).otherwise(2)
    return table(spark, d, "supplier").select("s_suppkey", "s_name", bucket.alias("bucket")).orderBy(rank, "s_name")


@query("SELECT user_id, last FROM (SELECT user_id, max(ts) FILTER (WHERE event_type = 'signup') AS last FROM events GROUP BY user_id) ORDER BY last DESC NULLS LAST, user_id LIMIT 20")
def so7_nulls_last(spark, d):
    return table(spark, d, "events").groupBy("user_id").agg(F.max(F.when(F.col("event_type") == "signup", F.col("ts"))).alias("last")).orderBy(F.desc_nulls_last("last"), "user_id").limit(20)


@query("SELECT a.doc_id, md5(array_to_string(list_sort(list_intersect(list_distinct(string_split(a.text, ' ')), list_distinct(string_split(b.text, ' ')))), ' ')) AS common FROM documents a JOIN documents b ON b.doc_id = a.doc_id + 1 WHERE a.text IS NOT NULL AND b.text IS NOT NULL")
def set6_token_sets(spark, d):
    """Tokens that a document and the next one have in common, of their whole texts."""
    t = table(spark, d, "documents").where("text is not null").select("doc_id", F.split("text", " ").alias("a"))
    both = t.join(t.select((F.col("doc_id") - 1).alias("doc_id"), F.col("a").alias("b")), "doc_id")
    return both.select("doc_id", F.md5(F.array_join(F.array_sort(F.array_intersect("a", "b")), " ")).alias("common"))


@query("SELECT p_partkey, array_to_string(list_intersect(list_distinct(a), list_distinct(b)).list_sort(), ' ') AS common FROM (SELECT p_partkey, string_split(upper(p_name), ' ') AS a, string_split(upper(p_type), ' ') AS b FROM part WHERE p_name IS NOT NULL AND p_type IS NOT NULL)")
def set6_token_sets_whole(spark, d):
    """Of two whole columns."""
    a, b = (F.split(F.upper(c), " ") for c in ("p_name", "p_type"))
    return table(spark, d, "part").where("p_name is not null and p_type is not null").select("p_partkey", F.array_join(F.array_sort(F.array_intersect(a, b)), " ").alias("common"))


@query("SELECT n_nationkey, n_name FROM nation WHERE n_nationkey NOT IN (SELECT s_nationkey FROM supplier WHERE s_acctbal < 0)")
def set8_eligible(spark, d):
    missing = table(spark, d, "supplier").where("s_acctbal < 0").select(F.col("s_nationkey").alias("n_nationkey"))
    return table(spark, d, "nation").join(missing, "n_nationkey", "left_anti").select("n_nationkey", "n_name")


# JSON, dates and classification
@query("SELECT event_id, json_extract_string(json_merge_patch(props, json_object('resolved_by', 'admin')), '$.resolved_by') AS resolved_by, json_extract_string(props, '$.k') AS k FROM events WHERE event_type = 'error'")
def snk11_resolve_alerts(spark, d):
    old = F.coalesce(F.from_json("props", "map<string,string>"), F.create_map().cast("map<string,string>"))
    merged = F.to_json(F.map_concat(F.map_filter(old, lambda k, v: k != "resolved_by"), F.create_map(F.lit("resolved_by"), F.lit("admin"))))
    return table(spark, d, "events").where("event_type = 'error'").select("event_id", F.get_json_object(merged, "$.resolved_by").alias("resolved_by"), F.get_json_object(merged, "$.k").alias("k"))


@query("SELECT page_id, CAST(len(list_distinct(regexp_extract_all(html, 'href=\"([^\"]*)\"', 1))) AS INT) AS links FROM pages")
def js6_distinct_links(spark, d):
    return table(spark, d, "pages").select("page_id", F.size(F.array_distinct(F.regexp_extract_all("html", F.lit('href="([^"]*)"'), F.lit(1)))).alias("links"))


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN strftime(DATE '2024-01-31', '%Y-%m-%d') WHEN o_orderkey % 3 = 1 THEN strftime(DATE '2024-01-31', '%d/%m/%Y') ELSE '31.01.2024' END AS coerced FROM orders")
def dt6_coerce_dates(spark, d):
    given, today = F.to_date("o_orderdate"), F.lit("2024-01-31").cast("date")
    raw = F.when(F.col("o_orderkey") % 3 == 0, F.date_format(given, "yyyy-MM-dd")).when(F.col("o_orderkey") % 3 == 1, F.date_format(given, "dd/MM/yyyy")).otherwise("today")
    return table(spark, d, "orders").select("o_orderkey", numbers.coerced_date(raw, today).alias("coerced"))


@query("SELECT o_orderkey, CASE WHEN o_orderdate >= TIMESTAMP '1998-08-02' - INTERVAL 90 DAY THEN 0.7::DOUBLE ELSE 0.5::DOUBLE END AS priority FROM orders")
def dt7_feed_priority(spark, d):
    new = F.col("o_orderdate") >= F.expr("timestamp'1998-08-02' - interval 90 days")
    return table(spark, d, "orders").select("o_orderkey", F.when(new, F.lit(0.7)).otherwise(F.lit(0.5)).alias("priority"))


@query("SELECT user_id, CASE WHEN good = 0 THEN 'failed' WHEN good < n THEN 'partial' ELSE 'success' END AS status FROM (SELECT user_id, count(*) AS n, count(*) FILTER (WHERE event_type <> 'error') AS good FROM events GROUP BY user_id)")
def or2_run_status(spark, d):
    e = table(spark, d, "events").groupBy("user_id").agg(F.count("*").alias("n"), F.count_if(F.col("event_type") != "error").alias("good"))
    return e.select("user_id", F.when(F.col("good") == 0, "failed").when(F.col("good") < F.col("n"), "partial").otherwise("success").alias("status"))


@query("""WITH r AS (SELECT user_id, count(*) AS n, count(*) FILTER (WHERE event_type = 'purchase') AS upserted, count(*) FILTER (WHERE event_type = 'error') AS bad, count(DISTINCT event_type) AS covered FROM events GROUP BY user_id),
  s AS (SELECT *, CASE WHEN upserted = 0 THEN 'no_data' WHEN bad > 0 THEN 'partial' ELSE 'success' END AS status, covered / 5.0::DOUBLE AS coverage FROM r)
  SELECT user_id, 'partial_data' AS alert_type, 'medium' AS severity FROM s WHERE status = 'partial' UNION ALL SELECT user_id, 'no_data', 'high' FROM s WHERE status = 'no_data' OR upserted = 0
  UNION ALL SELECT user_id, 'mismatch_count', CASE WHEN coverage < 0.5 THEN 'high' ELSE 'medium' END FROM s WHERE coverage < 0.8""")
def or3_alert_rules(spark, d):
    e = table(spark, d, "events").groupBy("user_id").agg(F.count_if(F.col("event_type") == "purchase").alias("upserted"), F.count_if(F.col("event_type") == "error").alias("bad"), F.countDistinct("event_type").alias("covered"))
    e = e.withColumn("status", F.when(F.col("upserted") == 0, "no_data").when(F.col("bad") > 0, "partial").otherwise("success"))
    return reports.run_alerts(e.withColumn("expected", F.lit(5)), "user_id")


@query("SELECT c_custkey, CASE WHEN c_custkey % 5 = 0 THEN 'recovery_unresolved:unknown' WHEN c_custkey % 5 < 3 THEN 'recovery_unresolved_diff:missing=' || c_custkey % 5 || ',extra=0,mismatch=0' ELSE 'recovery_unresolved_status:failed' END AS message FROM customer")
def or5_recovery_message(spark, d):
    missing = F.when((F.col("c_custkey") % 5).between(1, 2), F.col("c_custkey") % 5).otherwise(0)
    status = F.when(F.col("c_custkey") % 5 != 0, "failed")
    return table(spark, d, "customer").select("c_custkey", text.recovery_message(status, missing, F.lit(0), F.lit(0)).alias("message"))


@query("SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN 'pharmacists_chamber' WHEN 1 THEN 'pharmacists_chamber' WHEN 2 THEN 'health_directorate' ELSE 'manual' END AS type, CASE p_partkey % 4 WHEN 0 THEN 90 WHEN 1 THEN 90 WHEN 2 THEN 85 ELSE 70 END AS weight FROM part")
def or8_source_weight(spark, d):
    kind, weight = text.source_type(picked(["chamber_html", "json_api", "third_party_html", "other"], "p_partkey"))
    return table(spark, d, "part").select("p_partkey", kind.alias("type"), weight.alias("weight"))


@query("SELECT event_id, coalesce(CASE WHEN event_id % 3 = 0 THEN event_id END, CASE WHEN event_id % 3 = 1 THEN c_custkey END, n_nationkey) AS province FROM events LEFT JOIN customer ON c_custkey = user_id LEFT JOIN nation ON n_nationkey = user_id % 25")
def or17_resolution_chain(spark, d):
    e, c, n = table(spark, d, "events"), table(spark, d, "customer"), table(spark, d, "nation")
    found = e.join(c, e["user_id"] == c["c_custkey"], "left").join(n, e["user_id"] % 25 == n["n_nationkey"], "left")
    return found.select("event_id", F.coalesce(F.when(F.col("event_id") % 3 == 0, F.col("event_id")), F.when(F.col("event_id") % 3 == 1, F.col("c_custkey")), F.col("n_nationkey").cast("long")).alias("province"))


@query("SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS iso, strftime(o_orderdate, '%d.%m.%Y') AS dotted FROM orders")
def or23_date_formats(spark, d):
    return table(spark, d, "orders").select("o_orderkey", F.date_format("o_orderdate", "yyyy-MM-dd").alias("iso"), F.date_format("o_orderdate", "dd.MM.yyyy").alias("dotted"))


@query("SELECT user_id, event_type, list(event_id ORDER BY ts DESC, event_id DESC)[1] AS last_id, count(*) AS attempts FROM events GROUP BY user_id, event_type")
def str6_last_write_wins(spark, d):
    return table(spark, d, "events").groupBy("user_id", "event_type").agg(F.max_by("event_id", F.struct("ts", "event_id")).alias("last_id"), F.count("*").alias("attempts"))
