"""Queries of served lists, catalogs, logs, verification, forms and page layouts on the supplied tables, with their SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lantern.functions import numbers, text
from lantern.operators import logs, matching, ranges, reports, serving, stores, sync, upsert
from lantern.operators.tables import dealt, new_folder
from lantern.queries import AS_OF, FOLD, ORACLE_SQL, RAW_NAMES, SLUG, picked, query, sql_picked, table
from lantern.sources import catalog, forms, linked, pages

DAY = "1998-01-05"


# served lists
def _duties(spark, d) -> DataFrame:
    o, c = table(spark, d, "orders"), table(spark, d, "customer")
    return o.join(c, o["o_custkey"] == c["c_custkey"]).select("o_orderkey", "o_orderstatus", "c_nationkey", "c_mktsegment", "c_name", F.to_date("o_orderdate").alias("duty_date"))


_DUTIES = "(SELECT o_orderkey, o_orderstatus, c_nationkey, c_mktsegment, c_name, o_orderdate::DATE AS duty_date FROM orders JOIN customer ON o_custkey = c_custkey)"


@query(f"SELECT DISTINCT c_nationkey, c_name FROM {_DUTIES} WHERE duty_date = DATE '{DAY}'")
def or18_active_names(spark, d):
    return serving.on_day(_duties(spark, d), DAY).select("c_nationkey", "c_name").distinct()


@query(f"""WITH v AS (SELECT * FROM {_DUTIES} WHERE duty_date = DATE '{DAY}' AND o_orderstatus = 'F'), t AS (SELECT * FROM {_DUTIES} WHERE duty_date = DATE '{DAY}')
  SELECT c_nationkey, o_orderkey, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_mktsegment, c_name, o_orderkey) AS place FROM (SELECT * FROM v UNION ALL SELECT * FROM t WHERE c_nationkey NOT IN (SELECT c_nationkey FROM v))""")
def or19_city_lists(spark, d):
    day = serving.on_day(_duties(spark, d), DAY)
    rows = serving.with_fallback(day.where("o_orderstatus = 'F'"), day, ["c_nationkey"])
    return ranges.placed(rows, ["c_nationkey"], [F.col("c_mktsegment"), F.col("c_name"), F.col("o_orderkey")]).select("c_nationkey", "o_orderkey", "place")


@query(f"""WITH v AS (SELECT * FROM {_DUTIES} WHERE duty_date = DATE '{DAY}' AND o_orderstatus = 'F'), t AS (SELECT * FROM {_DUTIES} WHERE duty_date = DATE '{DAY}')
  SELECT c_nationkey, c_mktsegment, o_orderkey FROM v UNION ALL SELECT c_nationkey, c_mktsegment, o_orderkey FROM t WHERE NOT EXISTS (SELECT 1 FROM v WHERE v.c_nationkey = t.c_nationkey AND v.c_mktsegment = t.c_mktsegment)""")
def or19_district_lists(spark, d):
    day = serving.on_day(_duties(spark, d), DAY)
    return serving.with_fallback(day.where("o_orderstatus = 'F'"), day, ["c_nationkey", "c_mktsegment"]).select("c_nationkey", "c_mktsegment", "o_orderkey")


@query(f"SELECT o_orderkey, c_nationkey FROM {_DUTIES} WHERE duty_date = DATE '1996-07-14'")
def or20_on_date(spark, d):
    return serving.on_day(_duties(spark, d), "1996-07-14").select("o_orderkey", "c_nationkey")


@query("SELECT c_nationkey, c_custkey, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_mktsegment, c_name, c_custkey) AS place FROM customer")
def so6_list_order(spark, d):
    return ranges.placed(table(spark, d, "customer"), ["c_nationkey"], [F.col("c_mktsegment"), F.col("c_name"), F.col("c_custkey")]).select("c_nationkey", "c_custkey", "place")


_NAMED = f"(SELECT c_custkey, c_nationkey, {sql_picked(RAW_NAMES, 'c_custkey')} || ' ' || c_custkey AS name FROM customer)"


def _named(spark, d) -> DataFrame:
    return table(spark, d, "customer").select("c_custkey", "c_nationkey", F.concat(picked(RAW_NAMES, "c_custkey"), F.lit(" "), F.col("c_custkey").cast("string")).alias("name"))


@query("SELECT n_nationkey, row_number() OVER (PARTITION BY n_regionkey ORDER BY name COLLATE tr, n_nationkey) AS place FROM (SELECT *, ['ışık', 'Iz', 'İz', 'cem', 'Çam', 'dal', 'Öz', 'oz', 'Şen', 'sen', 'Üst', 'ust', 'ğa', 'ga'][n_nationkey % 14 + 1] AS name FROM nation)")
def so8_turkish_order(spark, d):
    names = ["ışık", "Iz", "İz", "cem", "Çam", "dal", "Öz", "oz", "Şen", "sen", "Üst", "ust", "ğa", "ga"]
    n = table(spark, d, "nation").withColumn("name", picked(names, "n_nationkey"))
    return serving.placed(n, ["n_regionkey"], [serving.turkish("name"), F.col("n_nationkey")]).select("n_nationkey", "place")


@query(f"SELECT c_custkey, row_number() OVER (PARTITION BY c_nationkey ORDER BY encode(name)) AS place FROM {_NAMED}")
def so9_code_unit_order(spark, d):
    return ranges.placed(_named(spark, d), ["c_nationkey"], [F.col("name")]).select("c_custkey", "place")


@query("SELECT event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id % 3, event_type COLLATE tr, event_id) AS place FROM events")
def so11_mismatch_order(spark, d):
    e = table(spark, d, "events").withColumn("distance", F.col("event_id") % 3)
    return ranges.placed(e, ["user_id"], [F.col("distance"), serving.turkish("event_type"), F.col("event_id")]).select("event_id", "place")


@query("SELECT * FROM (SELECT n_regionkey, n_nationkey, row_number() OVER (PARTITION BY n_regionkey ORDER BY n_name) AS place FROM nation) WHERE place <= 5")
def so10_first_of_each(spark, d):
    return upsert.latest(serving.placed(table(spark, d, "nation"), ["n_regionkey"], [F.col("n_name")]), ["n_regionkey"], [F.col("place")], 5).select("n_regionkey", "n_nationkey", "place")


_LISTS = f"(SELECT c_nationkey, c_custkey // 100 AS page, list({sql_picked(RAW_NAMES, 'c_custkey')}) AS names FROM customer GROUP BY ALL)"


@query(f"SELECT c_nationkey, page, array_to_string(list_sort(list_transform(list_distinct(list_filter(list_transform(names, lambda n: trim(n)), lambda n: n <> '')), lambda n: encode(n)))::VARCHAR[], '|') AS names FROM {_LISTS}")
def set7_name_lists(spark, d):
    """Lists of up to a hundred names."""
    c = table(spark, d, "customer").groupBy("c_nationkey", F.floor(F.col("c_custkey") / 100).alias("page")).agg(F.collect_list(picked(RAW_NAMES, "c_custkey")).alias("names"))
    return c.select("c_nationkey", "page", F.array_join(F.transform(serving.sorted_names(F.col("names")), _blob_text), "|").alias("names"))


def _blob_text(name: Column) -> Column:
    """As the other engine writes bytes: those beyond ASCII as hexadecimal escapes."""
    codes = F.regexp_extract_all(F.hex(F.encode(name, "utf-8")), F.lit("(..)"), F.lit(1))
    return F.array_join(F.transform(codes, lambda h: F.when(F.conv(h, 16, 10).cast("int") >= 128, F.concat(F.lit("\\x"), h)).otherwise(F.char(F.conv(h, 16, 10).cast("long")))), "")


@query(f"SELECT c_custkey FROM customer WHERE {SLUG.format('c_mktsegment')} = 'building' AND c_acctbal IS NOT NULL AND isfinite(c_acctbal)")
def flt17_district(spark, d):
    c = serving.in_district(table(spark, d, "customer"), F.col("c_mktsegment"), F.lit("building"))
    return c.where(serving.finite(F.col("c_acctbal"), F.lit(1.0))).select("c_custkey")


@query("SELECT user_id, event_id FROM events WHERE CASE WHEN event_type = 'error' THEN NULL ELSE ts END IS NULL")
def flt6_open(spark, d):
    return table(spark, d, "events").withColumn("resolved_at", F.when(F.col("event_type") != "error", F.col("ts"))).where(F.col("resolved_at").isNull()).select("user_id", "event_id")


@query("SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN upper(p_name[1]) || p_name[2:] ELSE p_brand END AS name FROM part")
def or25_province_name(spark, d):
    name = F.when(F.col("p_partkey") % 3 != 0, F.col("p_brand"))
    return table(spark, d, "part").select("p_partkey", serving.province_name(name, F.col("p_name")).alias("name"))


@query("SELECT p_partkey, 'degraded' AS status, p_name AS hint, CAST(0 AS INT) AS n FROM part")
def or11_degraded(spark, d):
    p = table(spark, d, "part").withColumn("payload", serving.degraded(F.col("p_name")))
    return p.select("p_partkey", "payload.status", "payload.degraded_info.hint", F.size("payload.data").alias("n"))


@query("SELECT p_partkey, p_partkey % 4 = 0 OR contains('relation ' || CASE p_partkey % 3 WHEN 0 THEN 'api_active_duty' ELSE 'duty_records' END, 'api_active_duty') AS missing FROM part")
def or11_view_missing(spark, d):
    code = F.when(F.col("p_partkey") % 4 == 0, "42P01").otherwise("08006")
    message = F.concat(F.lit("relation "), F.when(F.col("p_partkey") % 3 == 0, "api_active_duty").otherwise("duty_records"))
    return table(spark, d, "part").select("p_partkey", serving.view_missing(code, message).alias("missing"))


@query("SELECT l_orderkey, coalesce(arg_min({'s': CASE WHEN l_suppkey % 5 > 0 THEN l_returnflag END}, {'a': l_linenumber, 'b': l_partkey, 'c': l_suppkey, 'd': l_returnflag}).s, 'Bilinmiyor') AS source, max(l_quantity) AS verifications FROM lineitem GROUP BY l_orderkey")
def or12_source_summary(spark, d):
    li = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_returnflag", F.when(F.col("l_suppkey") % 5 > 0, F.col("l_returnflag")).alias("source"), F.col("l_shipdate").alias("updated"), F.col("l_quantity").alias("verifications"))
    return serving.source_summary(li, "l_orderkey", ["l_linenumber", "l_partkey", "l_suppkey", "l_returnflag"]).select("l_orderkey", "source", "verifications")


@query(f"SELECT p_partkey, length(p_name || ' ' || p_type || ' ' || p_brand) <= 24 AS fits FROM part")
def or14_cap_audit(spark, d):
    return table(spark, d, "part").select("p_partkey", (F.length(F.concat_ws(" ", "p_name", "p_type", "p_brand")) <= 24).alias("fits"))


@query("SELECT c_custkey FROM customer WHERE nullif(CASE WHEN c_custkey % 4 = 0 THEN '' WHEN c_custkey % 7 = 0 THEN NULL ELSE c_mktsegment END, '') IS NOT NULL")
def or21_non_blank(spark, d):
    district = F.when(F.col("c_custkey") % 4 == 0, "").when(F.col("c_custkey") % 7 == 0, None).otherwise(F.col("c_mktsegment"))
    return table(spark, d, "customer").withColumn("district", district).where("district is not null and district <> ''").select("c_custkey")


@query(f"SELECT c_nationkey, max(o_orderstatus) AS status, max(duty_date) AS day, count(c_name) AS n FROM {_DUTIES} GROUP BY c_nationkey")
def or28_snapshot(spark, d):
    rows = _duties(spark, d).select("c_nationkey", F.col("o_orderstatus").alias("status"), F.col("duty_date").alias("day"), F.col("duty_date").alias("updated"), F.col("c_name").alias("name"))
    return serving.snapshot(rows, "c_nationkey").select("c_nationkey", "status", "day", "n")


@query(f"SELECT event_id, strftime(CASE event_id % 3 WHEN 0 THEN ts ELSE TIMESTAMP '{AS_OF}' END, '%Y-%m-%dT%H:%M:%S.%gZ') AS iso FROM events")
def dt8_to_iso(spark, d):
    value = F.when(F.col("event_id") % 3 == 0, F.col("ts").cast("string")).when(F.col("event_id") % 3 == 1, "")
    return table(spark, d, "events").select("event_id", numbers.to_iso(value, F.lit(AS_OF)).alias("iso"))


@query("SELECT c_custkey, '{\"name\":\"' || c_name || '\"' || CASE WHEN c_custkey % 2 = 0 THEN ',\"lat\":1.5' ELSE '' END || '}' AS json FROM customer")
def prj4_spread(spark, d):
    c = table(spark, d, "customer").select("c_custkey", F.col("c_name").alias("name"), F.lit(True).alias("is_degraded"), F.when(F.col("c_custkey") % 2 == 0, 1.5).alias("lat"))
    return serving.without_flags(c.select("c_custkey", "name", "is_degraded", "lat").withColumnRenamed("c_custkey", "key")).select(F.col("key").alias("c_custkey"), F.regexp_replace("json", r'"key":\d+,', "").alias("json"))


# catalog
_PROVINCES = "(SELECT unnest(" + "[" + ", ".join(f"'{p}'" for p in catalog.PROVINCES) + "]) AS name, unnest(range(1, 82)) AS k)"
_REGIONS = " UNION ALL ".join(f"SELECT '{r}' AS region, unnest(string_split('{' '.join(s)}', ' ')) AS slug, unnest(range({len(s)})) AS place" for r, s in catalog.REGIONS.items())


@query(f"SELECT s_suppkey, code, name, lower(name) AS slug FROM supplier LEFT JOIN (SELECT lpad(k::VARCHAR, 2, '0') AS code, name FROM {_PROVINCES}) ON code = lpad((s_suppkey % 90)::VARCHAR, 2, '0')")
def src12_provinces(spark, d):
    """Suppliers with the province of the plate number that theirs ends with."""
    s = table(spark, d, "supplier").select("s_suppkey", F.lpad((F.col("s_suppkey") % 90).cast("string"), 2, "0").alias("plate"))
    p = catalog.provinces(spark)  # 81 rows
    return s.join(F.broadcast(p), s["plate"] == p["code"], "left").select("s_suppkey", "code", "name", "slug")


@query(f"""WITH r AS ({_REGIONS}), p AS (SELECT lower(name) AS slug, k FROM {_PROVINCES}),
  near AS (SELECT p.slug, p.k, r.region, coalesce((SELECT string_agg(o.slug, ',' ORDER BY o.place) FROM (SELECT o.*, row_number() OVER (PARTITION BY o.region ORDER BY o.place) - CASE WHEN o.place > r2.place THEN 1 ELSE 0 END AS k, r2.slug AS own FROM r o JOIN r r2 ON r2.region = o.region WHERE r2.slug = p.slug) o WHERE o.slug <> p.slug AND o.k <= 8), '') AS near
  FROM p LEFT JOIN r ON r.slug = p.slug)
  SELECT s_suppkey, slug, region, coalesce(near, '') AS near FROM supplier LEFT JOIN near ON k = s_suppkey % 90""")
def jn21_region(spark, d):
    """Suppliers with the province as above, its region and the other provinces of it."""
    found = catalog.same_region(src12_provinces(spark, d).select("s_suppkey", "slug"), catalog.regions(spark))
    return found.select("s_suppkey", "slug", "region", F.array_join("near", ",").alias("near"))


def _sources(spark, d) -> DataFrame:
    """Parts as a catalog of sources: every fifth code is in capitals, every seventh address is no URL."""
    p = table(spark, d, "part")
    url = F.when(F.col("p_partkey") % 7 == 0, F.col("p_name")).otherwise(F.concat(F.lit("https://x.example/"), (F.col("p_partkey") % 50).cast("string")))
    return p.select(F.concat(F.lit("c"), F.col("p_partkey").cast("string")).alias("code"), F.lower("p_type").alias("format"), url.alias("url"))


_SOURCE = "(SELECT 'c' || p_partkey AS code, lower(p_type) AS format, CASE WHEN p_partkey % 7 = 0 THEN p_name ELSE 'https://x.example/' || (p_partkey % 50) END AS url FROM part)"


@query(f"SELECT c_custkey, s.format, s.url FROM customer LEFT JOIN {_SOURCE} s ON s.code = 'c' || (c_custkey * 2)")
def src11_config(spark, d):
    asked = table(spark, d, "customer").select("c_custkey", F.concat(F.lit("C"), (F.col("c_custkey") * 2).cast("string")).alias("code"))
    return catalog.config(asked, _sources(spark, d)).select("c_custkey", "format", "url")


_ISSUES = f"""(WITH s AS (SELECT * FROM {_SOURCE}), p AS (SELECT 'c' || c_custkey AS slug FROM customer)
  SELECT 'missing_config:' || slug AS issue FROM p WHERE slug NOT IN (SELECT code FROM s) UNION ALL SELECT 'unknown_config_code:' || code FROM s WHERE code NOT IN (SELECT slug FROM p)
  UNION ALL SELECT 'invalid_url:' || code || ':' || url FROM s WHERE NOT regexp_matches(url, '^https?://', 'i') UNION ALL SELECT 'shared_endpoint:' || format || '::' || url || ':' || string_agg(code, ',' ORDER BY code) FROM s GROUP BY format, url HAVING count(*) > 1)"""


def _issues(spark, d) -> DataFrame:
    return catalog.issues(_sources(spark, d), table(spark, d, "customer").select(F.concat(F.lit("c"), F.col("c_custkey").cast("string")).alias("slug")))


@query(f"SELECT issue, split_part(issue, ':', 1) IN ('missing_config', 'unknown_config_code', 'invalid_url') AS hard FROM {_ISSUES}")
def or9_issues(spark, d):
    return _issues(spark, d)


@query(f"SELECT code FROM {_SOURCE} WHERE NOT regexp_matches(url, '^https?://', 'i')")
def or10_bad_urls(spark, d):
    return _sources(spark, d).where(catalog.bad_url(F.col("url"))).select("code")


@query(f"""WITH c AS (SELECT p_partkey AS key, p_name AS url, p_type AS format FROM part WHERE p_partkey % 10 <> 1), e AS (SELECT p_partkey AS key, CASE WHEN p_partkey % 10 = 3 THEN upper(p_name) ELSE p_name END AS url, p_type AS format FROM part WHERE p_partkey % 10 <> 2)
  SELECT coalesce(c.key, e.key) AS key, coalesce(c.url, e.url) AS url, coalesce(c.format, e.format) AS format, CASE WHEN e.key IS NULL THEN 'created' WHEN c.key IS NULL THEN 'kept' WHEN c.url <> e.url OR c.format <> e.format THEN 'updated' ELSE 'same' END AS change FROM c FULL JOIN e ON c.key = e.key""")
def snk8_sync(spark, d):
    p = table(spark, d, "part").select(F.col("p_partkey").alias("key"), F.col("p_name").alias("url"), F.col("p_type").alias("format"))
    old = p.where("key % 10 <> 2").withColumn("url", F.when(F.col("key") % 10 == 3, F.upper("url")).otherwise(F.col("url")))
    return upsert.synced(p.where("key % 10 <> 1"), old, "key", ["url", "format"])


@query("SELECT count_if(p_partkey % 10 = 2) AS created, count_if(p_partkey % 10 = 3) AS updated, count_if(p_partkey % 10 NOT IN (1, 2, 3)) AS same, count_if(p_partkey % 10 = 1) AS kept FROM part")
def snk8_counters(spark, d):
    return upsert.sync_counters(snk8_sync(spark, d))


# logs
@query("SELECT event_id, event_type AS status, NULL::VARCHAR AS message FROM events WHERE event_id % 2 = 0 UNION ALL SELECT event_id, 'failed', props FROM events WHERE event_type = 'error'")
def snk5_run_log(spark, d):
    e = table(spark, d, "events")
    return logs.appended(e.where("event_id % 2 = 0").select("event_id", F.col("event_type").alias("status")), e.where("event_type = 'error'").select("event_id", F.lit("failed").alias("status"), F.col("props").alias("message")))


_PAYLOADS = ["", None, "5", '"a"', "[1]", '{"k":1}', "null"]


@query("""SELECT event_id, coalesce(CASE WHEN event_id % 4 = 0 THEN event_id % 25 END, n_nationkey, CASE WHEN event_id % 3 > 0 THEN s_nationkey END) AS province_id, CASE event_id % 3 WHEN 0 THEN 'critical' WHEN 1 THEN 'info' ELSE 'warning' END AS severity,
  CASE WHEN event_id % 2 = 0 THEN event_type ELSE props END AS message, CASE event_id % 4 WHEN 0 THEN '{}' WHEN 1 THEN '{"value":5}' WHEN 2 THEN props ELSE '{"value":[1]}' END AS payload
  FROM events LEFT JOIN nation ON n_name = 'NATION_' || (user_id % 40) LEFT JOIN supplier ON s_suppkey = event_id % 90
  WHERE coalesce(CASE WHEN event_id % 4 = 0 THEN event_id % 25 END, n_nationkey, CASE WHEN event_id % 3 > 0 THEN s_nationkey END) IS NOT NULL""")
def snk6_alerts(spark, d):
    k = F.col("event_id")
    e = table(spark, d, "events").select(
        "event_id", F.when(k % 4 == 0, k % 25).alias("province_id"), F.concat(F.lit("NATION_"), (F.col("user_id") % 40).cast("string")).alias("slug"), F.when(k % 3 > 0, k % 90).alias("endpoint_id"), F.col("event_type").alias("alert_type"),
        F.when(k % 3 == 0, "HIGH").when(k % 3 == 1, "low").otherwise("odd").alias("severity"), F.when(k % 2 == 0, " ").otherwise(F.col("props")).alias("message"),
        F.when(k % 4 == 0, None).when(k % 4 == 1, "5").when(k % 4 == 2, F.col("props")).otherwise("[1]").alias("payload"),
    )
    endpoints = table(spark, d, "supplier").select(F.col("s_suppkey").alias("endpoint_id"), F.col("s_nationkey").alias("e_province"))
    provinces = table(spark, d, "nation").select(F.col("n_name").alias("slug"), F.col("n_nationkey").alias("p_province"))
    return logs.alert_rows(e, endpoints, provinces).select("event_id", F.col("province_id").cast("long").alias("province_id"), "severity", "message", "payload")


@query(f"SELECT event_id, CASE WHEN event_id % 5 = 0 THEN ts WHEN event_type = 'error' AND event_id % 3 = 0 THEN TIMESTAMP '{AS_OF}' END AS notified_at FROM events")
def snk12_notified(spark, d):
    e = table(spark, d, "events").select("event_id", "event_type", F.when(F.col("event_id") % 5 == 0, F.col("ts")).alias("notified_at"))
    return logs.notified(e, e.where("event_type = 'error' and event_id % 3 = 0"), "event_id", AS_OF).select("event_id", "notified_at")


@query("SELECT event_id, 'update' AS action, 'u' || user_id AS actor, CASE WHEN event_id % 2 = 0 THEN event_id::VARCHAR END AS resource_id FROM events WHERE event_type = 'click' UNION ALL SELECT event_id, 'create', NULL, event_id::VARCHAR FROM events WHERE event_type = 'signup'")
def snk13_audit(spark, d):
    e = table(spark, d, "events").where("event_type = 'click'").select("event_id", F.lit("update").alias("action"), F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("actor"), F.when(F.col("event_id") % 2 == 0, F.col("event_id").cast("string")).alias("resource_id"))
    old = table(spark, d, "events").where("event_type = 'signup'").select("event_id", F.lit("create").alias("action"), F.lit(None).cast("string").alias("actor"), F.col("event_id").cast("string").alias("resource_id"))
    return logs.appended(old, e)


@query("SELECT p_partkey, CASE WHEN p_partkey % 5 = 0 THEN 'https://new.example/' || p_partkey ELSE p_name END AS url, p_type AS format FROM part WHERE p_partkey % 11 <> 0")
def snk18_point_updates(spark, d):
    p = table(spark, d, "part").select("p_partkey", F.col("p_name").alias("url"), F.col("p_type").alias("format"))
    kept = p.join(p.where("p_partkey % 11 = 0").select("p_partkey"), "p_partkey", "left_anti")
    return logs.corrected(kept, p.where("p_partkey % 5 = 0").select("p_partkey", F.concat(F.lit("https://new.example/"), F.col("p_partkey").cast("string")).alias("url")), "p_partkey", ["url"])


_STALE = f"(SELECT user_id, coalesce((epoch_us(TIMESTAMP '{AS_OF}') - epoch_us(max(ts) FILTER (WHERE event_type = 'purchase'))) / 6e7, 9999) AS m FROM events GROUP BY user_id)"


def _stale(spark, d) -> DataFrame:
    last = table(spark, d, "events").groupBy("user_id").agg(F.max(F.when(F.col("event_type") == "purchase", F.col("ts"))).alias("last_success_at"))
    return logs.staleness_alerts(last.withColumn("name", F.concat(F.lit("u"), F.col("user_id").cast("string"))), "user_id", "name", AS_OF)


@query(f"SELECT user_id, CASE WHEN m > 370 THEN 'freshness_breach' ELSE 'stale_data' END AS alert_type, CASE WHEN m > 370 THEN 'high' ELSE 'medium' END AS severity, CASE WHEN m < 9000 THEN 'Son basarili ingest ' || CAST(floor(m + 0.5) AS BIGINT) || ' dk once (u' || user_id || ')' ELSE 'Hic basarili ingest yok son 24 saatte (u' || user_id || ')' END AS message, CAST(floor(m + 0.5) AS BIGINT) AS minutes FROM {_STALE} WHERE m > 130")
def str7_staleness(spark, d):
    return _stale(spark, d)


@query(f"SELECT count_if(m <= 370) AS stale, count_if(m > 370) AS critical, count(*) AS checked FROM {_STALE} WHERE m > 130")
def or16_stale_counts(spark, d):
    return logs.stale_counts(_stale(spark, d))


# verification
_VERDICT = "CASE WHEN p_partkey % 11 = 0 OR p_partkey % 13 = 0 THEN 'ERROR' WHEN p_size % 5 = 0 THEN 'NO_SOURCE_DATA' WHEN p_size % 7 = 0 THEN 'NO_API_DATA' WHEN p_partkey % 3 = 0 THEN 'PASS' ELSE 'FAIL' END"


def _verdict() -> Column:
    k = F.col("p_partkey")
    return logs.verdict(k % 11 == 0, k % 13 == 0, F.col("p_size") % 5, F.col("p_size") % 7, k % 3)


@query(f"SELECT p_partkey, {_VERDICT} AS verdict FROM part")
def or6_verdict(spark, d):
    return table(spark, d, "part").select("p_partkey", _verdict().alias("verdict"))


@query("SELECT p_partkey, CASE WHEN p_size % 4 = 0 THEN 'NO_ENDPOINT' WHEN p_partkey % 11 = 0 THEN 'SOURCE_ERROR' WHEN p_size % 5 = 0 THEN 'NO_SOURCE_DATA' WHEN p_partkey % 13 = 0 THEN 'API_ERROR' WHEN p_partkey % 3 = 0 THEN 'PASS' ELSE 'FAIL' END AS verdict FROM part")
def or7_single_verdict(spark, d):
    k = F.col("p_partkey")
    return table(spark, d, "part").select("p_partkey", logs.single_verdict(F.col("p_size") % 4 != 0, k % 11 == 0, F.col("p_size") % 5, k % 13 == 0, k % 3).alias("verdict"))


@query(f"SELECT {', '.join(f"count_if(v = '{v}') AS {v.lower()}" for v in ('PASS', 'FAIL', 'ERROR', 'NO_SOURCE_DATA', 'NO_API_DATA'))} FROM (SELECT {_VERDICT} AS v FROM part)")
def ag21_verdicts(spark, d):
    return table(spark, d, "part").select(_verdict().alias("v")).agg(*[F.count_if(F.col("v") == v).alias(v.lower()) for v in ("PASS", "FAIL", "ERROR", "NO_SOURCE_DATA", "NO_API_DATA")])


def _letters(key: Column) -> Column:
    """A word for each number, so far from the others that near names are those that were made so."""
    return F.translate(F.md5(key.cast("string")), "0123456789", "ghijklmnop")


_WORD = "translate(md5({0}::VARCHAR), '0123456789', 'ghijklmnop')"


@query(f"""SELECT c_nationkey AS block, count_if(c_custkey % 11 > 0 AND c_custkey % 13 > 0 AND c_custkey % 7 > 0) AS n_matched, count_if(c_custkey % 11 > 0 AND c_custkey % 13 > 0 AND c_custkey % 7 = 0) AS n_mismatch,
  count_if(c_custkey % 11 = 0 AND c_custkey % 13 > 0) AS n_missing, count_if(c_custkey % 13 = 0 AND c_custkey % 11 > 0) AS n_extra FROM customer WHERE c_custkey % 143 > 0 GROUP BY c_nationkey""")
def set4_fixed_distance(spark, d):
    """Names differ by two letters at most to be a mismatch; every seventh of ours lacks one, and some are in one list only."""
    c = table(spark, d, "customer").select(F.col("c_nationkey").alias("block"), F.col("c_custkey").alias("ord"), _letters(F.col("c_custkey")).alias("name"))
    ours = c.where("ord % 11 <> 0").withColumn("name", F.when(F.col("ord") % 7 == 0, F.substring("name", 1, 31)).otherwise(F.col("name")))
    diff = matching.name_difference(ours, c.where("ord % 13 <> 0"), "block", fixed=2)
    return matching.difference_severity(diff, "block").select("block", "n_matched", "n_mismatch", "n_missing", "n_extra")


@query(f"""WITH n AS (SELECT c_nationkey AS block, count_if(c_custkey % 3 = 0) AS missing, count_if(c_custkey % 5 = 0 AND c_custkey % 3 > 0) AS extra, count_if(c_custkey % 3 > 0 AND c_custkey % 5 > 0) AS matched FROM customer GROUP BY c_nationkey)
  SELECT block, 'verification_diff' AS alert_type, CASE WHEN missing + extra > 0 THEN 'high' ELSE 'low' END AS severity, 'missing=' || missing || ',extra=' || extra || ',mismatch=0' AS message FROM n WHERE missing + extra > 0""")
def or4_verification(spark, d):
    """Names of the source against those of the view, or of the tables where the view has none."""
    c = table(spark, d, "customer").select(F.col("c_nationkey").alias("block"), F.col("c_custkey").alias("ord"), _letters(F.col("c_custkey")).alias("name"))
    view = c.where("ord % 3 <> 0 and block % 2 = 0")
    ours = serving.with_fallback(view, c.where("ord % 3 <> 0"), ["block"])
    diff = matching.difference_severity(matching.name_difference(ours, c.where("ord % 5 <> 0 or ord % 3 = 0"), "block"), "block")
    found = diff.where("n_missing + n_extra + n_mismatch > 0")
    message = F.concat_ws(",", *[F.concat(F.lit(f"{k}="), F.col(f"n_{k}").cast("string")) for k in ("missing", "extra", "mismatch")])
    return found.select("block", F.lit("verification_diff").alias("alert_type"), "severity", message.alias("message"))


_ILS = ["NATION_1", "nation 2", " Nation.3 ", "NATİON_4", "yok", "NATION_5"]
_ILCES = ["BUILDING", "Machinery ", "", "yok", "furnıture"]


@query(f"""WITH d AS (SELECT c_nationkey AS province_id, c_mktsegment AS name, c_nationkey * 10 + row_number() OVER (PARTITION BY c_nationkey ORDER BY c_mktsegment) AS id FROM (SELECT DISTINCT c_nationkey, c_mktsegment FROM customer)),
  r AS (SELECT c_custkey, {sql_picked(_ILS, 'c_custkey')} AS il, {sql_picked(_ILCES, 'c_custkey')} AS ilce, trim({sql_picked(['kapali', ' diger ', 'baska'], 'c_custkey')}) AS issue FROM customer WHERE c_custkey % 3 < 2)
  SELECT c_custkey, n_nationkey AS province_id, CAST(d.id AS INT) AS district_id, issue FROM r JOIN nation ON {SLUG.format('n_name')} = {SLUG.format('il')} LEFT JOIN d ON d.province_id = n_nationkey AND trim(ilce) <> '' AND {SLUG.format('d.name')} = {SLUG.format('ilce')}""")
def snk10_reports(spark, d):
    c = table(spark, d, "customer").select("c_custkey", picked(_ILS, "c_custkey").alias("il"), picked(_ILCES, "c_custkey").alias("ilce"), "c_name", picked(["kapali", " diger ", "baska"], "c_custkey").alias("issue"))
    n = table(spark, d, "nation").select(text.slugify(F.col("n_name")).alias("slug"), F.col("n_nationkey").alias("province_id"))
    order = F.row_number().over(Window.partitionBy("c_nationkey").orderBy("c_mktsegment"))  # of distinct segments
    districts = table(spark, d, "customer").select("c_nationkey", "c_mktsegment").distinct().select(F.col("c_nationkey").alias("province_id"), text.slugify(F.col("c_mktsegment")).alias("slug"), (F.col("c_nationkey") * 10 + order).cast("int").alias("district_id"))
    return reports.correction_reports(c.withColumnRenamed("c_name", "name"), n, districts).select("c_custkey", "province_id", "district_id", "issue")


@query(f"""WITH w AS (SELECT c_custkey, c_nationkey AS block, ['BUILD', 'MACHINERY', 'old town', '', 'xx FURNITURE yy'][c_custkey % 5 + 1] AS raw FROM customer),
  d AS (SELECT c_nationkey AS block, c_mktsegment AS name, lower(c_mktsegment) AS slug, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_mktsegment) AS ord FROM (SELECT DISTINCT c_nationkey, c_mktsegment FROM customer)),
  p AS (SELECT w.*, d.ord, d.slug, {SLUG.format('raw')} AS needle FROM w JOIN d USING (block))
  SELECT c_custkey, CAST(coalesce(min(ord) FILTER (raw <> '' AND slug = needle), min(ord) FILTER (raw <> '' AND (contains(slug, needle) OR contains(needle, slug))), min(ord)) AS INT) AS district FROM p GROUP BY c_custkey""")
def jn18_old_resolver(spark, d):
    c = table(spark, d, "customer")
    rows = c.select(F.col("c_custkey").alias("row_id"), F.col("c_nationkey").alias("block"), F.element_at(F.array(*map(F.lit, ["BUILD", "MACHINERY", "old town", "", "xx FURNITURE yy"])), (F.col("c_custkey") % 5 + 1).cast("int")).alias("raw"))
    s = c.select(F.col("c_nationkey").alias("block"), F.col("c_mktsegment").alias("name")).distinct()
    s = s.withColumn("ord", F.row_number().over(Window.partitionBy("block").orderBy("name"))).withColumn("slug", text.slugify(F.col("name"))).withColumn("id", F.col("ord"))
    return matching.resolve_plain(rows, s, "block").select(F.col("row_id").alias("c_custkey"), F.col("district_id").alias("district"))


# forms and addresses
_FORMS = [
    '<form action="#"><input name="tarih" value="2024-01-05"><input type="submit" value="Nöbetleri Göster">Nöbetleri göster</form>', '<form action="/nobetkarti"><input type="submit" value="Göster"></form>',
    '<form method=post action=x><input name=ilce><input type="submit" value="Yazdır">Nöbet kartı yazdır</form>', "<form action=y>plain</form>", '<form action="./">Nöbetçi eczaneleri göster<input type=text name="date1"></form>',
]
#: By hand from the points of what each form has.
_SCORES = [8 + 8 + 2 + 1, 8 - 12, -5 - 8, 0, 3 + 2 + 1]


@query(f"SELECT p_partkey, CAST([{', '.join(map(str, _SCORES))}][p_partkey % 5 + 1] AS INT) AS score FROM part")
def nu11_form_score(spark, d):
    return table(spark, d, "part").select("p_partkey", forms.form_score(picked(_FORMS, "p_partkey")).alias("score"))


_SELECTS = ['<select name=a><option value="1">One</option><option value="9">Tümü</option></select>', '<select><option value="1">x</option><option value="2" selected>y</option></select>', "<select><option>first&nbsp;one</option><option>b</option></select>", "<select></select>"]


@query("SELECT p_partkey, ['9', '2', 'first one', ''][p_partkey % 4 + 1] AS value FROM part")
def js7_option(spark, d):
    return table(spark, d, "part").select("p_partkey", forms.option(picked(_SELECTS, "p_partkey")).alias("value"))


@query("""SELECT p_partkey, 'day=31/01/2024&go=Nöbetleri Göster&hidden=' || p_name || '&il=9&k=2' AS sent FROM part""")
def js8_payload(spark, d):
    form = F.concat(
        F.lit('<form><input name="day" value="05/01/2024"><input type=checkbox name=c value=1><input type=radio name=k value=2 checked><input type="hidden" name="hidden" value="'), F.col("p_name"),
        F.lit('"><input type=submit name=go value="Nöbetleri Göster"><input type=submit name=print value="Yazdır"><input type=reset name=r><input value=x>' + _SELECTS[0].replace("name=a", "name=il") + "</form>"),
    )
    sent = F.transform(F.array_sort(F.map_entries(forms.payload(F.col("form"), F.lit("2024-01-31").cast("date")))), lambda e: F.concat(e["key"], F.lit("="), e["value"]))
    return dealt(table(spark, d, "part"), "p_partkey").select("p_partkey", form.alias("form")).select("p_partkey", F.array_join(sent, "&").alias("sent"))


@query("""SELECT p_partkey, CASE p_partkey % 9 WHEN 0 THEN 'https://a.example/x/w/y.php?q=1' WHEN 1 THEN 'https://a.example/z' || p_partkey WHEN 2 THEN 'https://a.example/x/w/z' || p_partkey WHEN 3 THEN 'https://a.example/x/w/y.php?d=' || p_partkey WHEN 4 THEN 'http://b.example/' WHEN 5 THEN 'https://b.example/'
    WHEN 6 THEN 'https://a.example/x/z' || p_partkey || '/?u=../k' WHEN 7 THEN 'https://a.example/' || p_partkey ELSE 'https://a.example/x/w/' || p_partkey || '/' END AS url,
  'u' || CASE WHEN p_partkey % 2 = 0 THEN '?a=1&b=2' ELSE '?b=2' END AS asked FROM part""")
def js9_addresses(spark, d):
    k = F.col("p_partkey")
    n = k.cast("string")
    action = F.when(k % 9 == 0, "").when(k % 9 == 1, F.concat(F.lit("/z"), n)).when(k % 9 == 2, F.concat(F.lit("z"), n)).when(k % 9 == 3, F.concat(F.lit("?d="), n)).when(k % 9 == 4, "http://b.example/").when(k % 9 == 5, "//b.example/")
    action = action.when(k % 9 == 6, F.concat(F.lit("../z"), n, F.lit("/v/../?u=../k"))).when(k % 9 == 7, F.concat(F.lit("/../a/../"), n)).otherwise(F.concat(F.lit("./"), n, F.lit("/./b/..")))
    tag = F.concat(F.lit("<form method=post action='"), action, F.lit("'>"))
    return table(spark, d, "part").select("p_partkey", catalog.resolved(F.lit("https://a.example/x/w/y.php?q=1"), catalog.attribute(tag, "action")).alias("url"), catalog.append_query(F.when(k % 2 == 0, "u?a=1").otherwise("u"), F.lit("b=2")).alias("asked"))


@query("SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN 'https://a.example/getPharmacies/2024-01-31' WHEN 1 THEN 'https://b.example/api/getPharm/2024-01-31' END AS url FROM part")
def js10_ajax_url(spark, d):
    scripts = ["fetch('https://a.example/getPharmacies/' + day)", 'url = "/api/getPharm/" + d', "url = '/other/' + d", ""]
    return table(spark, d, "part").select("p_partkey", catalog.ajax_url(picked(scripts, "p_partkey"), F.lit("https://b.example/list?x=1"), F.lit("2024-01-31")).alias("url"))


# names that plain rules express in SQL too
_TITLE = "array_to_string(list_transform(string_split({0}, ' '), lambda w: upper(translate(w[1], 'iı', 'İI')) || lower(translate(w[2:], 'Iİ', 'ıi'))), ' ')"


@query(f"SELECT p_partkey, {_TITLE.format(sql_picked(['AKSU ECZANESI', 'ışık İLÇESİ', 'iKİ KELİME', 'x', ''], 'p_partkey'))} AS title FROM part")
def or13_title_cases(spark, d):
    return table(spark, d, "part").select("p_partkey", text.turkish_title(picked(["AKSU ECZANESI", "ışık İLÇESİ", "iKİ KELİME", "x", ""], "p_partkey")).alias("title"))


_SCRIPT = "regexp_replace(upper(translate(" + FOLD.format("trim({0})") + ", 'i', 'I')), '[.,''/\\\\-]+', ' ', 'g')"
for _ending in ("ECZANESI", "ECZANE", "ECZ"):
    _SCRIPT = f"regexp_replace({_SCRIPT}, '\\s+{_ending}\\s*$', '')"


ORACLE_SQL["sc7_script_name"] = f"SELECT c_custkey, trim(regexp_replace({_SCRIPT.format(sql_picked(RAW_NAMES, 'c_custkey'))}, '\\s+', ' ', 'g')) AS norm FROM customer"
ORACLE_SQL["or13_turkish_title"] = f"SELECT c_custkey, {_TITLE.format(sql_picked(RAW_NAMES, 'c_custkey'))} AS title FROM customer"


# page layouts: a page for each customer, of its name, segment and number, with two cards or more and some that must be dropped
_TEL = '<a href="tel:0232 {n}">ara</a>'
_MAP = '<a href="https://maps.google.com/maps?q=38.5,27.25">m</a>'
_HOME = "<i class='fa fa-home'></i> Sokak {n} {n}<br>"
_LAYOUTS: dict[str, tuple[str, str, list[dict[str, str]]]] = {
    # query: parser, page, expected fields of its rows in SQL; {c} name, {s} segment, {n} number; without name the name is c
    "prs1_table": (
        "table_auto_v1",
        '<table><tr><td>a</td></tr><tr><td>b</td></tr></table><table><tr><td></td></tr><tr><th>Eczane Adı</th><th>Semt</th><th>Address</th><th>GSM</th><th>x</th></tr><tr><td>{c}</td><td>{s}</td><td>No {n}</td><td>0232 {n}</td><td>' + _MAP + "</td></tr><tr><td> </td></tr><tr><td>ab</td><td>{s}</td></tr><tr><td>{c} &amp; {s}</td></tr></table>",
        [{"district": "s", "address": "'No ' || n", "phone": "'0232 ' || n", "lat": "38.5", "lng": "27.25"}, {"name": "c || ' & ' || s"}],
    ),
    "prs2_heading": (
        "card_auto_v1",
        "<h1>BUGÜN NÖBETÇİ</h1><h2>{s} NÖBETÇİ ECZANELER 01.01.2026</h2><h3>{c} ECZANESİ</h3><p>" + _HOME + "<i class='fa fa-phone'></i> 0232 {n}<br></p><h2>Duyurular</h2>"
        "<h3>AKSU ECZANESİ - Buca</h3>" + _TEL + _MAP + "<h4>YOK ECZANESİ</h4><p>x</p><h4>ÇINAR ECZ</h4><h5>Bornova</h5><i class='icon-home'></i> Cadde {n}</p><h3>{c} eczanesi</h3><i class='fa-arrow-right'></i> Merkez<br><i class='fa-map-marker'></i> Meydan {n}</p>",
        [{"name": "c || ' ECZANESİ'", "district": "s", "address": "'Sokak ' || n || ' ' || n", "phone": "'0232 ' || n"}, {"name": "'AKSU ECZANESİ'", "district": "'Buca'", "phone": "'0232 ' || n", "lat": "38.5", "lng": "27.25"}, {"name": "'ÇINAR ECZ'", "district": "'Bornova'", "address": "'Cadde ' || n"}, {"name": "c || ' eczanesi'", "district": "'Merkez'", "address": "'Meydan ' || n"}],
    ),
    "prs3_inline": (
        "inline_box_v1",
        '<div data-name=" {c} " data-district=" {s} "><h4>{c} ECZ</h4><p><svg><a>y</a></svg>Sokak {n}, <a href="tel:0232 {n}">0232 {n}</a></p>' + _MAP + '</div><div data-name="{c}" class="x" data-district="{s}"><p>Cadde <span>0312 {n}000</span></p></div><div data-name="ab" data-district="{s}"></div><div data-name="{c}" data-district="y"></div>',
        [{"name": "c || ' ECZ'", "district": "s", "address": "'Sokak ' || n || ','", "phone": "'0232 ' || n", "lat": "38.5", "lng": "27.25"}, {"district": "s", "address": "'Cadde'", "phone": "'0312 ' || n || '000'"}, {"district": "'y'"}],
    ),
    "prs4_duty_box": (
        "antalya_nobetci_div_v1",
        '<div class="nobetciDiv"><h4>{c}</h4>' + _TEL + _TEL + _HOME + '</div><div class="nobetciDiv">' + " " * 900 + '</div><div class="nobetciDiv"><a href="tel:0232 {n}">{c} {s}</a>' + _TEL + '<a href="https://maps.google.com/maps?q=38.5,27.25" class="nadres">Cadde <b>{n}</b></a></div>',
        [{"address": "'Sokak ' || n || ' ' || n", "phone": "'0232 ' || n"}, {"name": "c || ' ' || s", "address": "'Cadde ' || n", "phone": "'0232 ' || n", "lat": "38.5", "lng": "27.25"}],
    ),
    "prs5_titled_links": ("teknoecza_v1", '<a title="Nöbetçi Eczane" href="x">{c}</a> <span>({s})</span><a title="Nöbetçi Eczane" href="x">{c} 2</a>' + "-" * 130 + '<span>(y)</span><a title="NÖBETÇİ Eczane">z</a><a title="Nöbetçi Eczane">{c} 3</a> <span class="k">( {n} )</span>', [{"district": "s"}, {"name": "c || ' 3'", "district": "n"}]),
    "prs5_columns": (
        "teknoecza_v1",
        '<div class="eight columns bottom-1"><strong> {c} ECZANESİ </strong><i class="icon-hand-right"></i> {s}<br><i class="icon-home"></i> Sokak {n}<br><i class="icon-phone"></i> 0232 {n}11<br><p><hr></p><div class="eight columns bottom-1"><strong>{c}</strong><p><hr></p><div class="eight columns bottom-1"><strong>AKSU ECZANES</strong></div> </div>',
        [{"name": "c || ' ECZANESİ'", "district": "s", "address": "'Sokak ' || n", "phone": "'0232 ' || n || '11'"}, {"name": "'AKSU ECZANES'"}],
    ),
    "prs6_marquee": ("teknoecza_v2", '<a href="nobetci-eczaneler" title="Bugün nöbetçi">{c} / <strong><small>{s}</small></strong></a><a href="nobetci-eczaneler" title="Yarın">{c} / <strong><small>y</small></strong></a><a href="nobetci-eczaneler" class="k" title="Bugün">{c} B / <strong><small>{n}</small></strong></a>', [{"district": "s"}, {"name": "c || ' B'", "district": "n"}]),
    "prs7_icon_block": (
        "icon_user_md_v1",
        '<i class="icon-user-md"></i> {c}<br><i class="icon-home"></i> Sokak {n}<br>' + _TEL + '<hr><i class="icon-user-md"></i> ab<br><i class="icon-home"></i>' + " " * 1200 + '<i class="icon-user-md"></i> {c} {s}</b><i class="icon-home"></i> Cadde {n}</p><i class="icon-phone"></i> 0312 {n}00<br>',
        [{"address": "'Sokak ' || n", "phone": "'0232 ' || n"}, {"name": "c || ' ' || s", "address": "'Cadde ' || n", "phone": "'0312 ' || n || '00'"}],
    ),
    "prs8_placemark": ("yandex_placemark_v1", "ymaps.Placemark([36.5, 36.25], {{balloonContent: '<strong>{c}</strong><br>x'}}); ymaps.Placemark([1, 2], {{balloonContent: 'x'}}); new ymaps.Placemark( [ -1.5 , 7 ], {{ balloonContent: '<strong>{s}\\' {c}</strong>' }})", [{"lat": "36.5", "lng": "36.25"}, {"name": "s || ''' ' || c", "lat": "-1.5", "lng": "7"}]),
    "prs9_trend_item": (
        "trend_item_v1",
        '<div class="trend-item"><h3>{c} ECZ</h3><h5>{s}</h5><i class="icon-home"></i><i class="fa-map-marker"></i> Sokak {n}<br>' + _TEL + '<hr></div><div class="x trend-item"><h3>{c}</h3><i class="icon-home"></i></div>' + " " * 1200 + '<div class="trend-item"><h3>{s} Ecz</h3><i class="icon-home"></i><i class="fa-map-marker"></i> haritada<br><i class="fa-phone"></i> 0312 {n}00<br></div>' + " " * 1200 + '<div class="trend-item"><h3>YOK ECZ</h3><i class="icon-home"></i></div>',
        [{"name": "c || ' ECZ'", "district": "s", "address": "'Sokak ' || n", "phone": "'0232 ' || n"}, {"name": "s || ' Ecz'", "phone": "'0312 ' || n || '00'"}],
    ),
    "prs10_definition": ("eczaneismi_v1", '<dt class="eczaneismi">{c}</dt><dd class="eczaneadres">Sokak {n}</dd><dt class="eczaneismi">YOK</dt>' + " " * 500 + '<dt class="eczaneismi"><b>{s} {c}</dt> <dd class="eczaneadres"><i>Cadde</i></dd>', [{"address": "'Sokak ' || n"}, {"name": "'YOK ' || s || ' ' || c", "address": "'Cadde'"}]),
    "prs11_duty_card": (
        "osmaniye_eo_v1",
        '<div class="x nobet-kart"><h4>01.01.2026 / <strong>{c}</strong> - {s}</h4>' + "<i class='fa fa-home'></i> Sokak {n} {n} " + _TEL + '<hr><div class="nobet-kart"><h4>02.01.2026 / OSMANİYE KADİRLİ {c}</h4><i class="fa-home"></i> Cadde {n}<br> <i class="fa-phone"></i><hr><div class="nobet-kart"><h4></h4><hr>',
        [{"district": "s", "address": "'Sokak ' || n || ' ' || n", "phone": "'0232 ' || n"}, {"district": "'KADİRLİ'", "address": "'Cadde ' || n"}],
    ),
    "prs12_sections": (
        "karaman_vatan_hl_v1",
        '<h2 class="vatan_hl">{s} Nöbetçi Eczaneler 01.01.2026</h2><h4>{c}</h4><i class="icon-home"></i> Sokak {n}</p>' + _TEL + '<h4>B {c}</h4><i class="icon-home"></i> Cadde {n}<i class="icon-phone"></i> 0312 {n}00<br>' + " " * 900 + '<i class="icon-home"></i> Uzak {n}</p><h2>x</h2><h2 class="k vatan_hl">Ermenek</h2><h4>C {c}</h4><i class="icon-home"></i> Meydan</p>' + " " * 600 + _TEL,
        [{"district": "s", "address": "'Sokak ' || n", "phone": "'0232 ' || n"}, {"name": "'B ' || c", "district": "s", "address": "'Cadde ' || n", "phone": "'0312 ' || n || '00'"}, {"name": "'C ' || c", "district": "'Ermenek'", "address": "'Meydan'"}],
    ),
    "prs13_nested_table": ("konya_v1", '<table class="baslik_eczane"><tr><td>Bölge</td><td>x</td><td>Eczane</td></tr><tr><td>{s}</td><td>1</td><td>{c}</td></tr><tr><td>{s}</td><td>Adres</td></tr><tr><td>y</td><td>ECZANE</td></tr><tr><td>{n}</td><td>{c} 2</td><td>k</td></tr></table>', [{"district": "s"}, {"name": "c || ' 2'", "district": "n"}]),
    "prs15_named_sections": ("ankara", '<li data-name="{c}" data-district="{s}"><h4>{c} ECZ</h4><p>Sokak {n} <span>0312 1112233</span></p><li data-name="ab" data-district="{s}"><h4>uzun</h4><li data-name="{c}"\n data-district="y"><p>Cadde <a href="tel:0232 {n}">0232 {n}</a></p>', [{"name": "c || ' ECZ'", "district": "s", "address": "'Sokak ' || n", "phone": "'0312 1112233'"}, {"district": "'y'", "address": "'Cadde'", "phone": "'0232 ' || n"}]),
    "prs17_map_link": ("map_link", '<a href="https://maps.google.com/?q=38.5,27.25" target="x" style="color:red;font-weight:bold">GECE : {c}</a><a href="https://maps.google.com/?q=1,2">{c}</a><a href="https://maps.google.com/" style="font-weight:bold"> GÜNDÜZ-GECE {s} </a><a href="https://maps.google.com/" style="font-weight:bold">ab</a>', [{}, {"name": "s"}]),
}


def _page(template: str) -> Column:
    html = F.lit(template.replace("{{", "{").replace("}}", "}"))
    for k in "csn":
        html = F.replace(html, F.lit("{" + k + "}"), F.col(k))
    return html


def _named_customers(spark, d) -> DataFrame:
    return table(spark, d, "customer").select("c_custkey", "c_nationkey", F.replace("c_name", F.lit("#"), F.lit(" ")).alias("c"), F.col("c_mktsegment").alias("s"), F.col("c_custkey").cast("string").alias("n"))


_NAMED_SQL = "(SELECT c_custkey, c_nationkey, replace(c_name, '#', ' ') AS c, c_mktsegment AS s, c_custkey::VARCHAR AS n FROM customer)"
_EMPTY_ROW = {"name": "c", "district": "''", "address": "''", "phone": "''", "lat": "NULL", "lng": "NULL"}


def _row_sql(fields: dict[str, str]) -> str:
    kinds = {"lat": "DOUBLE", "lng": "DOUBLE"}
    return ", ".join(f"CAST({v} AS {kinds.get(k, 'VARCHAR')}) AS {k}" for k, v in (_EMPTY_ROW | fields).items())


def _layout(name: str, parser: str, page: str, rows: list[dict[str, str]]) -> None:
    def run(spark, d):
        html = dealt(_named_customers(spark, d), "c_custkey").select("c_custkey", _page(page).alias("html"))
        found = html.select("c_custkey", F.posexplode((pages.PARSERS | pages.OTHERS)[parser](F.col("html"))).alias("place", "r"))
        return found.select("c_custkey", "place", *[F.col(f"r.{f}").alias(f) for f in pages.FIELDS])

    run.__name__ = name
    query(" UNION ALL ".join(f"SELECT c_custkey, {k} AS place, {_row_sql(fields)} FROM {_NAMED_SQL}" for k, fields in enumerate(rows)))(run)


for _name, _made in _LAYOUTS.items():
    _layout(_name, *_made)


@query("SELECT c_custkey, replace(c_name, '#', ' ') || ' ECZANESİ' AS name, c_mktsegment AS district, 'Sokak ' || c_custkey AS address, '0276' AS phone FROM customer")
def prs16_nested_json(spark, d):
    c = table(spark, d, "customer").withColumn("c", F.replace("c_name", F.lit("#"), F.lit(" ")))
    inner = F.struct(F.lit("").alias("name"), F.col("c_mktsegment").alias("district"), F.concat(F.lit("Sokak "), F.col("c_custkey").cast("string")).alias("adres"), F.lit("tel 0276").alias("gsm"))
    item = F.to_json(F.struct(F.array(F.struct(F.col("c").alias("name"), inner.alias("pharmacy"))).alias("data")))
    return c.select("c_custkey", F.explode(pages.nested_json_rows(item)).alias("r")).select("c_custkey", "r.name", "r.district", "r.address", "r.phone")


_KEYS = ["amasya_v1", "generic_auto_v1", "table_auto_v1", "none_v1", "eczaneismi_v1", "hatay_v1"]
_DEFINITION = '<dt class="eczaneismi">{c}</dt><dd class="eczaneadres">x</dd>'
_HTMLS = [_DEFINITION, "<table><tr><th>Eczane</th></tr><tr><td>{c}</td></tr></table>", "<h3>{c} ECZANESİ</h3>" + _TEL, " ", ""]


@query(f"""SELECT c_custkey, strategy, CASE WHEN strategy = 'auto' THEN found WHEN strategy = 'keyed' OR key IS NOT NULL THEN key END AS parser, CAST(CASE WHEN strategy IN ('keyed', 'auto') THEN 1 ELSE 0 END AS INT) AS n, CASE WHEN strategy IN ('keyed', 'auto') THEN c END AS name
FROM (SELECT *, CASE WHEN html = 4 THEN 'empty_html' WHEN serves = html THEN 'keyed' WHEN found IS NOT NULL THEN 'auto' ELSE 'no_match' END AS strategy
  FROM (SELECT *, CASE WHEN key IN ('amasya_v1', 'eczaneismi_v1') THEN 0 WHEN key = 'table_auto_v1' THEN 1 ELSE -1 END AS serves, CASE html WHEN 0 THEN 'eczaneismi_v1' WHEN 1 THEN 'table_auto_v1' END AS found
    FROM (SELECT c_custkey, c, c_custkey % 5 AS html, CASE WHEN c_custkey % 7 < 6 THEN {sql_picked(_KEYS, "(c_custkey % 7)")} END AS key FROM {_NAMED_SQL})))""")
def prs0a_aliases(spark, d):
    k = F.col("c_custkey")
    found = pages.dispatch(_named_customers(spark, d).withColumn("html", F.element_at(F.array(*[_page(x) for x in _HTMLS]), (k % 5 + 1).cast("int"))), F.when(k % 7 < 6, F.element_at(F.array(*map(F.lit, _KEYS)), (k % 7 + 1).cast("int"))))
    return found.select("c_custkey", "strategy", "parser", F.size("rows").alias("n"), F.get("rows", F.lit(0))["name"].alias("name"))


_PLACE = ["table_auto_v1", "inline_box_v1", "osmaniye_eo_v1"]
_PLACES = [  # begin of a page, a card, end
    ("<table><tr><th>Eczane</th><th>Semt</th><th>Telefon</th></tr>", "<tr><td>{c}</td><td>{s}</td><td>0232 {n}</td></tr>", "</table>"),
    ("", '<div data-name="{c}" data-district="{s}"><p>Sokak <a href="tel:0232 {n}">0232 {n}</a></p></div>', ""),
    ("", '<div class="nobet-kart"><h4><strong>{c}</strong> - {s}</h4>' + _TEL + "<hr>", ""),
]


@query(f"""SELECT c_nationkey, page, 'auto' AS strategy, {sql_picked(_PLACE, "(c_nationkey % 3)")} AS parser, CASE WHEN c_nationkey % 3 = 0 THEN c WHEN c_nationkey % 3 = 1 THEN c ELSE c END AS name, s AS district, CASE WHEN c_nationkey % 3 = 1 THEN 'Sokak' ELSE '' END AS address, '0232 ' || n AS phone, CAST(NULL AS DOUBLE) AS lat, CAST(NULL AS DOUBLE) AS lng
FROM (SELECT *, CAST(c_custkey // 1000 AS BIGINT) AS page FROM {_NAMED_SQL})""")
def prs0_dispatch(spark, d):
    """Pages of places, of up to a thousand customers of a nation each, in three layouts, through the parsers."""
    kind = (F.col("c_nationkey") % 3 + 1).cast("int")
    part = lambda k: F.element_at(F.array(*[_page(x[k]) for x in _PLACES]), kind)
    c = dealt(_named_customers(spark, d).withColumn("page", F.floor(F.col("c_custkey") / 1000)), "c_nationkey", "page")
    body = c.groupBy("c_nationkey", "page").agg(F.array_join(F.array_sort(F.collect_list(part(1))), "").alias("body"))
    edges = body.select("*", F.lit("").alias("c"), F.lit("").alias("s"), F.lit("").alias("n"))
    return pages.exploded(pages.dispatch(edges.select("c_nationkey", "page", F.concat(part(0), "body", part(2)).alias("html"))).drop("html"))


# lists on other pages
_LIST_LINK = r"https?://[a-z]+\.lists\.example/list/\d+"
_LISTED = """(SELECT page_id, unnest(list_distinct(CASE page_id % 4 WHEN 0 THEN ['https://a.lists.example/list/' || (page_id % 37), 'https://a.lists.example/list/' || (page_id % 37), 'https://b.lists.example/list/' || (page_id % 41)]
  WHEN 1 THEN ['https://a.lists.example/list/' || (page_id % 43)] WHEN 2 THEN ['https://a.lists.example/list/9999'] ELSE [] END)) AS url FROM pages)"""
_ON_LIST = "(SELECT 'https://' || CASE WHEN c_custkey % 2 = 0 THEN 'a' ELSE 'b' END || '.lists.example/list/' || (c_custkey % 50) AS url, replace(c_name, '#', ' ') AS name FROM customer WHERE c_custkey % 7 > 0)"


def _linking(spark, d) -> tuple[DataFrame, DataFrame]:
    """The given pages, with links to lists put before their html, and the lists' pages, of customers."""
    k, n = F.col("page_id"), lambda m: (F.col("page_id") % m).cast("string")
    frame = lambda host, x: F.concat(F.lit(f'<iframe src="https://{host}.lists.example/list/'), x, F.lit('"></iframe>'))
    links = F.when(k % 4 == 0, F.concat(frame("a", n(37)), frame("b", n(41)), frame("a", n(37)))).when(k % 4 == 1, frame("a", n(43))).when(k % 4 == 2, frame("a", F.lit("9999"))).otherwise("")
    start = table(spark, d, "pages").select("page_id", F.concat(links, F.coalesce("html", F.lit(""))).alias("html"))
    line = F.concat(F.lit('<a href="https://maps.google.com/?q=1" style="font-weight:bold">GECE: '), F.replace("c_name", F.lit("#"), F.lit(" ")), F.lit("</a>"))
    c = table(spark, d, "customer").where("c_custkey % 7 > 0")
    url = F.concat(F.lit("https://"), F.when(F.col("c_custkey") % 2 == 0, "a").otherwise("b"), F.lit(".lists.example/list/"), (F.col("c_custkey") % 50).cast("string"))
    lists = c.groupBy(url.alias("url"), F.floor(F.col("c_custkey") / 10_000).alias("part")).agg(F.array_join(F.array_sort(F.collect_list(line)), "").alias("html"))
    return start, lists.select("url", "html")


@query(f"SELECT page_id, l.url, name FROM {_LISTED} l JOIN {_ON_LIST} o ON o.url = l.url")
def src5_linked_lists(spark, d):
    start, lists = _linking(spark, d)
    return linked.rows(start, lists, "page_id", _LIST_LINK, pages.map_links).select("page_id", "url", "name")


@query(f"SELECT page_id, CASE WHEN n = 0 THEN 'no_links' WHEN lost > 0 THEN 'missing_pages' END AS error, n, lost FROM (SELECT page_id, count(l.url) AS n, count_if(l.url IS NOT NULL AND l.url NOT IN (SELECT url FROM {_ON_LIST})) AS lost FROM pages LEFT JOIN {_LISTED} l USING (page_id) GROUP BY page_id) WHERE n = 0 OR lost > 0")
def src5_link_errors(spark, d):
    start, lists = _linking(spark, d)
    return linked.errors(start, lists, "page_id", _LIST_LINK)


# feeds
_FEED_DAY = "2024-01-31"


def _feed_tables(spark, d) -> tuple[DataFrame, DataFrame]:
    n, c, o = (table(spark, d, t) for t in ("nation", "customer", "orders"))
    last = c.join(o, c["c_custkey"] == o["o_custkey"]).where("c_nationkey % 4 > 0").groupBy(F.col("c_nationkey").alias("n_nationkey")).agg(F.max("o_orderdate").alias("changed"))
    cities = n.join(last, "n_nationkey", "left").select("n_nationkey", text.slugify(F.col("n_name")).alias("city"), "changed")
    places = c.select("c_nationkey", text.slugify(F.col("c_name")).alias("place")).join(cities, F.col("c_nationkey") == F.col("n_nationkey"))
    return cities, places


def _urlset_sql(rows: str, size: int) -> str:
    """SQL for the pages of a feed. rows: loc, day, freq, priority, place (from 1)."""
    entry = "'  <url>' || chr(10) || '    <loc>https://x.example' || loc || '</loc>' || chr(10) || '    <lastmod>' || day || '</lastmod>' || chr(10) || '    <changefreq>' || freq || '</changefreq>' || chr(10) || '    <priority>' || priority || '</priority>' || chr(10) || '  </url>'"
    return f"""SELECT CAST((place - 1) // {size} + 1 AS INT) AS page, '<?xml version="1.0" encoding="UTF-8"?>' || chr(10) || '<urlset xmlns="http://www.sitemaps.org/schemas/sitemap/0.9">' || chr(10) || string_agg({entry}, chr(10) ORDER BY place) || chr(10) || '</urlset>' || chr(10) AS xml FROM ({rows}) GROUP BY 1"""


_CITIES_SQL = f"(SELECT n_nationkey, {SLUG.format('n_name')} AS city, strftime(coalesce(max(o_orderdate) FILTER (WHERE n_nationkey % 4 > 0), TIMESTAMP '{_FEED_DAY}'), '%Y-%m-%d') AS day FROM nation LEFT JOIN customer ON c_nationkey = n_nationkey LEFT JOIN orders ON o_custkey = c_custkey GROUP BY ALL)"


@query(_urlset_sql(f"SELECT '/list/' || city AS loc, day, 'hourly' AS freq, '0.9' AS priority, row_number() OVER (ORDER BY city) AS place FROM {_CITIES_SQL}", 1000))
def or22_cities(spark, d):
    cities, _ = _feed_tables(spark, d)
    return reports.feed_pages(cities, [F.col("city")], F.concat(F.lit("/list/"), "city"), F.col("changed"), _FEED_DAY, "hourly", "0.9", 1000, "https://x.example").select("page", "xml")


@query(_urlset_sql(f"SELECT '/list/' || city || '/' || {SLUG.format('c_name')} AS loc, day, 'hourly' AS freq, '0.8' AS priority, row_number() OVER (ORDER BY city, {SLUG.format('c_name')}) AS place FROM customer JOIN {_CITIES_SQL} ON c_nationkey = n_nationkey", 1000))
def or22_places(spark, d):
    """Pages of a thousand each, in the order of city and place."""
    _, places = _feed_tables(spark, d)
    return reports.feed_pages(places, [F.col("city"), F.col("place")], F.concat(F.lit("/list/"), "city", F.lit("/"), "place"), F.col("changed"), _FEED_DAY, "hourly", "0.8", 1000, "https://x.example").select("page", "xml")


@query(_urlset_sql(f"SELECT '/list/' || city AS loc, '{_FEED_DAY}' AS day, 'hourly' AS freq, '0.9' AS priority, row_number() OVER (ORDER BY city) AS place FROM {_CITIES_SQL}", 1000))
def or22_fallback(spark, d):
    """Without a table of changes all cities count as changed today."""
    cities, _ = _feed_tables(spark, d)
    return reports.feed_pages(reports.unchanged(cities.select("city")), [F.col("city")], F.concat(F.lit("/list/"), "city"), F.col("changed"), _FEED_DAY, "hourly", "0.9", 1000, "https://x.example").select("page", "xml")


@query(_urlset_sql(f"SELECT '/part/' || p_partkey AS loc, strftime(DATE '1992-01-01' + p_partkey::INT % 3000, '%Y-%m-%d') AS day, 'weekly' AS freq, CASE WHEN p_partkey % 3000 > 2800 THEN '0.7' ELSE '0.5' END AS priority, row_number() OVER (ORDER BY p_partkey % 3000 DESC, p_partkey) AS place FROM part WHERE p_partkey % 5 > 0", 5000))
def or22_posts(spark, d):
    """Published ones, the latest first; those of the last days count more."""
    p = table(spark, d, "part").where("p_partkey % 5 > 0").select("p_partkey", (F.lit("1992-01-01").cast("date") + (F.col("p_partkey") % 3000).cast("int")).cast("timestamp").alias("published"))
    weight = F.when(F.col("p_partkey") % 3000 > 2800, "0.7").otherwise("0.5")
    return reports.feed_pages(p, [F.desc("published"), F.col("p_partkey")], F.concat(F.lit("/part/"), F.col("p_partkey").cast("string")), F.col("published"), _FEED_DAY, "weekly", weight, 5000, "https://x.example").select("page", "xml")


@query(f"""WITH p AS (SELECT greatest(1, (count(*) + 999) // 1000) AS n FROM customer), names AS (SELECT 0 AS k, 'static' AS name UNION ALL SELECT 1, 'cities' UNION ALL SELECT 1 + k, 'places' || CASE WHEN k > 1 THEN '-' || k ELSE '' END FROM p, LATERAL (SELECT unnest(range(1, n + 1)) AS k))
  SELECT '<?xml version="1.0" encoding="UTF-8"?>' || chr(10) || '<sitemapindex xmlns="http://www.sitemaps.org/schemas/sitemap/0.9">' || chr(10) || string_agg('  <sitemap>' || chr(10) || '    <loc>https://x.example/sitemap-' || name || '.xml</loc>' || chr(10) || '    <lastmod>{_FEED_DAY}</lastmod>' || chr(10) || '  </sitemap>', chr(10) ORDER BY k) || chr(10) || '</sitemapindex>' || chr(10) AS xml FROM names""")
def or22_index(spark, d):
    return reports.feed_index(table(spark, d, "customer"), ["static", "cities"], "places", 1000, _FEED_DAY, "https://x.example")


# tables that change in versions
_PLACES_BATCH = "c_custkey % 2 = 0"


@query(ORACLE_SQL["snk1_upsert_places"])
def snk1_incremental(spark, d):
    """The same upsert into a bucketed table, of which only the named buckets are written again."""
    c = table(spark, d, "customer").select(F.col("c_custkey").alias("ord"), F.col("c_nationkey").alias("district_id"), F.col("c_name").alias("normalized_name"))
    none = F.lit(None).cast("double")
    old = c.where("ord % 3 <> 0").select("district_id", "normalized_name", F.col("normalized_name").alias("canonical_name"), F.lit("old").alias("address"), F.lit("p").alias("phone"), F.lit(1.0).alias("lat"), none.alias("lng"), F.lit(False).alias("is_active"))
    new = c.where("ord % 2 = 0").withColumns({"canonical_name": F.concat(F.lit("New "), "normalized_name"), "address": F.when(F.col("ord") % 4 == 0, "").otherwise("new"), "phone": F.lit(""), "lat": F.lit(2.0), "lng": none})
    store = stores.KeyedTable(spark, new_folder(spark, "places"), ["district_id", "normalized_name"], 16)
    store.create(old)
    for part in (new.where("ord % 4 = 0"), new.where("ord % 4 = 2")):
        store.merge(part, upsert.upsert_places)
    return store.read()


@query(ORACLE_SQL["snk2_upsert_duties"])
def snk2_incremental(spark, d):
    o = table(spark, d, "orders").select(F.col("o_custkey").alias("place_id"), F.to_date("o_orderdate").alias("duty_date"), F.col("o_orderkey").alias("ord"), (F.col("o_orderkey") % 100).alias("confidence"), (F.col("o_orderkey") % 7).alias("district_id"))
    old = o.where("ord % 2 = 1").groupBy("place_id", "duty_date").agg(F.max("confidence").alias("confidence"), F.count("*").alias("sources"), F.max_by("district_id", "ord").alias("district_id"), F.lit(True).alias("is_degraded"))
    store = stores.KeyedTable(spark, new_folder(spark, "duties"), ["place_id", "duty_date"], 16)
    store.create(old)
    store.merge(o.where("ord % 2 = 0"), upsert.upsert_duties)
    return store.read()


# a catalog over sources and endpoints: suppliers are provinces, every thirteenth is missing
def _sync_tables(spark, d) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    s = table(spark, d, "supplier").select(F.col("s_suppkey").alias("k"))
    n, text_of = F.col("k"), lambda p, x: F.concat(F.lit(p), x.cast("string"))
    catalog_ = s.where("k % 11 <> 0").select(text_of("s", n).alias("code"), text_of("src ", n % 5).alias("source_name"), F.element_at(F.array(*map(F.lit, ["chamber_html", "third_party_html", "json_api", "other"])), (n % 4 + 1).cast("int")).alias("official_type"), text_of("https://x/", n % 7).alias("base_url"), text_of("https://x/", n).alias("official_url"), F.when(n % 2 == 0, "html").otherwise("json").alias("format"), text_of("p", n % 4).alias("parser_key"))
    provinces = s.where("k % 13 <> 0").select(n.alias("id"), text_of("S", n).alias("slug"))
    source = lambda rows, id_, name: rows.select(id_.alias("id"), n.alias("province_id"), name.alias("name"), F.lit("manual").alias("type"), F.lit(1).alias("authority_weight"), F.lit("old").alias("base_url"), F.lit(False).alias("enabled"))
    sources = source(s.where("k % 3 <> 0"), n * 2, text_of("src ", n % 5)).unionByName(source(s.where("k % 4 = 0"), n * 2 + 1, F.lit("other")))
    endpoint = lambda rows, id_, of, url, first: rows.select(id_.alias("id"), of.alias("source_id"), url.alias("endpoint_url"), F.lit("xml").alias("format"), F.lit("old").alias("parser_key"), first.alias("is_primary"), F.lit("@daily").alias("poll_cron"), F.lit(False).alias("enabled"))
    endpoints = endpoint(s.where("k % 3 = 1"), n * 3, n * 2, text_of("https://x/", n), n % 2 == 0)
    endpoints = endpoints.unionByName(endpoint(s.where("k % 4 = 0"), n * 3 + 1, n * 2 + 1, text_of("https://o/", n), F.lit(True)))
    endpoints = endpoints.unionByName(endpoint(s.where("k % 5 = 0 and k % 3 <> 0"), n * 3 + 2, n * 2, text_of("https://old/", n), F.lit(True)))
    return catalog_, provinces, sources, endpoints


_SYNC = """WITH c AS (SELECT s_suppkey AS k, 's' || s_suppkey AS code, 'src ' || (s_suppkey % 5) AS name, CASE s_suppkey % 4 WHEN 0 THEN 'pharmacists_chamber' WHEN 1 THEN 'health_directorate' WHEN 2 THEN 'pharmacists_chamber' ELSE 'manual' END AS type, CASE s_suppkey % 4 WHEN 0 THEN 90 WHEN 1 THEN 85 WHEN 2 THEN 90 ELSE 70 END AS weight,
    'https://x/' || (s_suppkey % 7) AS base_url, 'https://x/' || s_suppkey AS url, CASE WHEN s_suppkey % 2 = 0 THEN 'html' ELSE 'json' END AS format, 'p' || (s_suppkey % 4) AS parser_key FROM supplier WHERE s_suppkey % 11 <> 0 AND s_suppkey % 13 <> 0),
  s AS (SELECT s_suppkey * 2 AS id, s_suppkey AS province_id, 'src ' || (s_suppkey % 5) AS name FROM supplier WHERE s_suppkey % 3 <> 0 UNION ALL SELECT s_suppkey * 2 + 1, s_suppkey, 'other' FROM supplier WHERE s_suppkey % 4 = 0),
  e AS (SELECT s_suppkey * 3 AS id, s_suppkey * 2 AS source_id, 'https://x/' || s_suppkey AS url, s_suppkey % 2 = 0 AS is_primary FROM supplier WHERE s_suppkey % 3 = 1 UNION ALL SELECT s_suppkey * 3 + 1, s_suppkey * 2 + 1, 'https://o/' || s_suppkey, true FROM supplier WHERE s_suppkey % 4 = 0
    UNION ALL SELECT s_suppkey * 3 + 2, s_suppkey * 2, 'https://old/' || s_suppkey, true FROM supplier WHERE s_suppkey % 5 = 0 AND s_suppkey % 3 <> 0),
  a AS (SELECT c.*, s.id AS old_source, coalesce(s.id, (SELECT max(id) FROM s) + row_number() OVER (PARTITION BY s.id IS NULL ORDER BY code)) AS source_id FROM c LEFT JOIN s ON s.province_id = c.k AND s.name = c.name),
  p AS (SELECT a.*, e.id AS old_endpoint, coalesce(e.id, (SELECT max(id) FROM e) + row_number() OVER (PARTITION BY e.id IS NULL ORDER BY code)) AS endpoint_id FROM a LEFT JOIN e ON e.source_id = a.source_id AND e.url = a.url),
  s2 AS (SELECT coalesce(p.source_id, s.id) AS id, coalesce(p.k, s.province_id) AS province_id, coalesce(p.name, s.name) AS name, coalesce(p.type, 'manual') AS type, coalesce(p.weight, 1) AS authority_weight, coalesce(p.base_url, 'old') AS base_url, p.k IS NOT NULL AS enabled FROM s FULL JOIN p ON p.source_id = s.id),
  e2 AS (SELECT coalesce(p.endpoint_id, e.id) AS id, coalesce(p.source_id, e.source_id) AS source_id, coalesce(p.url, e.url) AS endpoint_url, coalesce(p.format, 'xml') AS format, coalesce(p.parser_key, 'old') AS parser_key, CASE WHEN p.k IS NOT NULL THEN true ELSE e.is_primary END AS was, CASE WHEN p.k IS NULL THEN '@daily' ELSE '*/30 * * * *' END AS poll_cron, p.k IS NOT NULL AS enabled FROM e FULL JOIN p ON p.endpoint_id = e.id),
  e3 AS (SELECT e2.*, was AND coalesce(own.endpoint_id <> e2.id, false) AS loses FROM e2 LEFT JOIN s2 ON s2.id = e2.source_id LEFT JOIN p own ON own.k = s2.province_id)"""


@query(f"{_SYNC} SELECT id, province_id, name, type, authority_weight, base_url, enabled FROM s2")
def snk8_sources(spark, d):
    return sync.synced(*_sync_tables(spark, d))[0]


@query(f"{_SYNC} SELECT id, source_id, endpoint_url, format, parser_key, was AND NOT loses AS is_primary, poll_cron, enabled FROM e3")
def snk8_endpoints(spark, d):
    """Through both tables written and read as one version."""
    new_sources, new_endpoints, _ = sync.synced(*_sync_tables(spark, d))
    both = stores.TableSet(spark, new_folder(spark, "sources"))
    both.write({"sources": new_sources, "endpoints": new_endpoints})
    return both.read("endpoints")


@query(f"""{_SYNC} SELECT (SELECT count(*) FROM supplier WHERE s_suppkey % 11 <> 0) AS target_count, count(*) AS synced_count, count_if(old_source IS NULL) AS created_sources, count_if(old_source IS NOT NULL) AS updated_sources, count_if(old_endpoint IS NULL) AS created_endpoints, count_if(old_endpoint IS NOT NULL) AS updated_endpoints,
  (SELECT coalesce(string_agg(code, ',' ORDER BY code), '') FROM (SELECT 's' || s_suppkey AS code FROM supplier WHERE s_suppkey % 11 <> 0 AND s_suppkey % 13 = 0)) AS missing_provinces, (SELECT count_if(loses) FROM e3) AS demoted_primary_endpoints FROM p""")
def snk8_summary(spark, d):
    return sync.synced(*_sync_tables(spark, d))[2]


def _endpoints_to_override(spark, d) -> tuple[DataFrame, DataFrame]:
    k = F.col("p_partkey")
    n = k.cast("string")
    p = table(spark, d, "part").select(k.alias("id"), n.alias("code"), F.when(k % 3 == 0, F.concat(F.lit("https://old/"), n)).otherwise(F.concat(F.lit("https://x/"), n)).alias("endpoint_url"), F.when(k % 4 == 0, "a").otherwise("b").alias("parser_key"), F.lit("html").alias("format"), (k % 2 == 0).alias("is_primary"))
    entries = table(spark, d, "part").where("p_partkey % 10 <> 7").select(n.alias("code"), F.concat(F.lit("https://x/"), n).alias("official_url"), F.lit("b").alias("parser_key"), F.when(k % 25 == 1, "json").otherwise("html").alias("format"))
    return p, entries


@query("SELECT p_partkey AS id, p_partkey::VARCHAR AS code, CASE WHEN p_partkey % 10 = 7 AND p_partkey % 3 = 0 THEN 'https://old/' ELSE 'https://x/' END || p_partkey AS endpoint_url, CASE WHEN p_partkey % 10 = 7 AND p_partkey % 4 = 0 THEN 'a' ELSE 'b' END AS parser_key, CASE WHEN p_partkey % 10 <> 7 AND p_partkey % 25 = 1 THEN 'json' ELSE 'html' END AS format, p_partkey % 2 = 0 AS is_primary FROM part")
def prj5_overridden(spark, d):
    return sync.overridden(*_endpoints_to_override(spark, d))[0]


@query("""SELECT id, code, CASE WHEN there THEN 'source_config_drift' ELSE 'source_config_missing' END AS alert_type, 'high' AS severity, CASE WHEN there THEN 'db_source_endpoint_differs_from_catalog' ELSE 'missing_source_catalog_entry:' || code END AS message,
  CASE WHEN there THEN '{' || concat_ws(',', CASE WHEN u THEN '"endpoint_url":{"db":"https://old/' || code || '","config":"https://x/' || code || '"}' END, CASE WHEN p THEN '"parser_key":{"db":"a","config":"b"}' END, CASE WHEN f THEN '"format":{"db":"html","config":"json"}' END) || '}' END AS payload
  FROM (SELECT p_partkey AS id, p_partkey::VARCHAR AS code, p_partkey % 10 <> 7 AS there, p_partkey % 3 = 0 AS u, p_partkey % 4 = 0 AS p, p_partkey % 25 = 1 AS f FROM part) WHERE NOT there OR u OR p OR f""")
def prj5_drift_alerts(spark, d):
    return sync.overridden(*_endpoints_to_override(spark, d))[1]


@query("SELECT n_nationkey, coalesce(nullif(CASE WHEN n_nationkey % 3 = 0 THEN NULL ELSE n_name END, ''), 'Merkez') AS ilce, coalesce(CASE WHEN n_nationkey % 4 > 0 THEN 'kaynak ' || n_regionkey END, 'Bilinmiyor') AS kaynak, coalesce(CASE WHEN n_nationkey % 5 > 0 THEN n_name END, '') AS adres FROM nation")
def prj1_served_row(spark, d):
    k = F.col("n_nationkey")
    n = table(spark, d, "nation").select("n_nationkey", F.when(k % 3 > 0, F.col("n_name")).alias("district"), F.when(k % 4 > 0, F.concat(F.lit("kaynak "), F.col("n_regionkey").cast("string"))).alias("source"), F.when(k % 5 > 0, F.col("n_name")).alias("address"))
    return n.select("n_nationkey", *serving.row_defaults())


@query("SELECT event_id, CAST(ts + INTERVAL 3 HOUR AS DATE) AS day FROM events")
def dt3_fixed_zone_day(spark, d):
    return table(spark, d, "events").select("event_id", numbers.fixed_day(F.col("ts")).alias("day"))
