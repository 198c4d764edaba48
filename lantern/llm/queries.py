"""Queries of the training-data operators on the supplied tables, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lantern.llm import ann, bpe, centroids, gif, html, lm, mixing, neardup, quality, shards, toxicity, turns, word_bpe
from lantern.llm.common import scratch, table

RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
WORDS = public_tokenizers.path("word_bpe_49k.json")


def op1_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.extract_pages(table(spark, sf_dir, "pages"))


def op2_cross_polytope(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return ann.search(vectors, vectors.where("vec_id % 20 = 0"))


def op3_gif_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gif.media_digests(gif.encode_media(table(spark, sf_dir, "documents")))


def op4_weak_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op5_tiered_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shards.sharded(table(spark, sf_dir, "documents"), scratch(spark, "store"), target=64 << 20)


def op6_lsh_forest_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.similarity_join(table(spark, sf_dir, "documents"))


def op7_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.token_digests(table(spark, sf_dir, "documents"), RANKS, public_tokenizers.PATTERN)


def op8_weak_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality(table(spark, sf_dir, "documents"))


def op9_stupid_backoff(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = lm.score(table(spark, sf_dir, "documents"))
    return scored.select("doc_id", "n_tokens", F.round("mean_log_score", 6).alias("mean_log_score"))


def op9_stupid_backoff_whole(spark: SparkSession, sf_dir: str) -> DataFrame:
    """With runs of up to three words."""
    scored = lm.score(table(spark, sf_dir, "documents"), order=3)
    return scored.select("doc_id", "n_tokens", F.round("mean_log_score", 6).alias("mean_log_score"))


def domain() -> Column:
    """The supplied sources have no domains; three are made of their numbers."""
    return F.concat(F.lit("domain"), F.pmod(F.coalesce(F.expr("try_cast(regexp_extract(source, '([0-9]+)', 1) as int)"), F.lit(0)), F.lit(3)))


#: Target weights of the levels; the supplied tables have none. A value that isn't named has weight 1, one of weight 0 is left out.
TARGETS: dict[str, dict[str, float]] = {
    "domain": {"domain0": 1.0, "domain1": 3.0, "domain2": 2.0},
    "lang": {"en": 4.0, "de": 2.0, "fr": 1.5},
    "source": {"src0": 0.5, "src1": 2.0, "src4": 3.0, "src7": 0.0, "src11": 1.5},
}


def _weights(level: str) -> str:
    """SQL for the table of a level's weights."""
    return f"SELECT * FROM (VALUES {', '.join(f"('{k}', CAST({w} AS DOUBLE))" for k, w in TARGETS[level].items())}) AS t({level}, weight)"


def target_weights(spark: SparkSession) -> dict[str, DataFrame]:
    return {level: spark.sql(_weights(level)) for level in TARGETS}


def op10_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """To the target weights."""
    return mixing.mix(table(spark, sf_dir, "documents"), domain(), share=0.8, epochs=2, weights=target_weights(spark))


def op10_source_mixing_equal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """With equal weights."""
    return mixing.mix(table(spark, sf_dir, "documents"), domain(), share=0.8, epochs=2)


def op11_pair_index_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return word_bpe.token_digests(table(spark, sf_dir, "documents"), WORDS)


def op12_annulus_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = centroids.clustered(table(spark, sf_dir, "embeddings"))
    return found.withColumn("centroid_sha256", F.sha2("centroid", 256)).drop("centroid")


def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return turns.repair(turns.damaged(table(spark, sf_dir, "conversations")))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (op1_html_extraction, op2_cross_polytope, op3_gif_media, op4_weak_toxicity, op5_tiered_shards, op6_lsh_forest_join, op7_byte_bpe, op8_weak_quality, op9_stupid_backoff, op9_stupid_backoff_whole, op10_source_mixing, op10_source_mixing_equal, op11_pair_index_bpe, op12_annulus_centroids, op13_conversation_repair)}


def _filled(parent: str, level: str, source: str) -> str:
    """SQL for mixing.filled with equal weights."""
    by = f"PARTITION BY {parent}" if parent else ""
    order = f"{by} ORDER BY CAST(capacity AS DOUBLE), {level}"
    return f"""SELECT * EXCLUDE (lev), LEAST(capacity, GREATEST(0, CAST(FLOOR(lev) AS BIGINT))) AS given FROM (
      SELECT *, MAX((budget - before) / CAST(rest AS DOUBLE)) OVER ({by}) AS lev FROM (
        SELECT *, COALESCE(SUM(capacity) OVER ({order} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before,
          COUNT(*) OVER ({order} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS rest FROM ({source})))"""


_DOMAINS = _filled("", "domain", "SELECT domain, SUM(capacity) AS capacity, (SELECT LEAST(CAST(FLOOR(SUM(tokens) * 0.8) AS BIGINT), SUM(capacity)) FROM leaves) AS budget FROM leaves GROUP BY domain")
_LANGS = _filled("domain", "lang", "SELECT l.domain, l.lang, SUM(l.capacity) AS capacity, ANY_VALUE(d.given) AS budget FROM leaves l JOIN domains d USING (domain) GROUP BY l.domain, l.lang")
_SOURCES = _filled("domain, lang", "source", "SELECT l.domain, l.lang, l.source, l.capacity, l.tokens, g.given AS budget FROM leaves l JOIN langs g USING (domain, lang)")


def _weighted(parent: str, level: str, source: str) -> str:
    """SQL for mixing.filled with the target weights."""
    by = f"PARTITION BY {parent}" if parent else ""
    order = f"{by} ORDER BY CASE WHEN weight > 0 THEN capacity / weight ELSE 0 END, {level}"
    return f"""SELECT * EXCLUDE (lev), LEAST(capacity, GREATEST(0, CAST(FLOOR(COALESCE(lev, 0) * weight) AS BIGINT))) AS given FROM (
      SELECT *, MAX(CASE WHEN rest > 0 THEN (budget - before) / CAST(rest AS DOUBLE) END) OVER ({by}) AS lev FROM (
        SELECT *, COALESCE(SUM(capacity) OVER ({order} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before,
          SUM(weight) OVER ({order} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS rest
        FROM (SELECT s.*, COALESCE(t.weight, 1) AS weight FROM ({source}) s LEFT JOIN ({_weights(level)}) t USING ({level}))))"""


_WEIGHTED = [
    _weighted("", "domain", "SELECT domain, SUM(capacity) AS capacity, (SELECT CAST(FLOOR(SUM(tokens) * 0.8) AS BIGINT) FROM leaves) AS budget FROM leaves GROUP BY domain"),
    _weighted("domain", "lang", "SELECT l.domain, l.lang, SUM(l.capacity) AS capacity, ANY_VALUE(d.given) AS budget FROM leaves l JOIN domains d USING (domain) GROUP BY l.domain, l.lang"),
    _weighted("domain, lang", "source", "SELECT l.domain, l.lang, l.source, l.capacity, l.tokens, g.given AS budget FROM leaves l JOIN langs g USING (domain, lang)"),
]

def _nearest(centroids: str) -> str:
    """SQL for the nearest of 16 centroids, compared with all of them."""
    apart = "list_sum(list_transform(list_zip(x.v, c.v), lambda z: (z[1] - z[2]) * (z[1] - z[2])))"
    return f"SELECT x.vec_id, any_value(x.v) AS v, min({{'d': CAST({apart} AS BIGINT), 'k': c.k}}) AS best FROM kept x, {centroids} c GROUP BY x.vec_id"


def _moved(old: str, assigned: str) -> str:
    means = f"SELECT k, list(CAST(floor(total / n) AS BIGINT) ORDER BY place) AS v FROM (SELECT best.k AS k, place, sum(v[place])::DOUBLE AS total, count(*) AS n FROM {assigned}, (SELECT unnest(range(1, 65)) AS place) GROUP BY best.k, place) GROUP BY k"
    return f"SELECT o.k, coalesce(m.v, o.v) AS v FROM {old} o LEFT JOIN ({means}) m ON m.k = o.k"


_CLUSTERS = f"""
WITH kept AS MATERIALIZED (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(64 * x::DOUBLE) AS BIGINT)) AS v FROM embeddings
  WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = 64),
c0 AS MATERIALIZED (SELECT CAST(row_number() OVER (ORDER BY sha256('1:' || vec_id)) - 1 AS INT) AS k, v FROM kept ORDER BY sha256('1:' || vec_id) LIMIT 16),
a0 AS MATERIALIZED ({_nearest("c0")}), c1 AS MATERIALIZED ({_moved("c0", "a0")}), a1 AS MATERIALIZED ({_nearest("c1")}), c2 AS MATERIALIZED ({_moved("c1", "a1")}),
a2 AS MATERIALIZED ({_nearest("c2")}), c3 AS MATERIALIZED ({_moved("c2", "a2")}), a3 AS MATERIALIZED ({_nearest("c3")})
SELECT vec_id, best.k AS cluster, best.d AS distance, CAST(sum(best.d) OVER (PARTITION BY best.k) AS BIGINT) AS cluster_inertia, CAST(sum(best.d) OVER () AS BIGINT) AS inertia,
  sha256(array_to_string(c3.v, ',')) AS centroid_sha256 FROM a3 JOIN c3 ON c3.k = best.k"""

# the damage's checksum byte by byte and bit by bit, least costs by a recursion over turns, and the repaired lines from the audit
_CRC = "xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(1, length({0}) + 1), lambda i: ascii(substring({0}, i, 1))::BIGINT)), lambda c, b: list_reduce([xor(c, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda t, u: xor(t >> 1, CASE WHEN t & 1 = 1 THEN 3988292384 ELSE 0 END))), 4294967295)"
_STEP = "CASE WHEN {0} = 2 THEN 3 ELSE 2 END"
_WHITE = "\\x20\\x09-\\x0D"
_REPAIR = f"""
WITH RECURSIVE raw AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, {_CRC.format("(coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' '))")} % 20 AS kind FROM conversations),
hurt AS (SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role, CASE kind WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text, unnest(range(CASE kind WHEN 0 THEN 0 WHEN 3 THEN 2 ELSE 1 END)) AS copy FROM raw),
placed AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, sha256(text), copy) AS pos FROM hurt),
d AS MATERIALIZED (SELECT *, role[1] AS initial, CASE WHEN NOT regexp_matches(text, '[^{_WHITE}]') THEN 'blank' WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY pos) > 1 THEN 'duplicate' WHEN NOT regexp_matches(text, '[.!?][{_WHITE}]*$') THEN 'truncated' ELSE '' END AS fault,
  lag(role[1]) OVER (PARTITION BY conv_id ORDER BY pos) AS before FROM placed),
ids AS (SELECT DISTINCT conv_id FROM conversations),
r AS (SELECT conv_id, 0::BIGINT AS pos, state, {{'c': cost, 'a': audit}} AS best FROM ids, (VALUES (0, 0, ''), (2, 2, 'I'), (3, 4, 'II')) AS t(state, cost, audit)
  UNION ALL
  SELECT conv_id, pos, state, min({{'c': cost, 'a': audit}}) AS best FROM (
    SELECT conv_id, pos, CASE n WHEN 0 THEN to_state WHEN 1 THEN {_STEP.format("to_state")} WHEN 2 THEN {_STEP.format("(" + _STEP.format("to_state") + ")")} ELSE {_STEP.format("to_state")} END AS state, cost + 2 * n AS cost, audit || repeat('I', n) AS audit
    FROM (SELECT conv_id, pos, unnest([0, 1, 2, 3]) AS n, way.s AS to_state, way.c AS cost, way.a AS audit FROM (
      SELECT r.conv_id, d.pos, unnest(list_filter([
        {{'s': r.state, 'c': r.best.c + 3, 'a': r.best.a || 'D'}},
        CASE WHEN fault NOT IN ('blank', 'duplicate') THEN {{'s': {_STEP.format("r.state")}, 'c': r.best.c + 2 + CASE WHEN fault = 'truncated' THEN 1 ELSE 0 END, 'a': r.best.a || 'R'}} END,
        CASE WHEN fault NOT IN ('blank', 'duplicate') AND (r.state = 0 AND initial IN ('s', 'u') OR r.state IN (1, 3) AND initial = 'u' OR r.state = 2 AND initial = 'a') THEN {{'s': CASE initial WHEN 's' THEN 1 WHEN 'u' THEN 2 ELSE 3 END, 'c': r.best.c + CASE WHEN fault = 'truncated' THEN 1 ELSE 0 END, 'a': r.best.a || 'K'}} END
      ], lambda x: x IS NOT NULL)) AS way FROM r JOIN d ON d.conv_id IS NOT DISTINCT FROM r.conv_id AND d.pos = r.pos + 1))
  ) GROUP BY conv_id, pos, state),
seen AS (SELECT conv_id, max(turn) - min(turn) + 1 - count(DISTINCT turn) AS gaps, count_if(fault = 'blank') AS blank, count_if(fault = 'duplicate') AS duplicate, count_if(fault = 'truncated') AS truncated, count_if(before IS NOT NULL AND before || initial NOT IN ('su', 'ua', 'au')) AS illegal, max(pos) AS n FROM d GROUP BY conv_id),
least AS (SELECT ids.conv_id, min(r.best) AS best FROM ids LEFT JOIN seen ON seen.conv_id IS NOT DISTINCT FROM ids.conv_id JOIN r ON r.conv_id IS NOT DISTINCT FROM ids.conv_id AND r.pos = coalesce(seen.n, 0) AND r.state IN (0, 3) GROUP BY ids.conv_id),
edits AS (SELECT conv_id, ord, edit, count_if(edit <> 'I') OVER (PARTITION BY conv_id ORDER BY ord) AS pos FROM (SELECT conv_id, unnest(range(1, length(best.a) + 1)) AS ord, best.a[unnest(range(1, length(best.a) + 1))] AS edit FROM least)),
kept AS (SELECT e.conv_id, e.ord, e.edit, d.role, CASE WHEN e.edit = 'I' THEN '' ELSE d.text END AS text, row_number() OVER (PARTITION BY e.conv_id ORDER BY e.ord) - 1 AS q FROM edits e LEFT JOIN d ON d.conv_id IS NOT DISTINCT FROM e.conv_id AND d.pos = e.pos WHERE e.edit <> 'D'),
lines AS (SELECT conv_id, ord, CASE WHEN edit = 'K' THEN role WHEN (q - CASE WHEN first_value(edit = 'K' AND role[1] = 's') OVER w THEN 1 ELSE 0 END) % 2 = 0 THEN 'user' ELSE 'assistant' END || ':' || text AS line FROM kept WINDOW w AS (PARTITION BY conv_id ORDER BY ord)),
whole AS (SELECT conv_id, sha256(string_agg(line, chr(10) ORDER BY ord)) AS digest FROM lines GROUP BY conv_id)
SELECT l.conv_id, CAST(coalesce(gaps, 0) AS BIGINT) AS gaps, CAST(coalesce(blank, 0) AS BIGINT) AS blank, CAST(coalesce(duplicate, 0) AS BIGINT) AS duplicate, CAST(coalesce(truncated, 0) AS BIGINT) AS truncated, CAST(coalesce(illegal, 0) AS BIGINT) AS illegal,
  CAST(l.best.c AS BIGINT) AS cost, l.best.a AS audit, coalesce(digest, sha256('')) AS repaired_sha256
FROM least l LEFT JOIN seen s ON s.conv_id IS NOT DISTINCT FROM l.conv_id LEFT JOIN whole w ON w.conv_id IS NOT DISTINCT FROM l.conv_id"""

ORACLE_SQL: dict[str, str] = {
    "op12_annulus_centroids": _CLUSTERS,
    "op13_conversation_repair": _REPAIR,
    "op9_stupid_backoff": r"""
WITH words AS (SELECT row, doc_id, w, p, LAG(w) OVER (PARTITION BY row ORDER BY p) AS v FROM (
  SELECT row, doc_id, UNNEST(ws) AS w, UNNEST(range(len(ws))) AS p FROM (SELECT row_number() OVER () AS row, doc_id, regexp_extract_all(text, '\S+') AS ws FROM documents WHERE doc_id IS NOT NULL))),
c1 AS (SELECT w, COUNT(*) AS c FROM words GROUP BY w),
c2 AS (SELECT v, w, COUNT(*) AS c FROM words WHERE v IS NOT NULL GROUP BY v, w),
terms AS (
  SELECT words.doc_id, LN(CASE WHEN words.v IS NULL THEN c1.c / CAST((SELECT SUM(c) FROM c1) AS DOUBLE) WHEN c2.c IS NOT NULL THEN c2.c / CAST(cv.c AS DOUBLE)
    ELSE 0.4::DOUBLE * c1.c / (SELECT SUM(c) FROM c1) END) AS x
  FROM words JOIN c1 ON c1.w = words.w LEFT JOIN c1 cv ON cv.w = words.v LEFT JOIN c2 ON c2.v = words.v AND c2.w = words.w)
SELECT d.doc_id, CAST(COUNT(x) AS BIGINT) AS n_tokens, ROUND(SUM(x) / NULLIF(COUNT(x), 0), 6) AS mean_log_score
FROM (SELECT DISTINCT doc_id FROM documents WHERE doc_id IS NOT NULL) d LEFT JOIN terms USING (doc_id) GROUP BY d.doc_id""",
    "op9_stupid_backoff_whole": r"""
WITH words AS (SELECT doc_id, w, p, LAG(w) OVER r AS v, LAG(w, 2) OVER r AS u FROM (
  SELECT row, doc_id, UNNEST(ws) AS w, UNNEST(range(len(ws))) AS p FROM (SELECT row_number() OVER () AS row, doc_id, regexp_extract_all(text, '\S+') AS ws FROM documents WHERE doc_id IS NOT NULL))
  WINDOW r AS (PARTITION BY row ORDER BY p)),
c1 AS (SELECT w, COUNT(*) AS c FROM words GROUP BY w),
c2 AS (SELECT v, w, COUNT(*) AS c FROM words WHERE v IS NOT NULL GROUP BY v, w),
c3 AS (SELECT u, v, w, COUNT(*) AS c FROM words WHERE u IS NOT NULL GROUP BY u, v, w),
terms AS (
  SELECT x.doc_id, LN(CASE WHEN c3.c IS NOT NULL THEN c3.c / CAST(cuv.c AS DOUBLE)
    WHEN c2.c IS NOT NULL THEN CASE WHEN x.u IS NULL THEN 1 ELSE 0.4::DOUBLE END * c2.c / cv.c
    ELSE CASE WHEN x.v IS NULL THEN 1 WHEN x.u IS NULL THEN 0.4::DOUBLE ELSE 0.4::DOUBLE * 0.4::DOUBLE END * c1.c / (SELECT SUM(c) FROM c1) END) AS s
  FROM words x JOIN c1 ON c1.w = x.w LEFT JOIN c1 cv ON cv.w = x.v LEFT JOIN c2 ON c2.v = x.v AND c2.w = x.w
    LEFT JOIN c2 cuv ON cuv.v = x.u AND cuv.w = x.v LEFT JOIN c3 ON c3.u = x.u AND c3.v = x.v AND c3.w = x.w)
SELECT d.doc_id, CAST(COUNT(s) AS BIGINT) AS n_tokens, ROUND(SUM(s) / NULLIF(COUNT(s), 0), 6) AS mean_log_score
FROM (SELECT DISTINCT doc_id FROM documents WHERE doc_id IS NOT NULL) d LEFT JOIN terms USING (doc_id) GROUP BY d.doc_id""",
    "op10_source_mixing_equal": f"""
WITH base AS (
  SELECT doc_id, 'domain' || (COALESCE(TRY_CAST(regexp_extract(source, '([0-9]+)', 1) AS INT), 0) % 3) AS domain,
    COALESCE(lang, '') AS lang, COALESCE(source, '') AS source, CAST(COALESCE(len(regexp_extract_all(text, '\\S+')), 0) AS BIGINT) AS tokens
  FROM documents WHERE doc_id IS NOT NULL),
leaves AS (SELECT domain, lang, source, SUM(tokens) AS tokens, SUM(tokens) * 2 AS capacity FROM base GROUP BY ALL),
domains AS ({_DOMAINS}), langs AS ({_LANGS}), sources AS ({_SOURCES}),
plan AS (SELECT domain, lang, source, given // tokens AS whole, given % tokens AS rest FROM sources WHERE given > 0),
drawn AS (SELECT b.*, whole, rest, SUM(b.tokens) OVER (PARTITION BY domain, lang, source ORDER BY md5('1:' || whole || ':' || doc_id), doc_id
  ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS running FROM base b JOIN plan USING (domain, lang, source))
SELECT doc_id, domain, lang, source, tokens, CAST(whole + CASE WHEN running <= rest THEN 1 ELSE 0 END AS INT) AS copies
FROM drawn WHERE whole > 0 OR running <= rest""",
    "op10_source_mixing": f"""
WITH base AS (
  SELECT doc_id, 'domain' || (COALESCE(TRY_CAST(regexp_extract(source, '([0-9]+)', 1) AS INT), 0) % 3) AS domain,
    COALESCE(lang, '') AS lang, COALESCE(source, '') AS source, CAST(COALESCE(len(regexp_extract_all(text, '\\S+')), 0) AS BIGINT) AS tokens
  FROM documents WHERE doc_id IS NOT NULL),
leaves AS (SELECT l.domain, l.lang, l.source, tokens, CASE WHEN LEAST(COALESCE(dw.weight, 1), COALESCE(lw.weight, 1), COALESCE(sw.weight, 1)) > 0 THEN tokens * 2 ELSE 0 END AS capacity
  FROM (SELECT domain, lang, source, SUM(tokens) AS tokens FROM base GROUP BY ALL) l
  LEFT JOIN ({_weights("domain")}) dw USING (domain) LEFT JOIN ({_weights("lang")}) lw USING (lang) LEFT JOIN ({_weights("source")}) sw USING (source)),
domains AS ({_WEIGHTED[0]}), langs AS ({_WEIGHTED[1]}), sources AS ({_WEIGHTED[2]}),
plan AS (SELECT domain, lang, source, given // tokens AS whole, given % tokens AS rest FROM sources WHERE given > 0),
drawn AS (SELECT b.*, whole, rest, SUM(b.tokens) OVER (PARTITION BY domain, lang, source ORDER BY md5('1:' || whole || ':' || doc_id), doc_id
  ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS running FROM base b JOIN plan USING (domain, lang, source))
SELECT doc_id, domain, lang, source, tokens, CAST(whole + CASE WHEN running <= rest THEN 1 ELSE 0 END AS INT) AS copies
FROM drawn WHERE whole > 0 OR running <= rest""",
}
