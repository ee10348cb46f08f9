"""Queries p2, p3, p4 and p6 over the store's tables, with the SQL that checks them."""

from __future__ import annotations

from pyspark.sql import functions as F

from chunklake.common import epoch_day, table
from chunklake.operators import changes, compaction, orphans, rolling

FIRST, LAST = "2025-02-01", "2025-06-30"


def _orphans(spark, d):
    found = orphans.find_orphans(orphans.store_references(spark, d), orphans.store_parents(spark, d))
    return found.select("source_table", "row_id", "field", "state", "at").distinct()


def p2_found(spark, d):
    return _orphans(spark, d).select("source_table", "row_id", "field", "state")


def p2_report(spark, d):
    return (
        _orphans(spark, d).groupBy("source_table", "field", "state", epoch_day(F.col("at") / 1e6).alias("day_no"))
        .agg(F.count(F.lit(1)).alias("orphans"))
        .select("source_table", "field", "state", F.date_format(F.date_from_unix_date("day_no"), "yyyy-MM-dd").alias("day"), "orphans")
    )


def _states(spark, d, entity):
    c = rolling.amount_versions(table(spark, d, "recent"))
    return rolling.rolling_state(c, entity, FIRST, LAST)


def p3_found(spark, d):
    s = _states(spark, d, ["name"])
    return s.filter("total_7 = 0 and total_30 > 0").select("name", F.date_format("day", "yyyy-MM-dd").alias("day"))


def p3_rolling(spark, d):
    c = rolling.amount_versions(table(spark, d, "recent"))
    # all names together are one entity more; its amounts are united per day before anything else
    scopes = c.withColumn("scope", F.lit("name")).unionByName(c.withColumn("scope", F.lit("all")).withColumn("name", F.lit(None).cast("string")))
    both = rolling.rolling_state(scopes, ["scope", "name"], FIRST, LAST)
    return both.select(
        "scope", "name", F.date_format("day", "yyyy-MM-dd").alias("day"), "total_7", F.round("mean_7", 6).alias("mean_7"),
        "total_30", F.round("mean_30", 6).alias("mean_30"), F.col("version").cast("bigint").alias("version"),
    )


def p4_found(spark, d):
    folder = compaction.compact(table(spark, d, "blobs"))
    return compaction.compacted(spark, folder).select("hash", "raw_len")


def p6_found(spark, d):
    return changes.registry_state(table(spark, d, "log"))


QUERIES = {f.__name__: f for f in (p2_found, p2_report, p3_found, p3_rolling, p4_found, p6_found)}

_K = "nullif(lower(trim({0}, ' \t\r\n')), '')"

#: SQL of the longest chains and their effective statements: (registry, seq, own, prev, st, c, signer)
CHAIN = f"""
WITH RECURSIVE entries AS (
  SELECT registry, seq, {_K.format("prev")} AS prev, any_value(statement ORDER BY received) AS st,
    sha256(concat_ws('|', CAST(seq AS VARCHAR), prev, statement.signature.sig)) AS own
  FROM log WHERE statement.signature.sig IS NOT NULL AND seq IS NOT NULL GROUP BY registry, seq, log.prev, statement.signature.sig
), chain AS (
  SELECT registry, seq, own, prev FROM entries WHERE seq = 0 AND prev = repeat('0', 64)
  UNION ALL SELECT e.registry, e.seq, e.own, e.prev FROM chain c JOIN entries e ON e.registry = c.registry AND e.seq = c.seq + 1 AND e.prev = c.own
), back AS (
  SELECT registry, seq, own, prev FROM (SELECT *, row_number() OVER (PARTITION BY registry ORDER BY seq DESC, own) AS r FROM chain) WHERE r = 1
  UNION ALL SELECT c.registry, c.seq, c.own, c.prev FROM back b JOIN chain c ON c.registry = b.registry AND c.seq = b.seq - 1 AND c.own = b.prev
), effective AS (
  SELECT e.registry, e.seq, e.own, e.prev, e.st, e.st.claim AS c, e.st.signature.key AS signer FROM entries e JOIN back b USING (registry, seq, own)
  QUALIFY row_number() OVER (PARTITION BY e.registry, e.st.signature.sig ORDER BY e.seq) = 1
)"""

_ORPHANS = f"""
WITH refs AS (
  SELECT DISTINCT * FROM (
    SELECT 'receipts' AS source_table, receipt_id AS row_id, 'root' AS field, 'root' AS kind, {_K.format("root")} AS k, time * 1000000 AS ts FROM receipts
    UNION ALL SELECT 'probes', probe_id, 'root', 'root', {_K.format("root")}, t * 1000000 FROM probes
    UNION ALL SELECT 'chunks', chunk_id, 'hash', 'hash', {_K.format("hash")}, epoch_us(packed) FROM chunks
    UNION ALL SELECT 'chunks', chunk_id, 'block_id', 'block', {_K.format("block_id")}, epoch_us(packed) FROM chunks
  ) WHERE k IS NOT NULL
), parents AS (
  SELECT DISTINCT * FROM (
    SELECT 'root' AS kind, {_K.format("root")} AS k, epoch_us(added) AS since, epoch_us(removed) AS until FROM manifests
    UNION ALL SELECT 'block', {_K.format("b")}, epoch_us(added), epoch_us(removed) FROM (SELECT unnest(blocks) AS b, added, removed FROM manifests)
    UNION ALL SELECT 'hash', {_K.format("hash")}, epoch_us(written), epoch_us(removed) FROM blobs WHERE payload IS NOT NULL
    UNION ALL SELECT kind, {_K.format("item_key")}, -4611686018427387904, NULL FROM pinned
  )
), judged AS (
  SELECT source_table, row_id, field, ts,
    coalesce(bool_or(since <= ts AND (until IS NULL OR ts < until)), false) AS there,
    coalesce(bool_or(until <= ts), false) AS gone, coalesce(bool_or(since > ts), false) AS later
  FROM refs LEFT JOIN parents ON refs.kind = parents.kind AND refs.k = parents.k
  GROUP BY ALL
), found AS (
  SELECT source_table, row_id, field, ts, CASE WHEN gone THEN 'deleted' WHEN later THEN 'late' ELSE 'missing' END AS state
  FROM judged WHERE NOT there
)
"""

_ROLLING = f"""
WITH saves AS (SELECT DISTINCT registry, day, name, downloads, saved FROM recent WHERE downloads IS NOT NULL AND day IS NOT NULL),
latest AS (
  SELECT registry, name, day, downloads, count(*) OVER (PARTITION BY registry, name, day) AS version
  FROM saves QUALIFY row_number() OVER (PARTITION BY registry, name, day ORDER BY saved DESC NULLS LAST, downloads DESC) = 1
), amounts AS (
  SELECT 'name' AS scope, name, day, sum(downloads) AS amount, max(version) AS version FROM latest GROUP BY ALL
  UNION ALL SELECT 'all', NULL, day, sum(downloads), max(version) FROM latest GROUP BY ALL
), spine AS (
  SELECT scope, name, CAST(d AS DATE) AS day FROM (SELECT DISTINCT scope, name FROM amounts)
  CROSS JOIN generate_series(TIMESTAMP '{FIRST}', TIMESTAMP '{LAST}', INTERVAL 1 DAY) AS g(d)
), state AS (
  SELECT s.scope, s.name, s.day, CAST(coalesce(sum(a.amount) FILTER (WHERE a.day > s.day - 7), 0) AS BIGINT) AS total_7,
    CAST(coalesce(sum(a.amount), 0) AS BIGINT) AS total_30, CAST(coalesce(max(a.version), 0) AS BIGINT) AS version
  FROM spine s LEFT JOIN amounts a ON s.scope = a.scope AND s.name IS NOT DISTINCT FROM a.name AND a.day BETWEEN s.day - 29 AND s.day
  GROUP BY ALL
)
"""

SQL = {
    "p2_found": _ORPHANS + "SELECT source_table, row_id, field, state FROM found",
    "p2_report": _ORPHANS
    + "SELECT source_table, field, state, strftime(make_timestamp(ts), '%Y-%m-%d') AS day, count(*) AS orphans FROM found GROUP BY ALL",
    "p3_found": _ROLLING + "SELECT name, strftime(day, '%Y-%m-%d') AS day FROM state WHERE scope = 'name' AND total_7 = 0 AND total_30 > 0",
    "p3_rolling": _ROLLING
    + "SELECT scope, name, strftime(day, '%Y-%m-%d') AS day, total_7, round(total_7 / 7, 6) AS mean_7, total_30, round(total_30 / 30, 6) AS mean_30, version FROM state",
    "p4_found": f"SELECT {_K.format('hash')} AS hash, max(raw_len) AS raw_len FROM blobs WHERE payload IS NOT NULL AND removed IS NULL AND {_K.format('hash')} IS NOT NULL GROUP BY 1",
    "p6_found": f"""
{CHAIN}, events AS (
  SELECT registry, 'name' AS item, c.name || '@' || c.rev AS k, '' AS member, seq, true AS up, {_K.format("c.root")} AS v FROM effective WHERE c.kind = 'publish'
  UNION ALL SELECT registry, 'gate', {_K.format("c.root")}, '', seq, c.gated <> '', c.gated FROM effective WHERE c.kind = 'publish' AND c.gated IS NOT NULL
  UNION ALL SELECT registry, 'gate', {_K.format("c.root")}, '', seq, coalesce(trim(c.repo), '') <> '', c.repo FROM effective WHERE c.kind = 'gate'
  UNION ALL SELECT registry, 'owner', split_part(c.name, '/', 1), signer, seq, true, signer FROM effective WHERE c.kind = 'publish' AND c.name IS NOT NULL
    QUALIFY row_number() OVER (PARTITION BY registry, split_part(c.name, '/', 1) ORDER BY seq) = 1
  UNION ALL SELECT registry, 'owner', c.org, c.key, seq, c.kind = 'grant', c.key FROM effective WHERE c.kind IN ('grant', 'revoke')
  UNION ALL SELECT registry, 'blocked', {_K.format("c.hash")}, '', seq, c.kind = 'block', '' FROM effective WHERE c.kind IN ('block', 'unblock')
)
SELECT registry, item, k AS item_key, v AS item_value FROM (
  SELECT *, row_number() OVER (PARTITION BY registry, item, k, member ORDER BY seq DESC) AS r FROM events WHERE k IS NOT NULL AND member IS NOT NULL
) WHERE r = 1 AND up""",
}
