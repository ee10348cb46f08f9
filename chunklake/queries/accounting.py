"""Queries of downloads, receipts, probes and nodes, with SQL.

The board's inputs come from the driver's tables: receipts and probes are the board's own; a lookup is a fetcher's first
receipt for a root (its time is the lookup's, its cap a fixed number of bytes), a node's posts are the probes of it."""

from __future__ import annotations

from pyspark.sql import functions as F

from chunklake.common import key, table, written
from chunklake.functions import scalars as S
from chunklake.operators import accounting as A
from chunklake.queries.problems import _K

AT = 1750000000
TODAY = AT // 86400
CAP = 30_000_000


def _receipts(spark, d):
    r = table(spark, d, "receipts").dropDuplicates(["receipt_id"])
    arrived = F.expr("unix_date(cast(arrived as date)) * 86400L + hour(arrived) * 3600 + minute(arrived) * 60 + second(arrived)")
    return r.select("receipt_id", key("root").alias("root"), "server", "bytes", "fetcher", "time", arrived.alias("arrived")).filter("root is not null and fetcher is not null and bytes is not null")


def _lookups(spark, d):
    r = _receipts(spark, d)
    every = r.select(F.col("fetcher").alias("peer"), "root", F.concat(F.lit("net-"), F.substring("fetcher", -2, 2)).alias("network"), (F.col("time") - 120).alias("t"), F.lit(CAP).cast("bigint").alias("cap"))
    return A.bind_lookups(every)


def _probes(spark, d):
    p = table(spark, d, "probes").dropDuplicates(["probe_id"])
    return p.select("probe_id", "anchor", "node", key("root").alias("root"), "outcome", "t")


def _credits(spark, d):
    return A.credit(A.take_receipts(_receipts(spark, d), _lookups(spark, d)))


def _days(spark, d):
    return A.node_days(_credits(spark, d), A.accepted_probes(_probes(spark, d)))


def _nodes(spark, d):
    posts = _probes(spark, d).select(F.col("node").alias("peer"), F.concat(F.lit("node "), F.substring("node", -4, 4)).alias("name"), F.array(F.coalesce("root", F.lit("none"))).alias("models"), "t")
    return A.register(posts)


def lookups_bound(spark, d):
    return _lookups(spark, d).select("peer", "root", "network", "t")


def receipts_taken(spark, d):
    return A.take_receipts(_receipts(spark, d), _lookups(spark, d)).select("fetcher", "server", "root", "bytes", "time", "day_no")


def receipts_credit(spark, d):
    return _credits(spark, d).select("fetcher", "server", "root", "bytes", "claimed", "credited")


def probes_accepted(spark, d):
    return A.accepted_probes(_probes(spark, d), 3600).select("probe_id", "anchor", "node", "t")


def node_day(spark, d):
    return _days(spark, d)


def node_register(spark, d):
    return _nodes(spark, d).select("peer", "registered", "last_seen", "name", F.array_join("models", ",").alias("models"))


def nodes_held(spark, d):
    return A.held(A.accepted_probes(_probes(spark, d)), AT).select("peer", "root")


def _board(metric):
    def q(spark, d):
        return A.leaderboard(_nodes(spark, d), _days(spark, d), A.held(A.accepted_probes(_probes(spark, d)), AT), metric, 30, AT)

    q.__name__ = f"leaderboard_{metric}"
    return q


def node_history(spark, d):
    return A.history(_nodes(spark, d), _days(spark, d), AT)


def node_page(spark, d):
    return A.node_page(A.history(_nodes(spark, d), _days(spark, d), AT))


def bytes_served(spark, d):
    return A.bytes_served(_days(spark, d), TODAY)


def days_finalized(spark, d):
    """Closed days of every registered node; servers that no probe registered are left out."""
    return A.finalize(written(_days(spark, d), "days"), _nodes(spark, d), TODAY)


def served_by_source(spark, d):
    return A.served_totals(_receipts(spark, d).select(F.col("server").alias("source"), "bytes", F.lit(1).cast("bigint").alias("chunks")))


def rate_limited(spark, d):
    r = _receipts(spark, d).select("receipt_id", F.substring("server", -1, 1).alias("network"), "time")
    return A.rate_limited(r, ["network"], "time", ["receipt_id"]).select("receipt_id", "network", "place")


def _events(spark, d):
    e = table(spark, d, "events")
    t = F.expr("unix_date(cast(ts as date)) * 86400L + hour(ts) * 3600 + minute(ts) * 60 + second(ts)")
    return e.select(F.col("event_type").alias("name"), F.concat(F.lit("10."), (F.col("user_id") % 7).cast("string"), F.lit("."), F.col("user_id").cast("string"), F.lit(".0")).alias("network"), t.alias("t"))


def _event_days(spark, d):
    return A.download_days(A.counted_downloads(_events(spark, d)))


def downloads_daily(spark, d):
    return _event_days(spark, d)


def downloads_of(spark, d):
    return A.downloads_of(_event_days(spark, d), 19750)


def downloads_totals(spark, d):
    return A.download_totals(_event_days(spark, d))


def downloads_retained(spark, d):
    return A.retained(_event_days(spark, d), 19765)


def probes_uptime(spark, d):
    p = A.accepted_probes(_probes(spark, d)).groupBy("node").agg(F.count(F.lit(1)).alias("probes"), F.count_if(F.col("outcome").isNull() | (F.col("outcome") != "down")).alias("answered"))
    return p.select("node", "probes", "answered", F.round(F.col("answered") / F.col("probes"), 6).alias("uptime"))


def networks(spark, d):
    """Addresses made of the whole user_id, so of every user. Ids are below 2^32."""
    u = table(spark, d, "events").select(F.col("user_id").cast("bigint").alias("u")).filter("u is not null").distinct()
    v4 = F.concat_ws(".", *[F.expr(f"cast(shiftright(u, {s}) & 255 as string)") for s in (24, 16, 8, 0)])
    v6 = F.lower(F.concat_ws(":", F.lit("2001"), F.hex(F.expr("shiftright(u, 16) & 65535")), F.hex(F.expr("u & 65535"))))
    ips = u.select(F.explode(F.array(v4, F.concat(F.lit("::ffff:"), v4), F.concat(v6, F.lit("::1")), F.concat(v6, F.lit(":1:2:3:4:5")))).alias("ip"))
    return ips.select("ip", S.network(F.col("ip")).alias("network"))


QUERIES = {
    f.__name__: f
    for f in (
        lookups_bound, receipts_taken, receipts_credit, probes_accepted, node_day, node_register, nodes_held, *map(_board, A.METRICS), node_history,
        node_page, bytes_served, days_finalized, served_by_source, rate_limited, downloads_daily, downloads_of, downloads_totals, downloads_retained,
        networks, probes_uptime,
    )
}

_BASE = f"""
WITH RECURSIVE rc AS (
  SELECT DISTINCT ON (receipt_id) receipt_id, {_K.format("root")} AS root, server, bytes, fetcher, time, CAST(floor(epoch(arrived)) AS BIGINT) AS arrived FROM receipts
), r AS (SELECT * FROM rc WHERE root IS NOT NULL AND fetcher IS NOT NULL AND bytes IS NOT NULL),
lk AS (
  SELECT peer, root, network, t FROM (SELECT fetcher AS peer, root, 'net-' || right(fetcher, 2) AS network, time - 120 AS t FROM r)
  QUALIFY row_number() OVER (PARTITION BY peer, root ORDER BY t, network) = 1
), tk AS (
  SELECT r.fetcher, r.server, r.root, r.bytes, r.time, network, lk.t AS lookup_t, CAST(lk.t // 86400 AS INTEGER) AS day_no
  FROM r JOIN lk ON lk.peer = r.fetcher AND lk.root = r.root
  WHERE arrived - lk.t <= 86400 AND time <= arrived + 600 AND time + 600 >= lk.t AND server <> fetcher
  QUALIFY row_number() OVER (PARTITION BY r.fetcher, r.server, r.root ORDER BY time DESC, arrived, r.bytes DESC) = 1
), cr AS (
  SELECT *, CASE WHEN claimed > {CAP} THEN CAST((CAST(bytes AS HUGEINT) * {CAP}) // claimed AS BIGINT) ELSE bytes END AS credited
  FROM (SELECT *, CAST(sum(bytes) OVER (PARTITION BY fetcher, root, day_no) AS BIGINT) AS claimed FROM tk)
), pr AS (SELECT DISTINCT ON (probe_id) probe_id, anchor, node, {_K.format("root")} AS root, outcome, t FROM probes),
pn AS (SELECT *, row_number() OVER (PARTITION BY anchor, node ORDER BY t, probe_id) AS i FROM pr)
"""


def _walk(gap: int) -> str:
    return f""", walk AS (
  SELECT probe_id, anchor, node, root, outcome, t, i, t AS last, true AS ok FROM pn WHERE i = 1
  UNION ALL SELECT p.probe_id, p.anchor, p.node, p.root, p.outcome, p.t, p.i, CASE WHEN p.t - w.last >= {gap} THEN p.t ELSE w.last END, p.t - w.last >= {gap}
  FROM walk w JOIN pn p ON p.anchor = w.anchor AND p.node = w.node AND p.i = w.i + 1
), ap AS (SELECT * FROM walk WHERE ok)
"""


_DAYS = (
    _BASE
    + _walk(60)
    + """, sa AS (SELECT day_no, server AS peer, CAST(sum(credited) AS BIGINT) AS bytes, count(DISTINCT network) AS downloads FROM cr WHERE credited > 0 GROUP BY ALL),
sb AS (SELECT CAST(t // 86400 AS INTEGER) AS day_no, node AS peer, count(*) AS probes, count(*) FILTER (WHERE outcome IS NULL OR outcome <> 'down') AS answered FROM ap GROUP BY ALL),
days AS (
  SELECT day_no, peer, coalesce(bytes, 0) AS bytes, coalesce(downloads, 0) AS downloads, coalesce(probes, 0) AS probes, coalesce(answered, 0) AS answered
  FROM sa FULL JOIN sb USING (day_no, peer)
), nodes AS (
  SELECT node AS peer, min(t) AS registered, max(t) AS last_seen, 'node ' || right(node, 4) AS name FROM pr GROUP BY node
), hd AS (
  SELECT node AS peer, root FROM ap WHERE outcome = 'held' AND root IS NOT NULL GROUP BY ALL HAVING """
    + f"""{AT} - max(t) < 7 * 86400
), hist AS (
  SELECT n.peer, CAST(g.d AS INTEGER) AS day_no, coalesce(bytes, 0) AS bytes, coalesce(downloads, 0) AS downloads, coalesce(probes, 0) AS probes, coalesce(answered, 0) AS answered, g.d + 2 <= {TODAY} AS signed
  FROM (SELECT peer, unnest(generate_series(greatest(registered // 86400, {TODAY - 89}), {TODAY})) AS d FROM nodes WHERE registered // 86400 <= {TODAY}) g JOIN nodes n USING (peer) LEFT JOIN days ON days.peer = n.peer AND days.day_no = g.d
)
"""
)


def _board_sql(metric: str) -> str:
    a, b = A.METRICS[metric]
    return (
        _DAYS
        + f""", su AS (SELECT peer, sum(bytes) AS b, sum(downloads) AS d, sum(probes) AS p, sum(answered) AS a FROM days WHERE day_no > {TODAY - 30} AND day_no <= {TODAY} GROUP BY peer),
x AS (SELECT n.peer, n.name, CAST(coalesce(b, 0) AS BIGINT) AS bytes, CAST(coalesce(d, 0) AS BIGINT) AS downloads, CASE WHEN p > 0 THEN a / p END AS uptime, coalesce(m, 0) AS models
  FROM nodes n LEFT JOIN su USING (peer) LEFT JOIN (SELECT peer, count(*) AS m FROM hd GROUP BY peer) h USING (peer) WHERE {AT} - last_seen < 7 * 86400)
SELECT *, CAST(row_number() OVER (ORDER BY coalesce(CAST({a} AS DOUBLE), -1) DESC, coalesce(CAST({b} AS DOUBLE), -1) DESC, peer) AS INTEGER) AS rank FROM x"""
    )


_EVENTS = """WITH e AS (SELECT event_type AS name, '10.' || (user_id % 7) || '.' || user_id || '.0' AS network, CAST(floor(epoch(ts) / 86400) AS INTEGER) AS day_no FROM events),
dd AS (SELECT name, day_no, count(DISTINCT network) AS downloads FROM e GROUP BY ALL) """

SQL = {
    "lookups_bound": _BASE + "SELECT peer, root, network, t FROM lk",
    "receipts_taken": _BASE + "SELECT fetcher, server, root, bytes, time, day_no FROM tk",
    "receipts_credit": _BASE + "SELECT fetcher, server, root, bytes, claimed, credited FROM cr WHERE credited > 0",
    "probes_accepted": _BASE + _walk(3600) + "SELECT probe_id, anchor, node, t FROM ap",
    "node_day": _DAYS + "SELECT * FROM days",
    "node_register": _BASE + "SELECT node AS peer, min(t) AS registered, max(t) AS last_seen, 'node ' || right(node, 4) AS name, arg_max(coalesce(root, 'none'), {'t': t, 'r': coalesce(root, 'none')}) AS models FROM pr GROUP BY node",
    "nodes_held": _DAYS + "SELECT * FROM hd",
    **{f"leaderboard_{m}": _board_sql(m) for m in A.METRICS},
    "node_history": _DAYS + "SELECT * FROM hist",
    "node_page": _DAYS + "SELECT peer, CAST(sum(bytes) AS BIGINT) AS bytes, CAST(sum(downloads) AS BIGINT) AS downloads, CAST(sum(probes) AS BIGINT) AS probes, CAST(sum(answered) AS BIGINT) AS answered FROM hist GROUP BY peer",
    "bytes_served": _DAYS + f"SELECT CAST(coalesce(sum(bytes), 0) AS BIGINT) AS bytes_served FROM days WHERE day_no <= {TODAY}",
    "days_finalized": _DAYS + f"""SELECT d.*, t.bytes_served FROM days d JOIN nodes n ON n.peer = d.peer
  JOIN (SELECT day_no, CAST(sum(bytes) AS BIGINT) AS bytes_served FROM days GROUP BY day_no) t ON t.day_no = d.day_no WHERE d.day_no + 2 <= {TODAY}""",
    "served_by_source": _BASE + "SELECT server AS source, CAST(sum(bytes) AS BIGINT) AS bytes, count(*) AS chunks FROM r GROUP BY server",
    "rate_limited": _BASE + "SELECT receipt_id, right(server, 1) AS network, CAST(row_number() OVER (PARTITION BY right(server, 1), time // 3600 ORDER BY time, receipt_id) AS INTEGER) AS place FROM r QUALIFY place <= 10",
    "downloads_daily": _EVENTS + "SELECT * FROM dd",
    "downloads_of": _EVENTS + "SELECT name, CAST(sum(downloads) AS BIGINT) AS total, CAST(coalesce(sum(downloads) FILTER (WHERE day_no > 19720 AND day_no <= 19750), 0) AS BIGINT) AS last_30_days FROM dd GROUP BY name",
    "downloads_totals": _EVENTS + "SELECT day_no, downloads, CAST(sum(downloads) OVER (ORDER BY day_no) AS BIGINT) AS total FROM (SELECT day_no, CAST(sum(downloads) AS BIGINT) AS downloads FROM dd GROUP BY day_no)",
    "downloads_retained": _EVENTS + "SELECT * FROM dd WHERE day_no + 30 > 19765",
    "networks": """WITH u AS (SELECT DISTINCT CAST(user_id AS BIGINT) AS u FROM events WHERE user_id IS NOT NULL),
x AS (SELECT (u >> 24 & 255) || '.' || (u >> 16 & 255) || '.' || (u >> 8 & 255) AS a, u & 255 AS b, '2001:' || printf('%x', u >> 16 & 65535) || ':' || printf('%x', u & 65535) AS c FROM u)
SELECT a || '.' || b AS ip, a || '.0/24' AS network FROM x
UNION ALL SELECT '::ffff:' || a || '.' || b, a || '.0/24' FROM x
UNION ALL SELECT c || '::1', c || '::/48' FROM x
UNION ALL SELECT c || ':1:2:3:4:5', c || '::/48' FROM x""",
    "probes_uptime": _BASE + _walk(60) + "SELECT node, count(*) AS probes, count(*) FILTER (WHERE outcome IS NULL OR outcome <> 'down') AS answered, round(count(*) FILTER (WHERE outcome IS NULL OR outcome <> 'down') / count(*), 6) AS uptime FROM ap GROUP BY node",
}
