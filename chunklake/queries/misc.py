"""Smaller operators: rights at a time, trust, cached records, listings, expiry, metrics, transfer shares; with SQL."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from chunklake.common import key, stored, table
from chunklake.functions import predicates as P
from chunklake.functions import scalars as S
from chunklake.operators import accounting as A
from chunklake.operators import planning as L
from chunklake.operators import registry as R
from chunklake.queries import accounting as Q
from chunklake.queries.planning import _CH, _chunks
from chunklake.queries.problems import _K, CHAIN


def _claims(spark, d):
    return stored(table(spark, d, "log"), "claims", R.claims)


def operator_rights(spark, d):
    """Whether the signer of each block, unblock, gate and anchors statement acted for the operator then: as of the latest delegation before it."""
    c = _claims(spark, d)
    root = c.filter("kind = 'anchors'").groupBy("registry").agg(F.min_by("signer", "seq").alias("operator"))
    s = R.in_force(c, c.filter("kind = 'delegate'")).join(root, "registry")
    ok = P.may_operate(F.col("signer"), F.col("operator"), F.col("agent"), F.col("until"), F.col("time"))
    return s.select("registry", "seq", ok.alias("acts"))


def trust_gate(spark, d):
    """Which roots have a valid signature by a trusted key: keys whose first digit is even are trusted, signatures of even times valid."""
    c = _claims(spark, d).filter("kind = 'publish'").select(key("root").alias("root"), F.col("signer").alias("key"), (F.col("time") % 2 == 0).alias("ok"))
    sigs = c.groupBy("root").agg(F.collect_set(F.struct("key", "ok")).alias("sigs"))
    keys = F.transform(F.filter("sigs", lambda s: F.substring(s["key"], 1, 1).isin(*"02468ace")), lambda s: s["key"])
    return sigs.select("root", P.trusted(F.col("sigs"), keys).alias("trusted"))


def records_usable(spark, d):
    """Cached records (a file of a manifest) against upstream (the file's chunks): does the record still hold?"""
    m = table(spark, d, "manifests").select(key("root").alias("root"), "files").dropDuplicates(["root"])
    f = m.select("root", F.explode("files").alias("f")).select("root", "f.path", "f.size", F.col("f.hash").alias("etag"))
    up = _chunks(spark, d).filter("path is not null").groupBy("root", "path").agg(F.sum("len").alias("upstream_size"), F.min("hash").alias("upstream_etag"))
    j = f.join(up, ["root", "path"], "left")
    return j.select("root", "path", P.record_usable(F.col("size"), F.col("upstream_size"), F.col("etag"), F.col("upstream_etag")).alias("usable"))


def probe_outcomes(spark, d):
    p = table(spark, d, "probes").dropDuplicates(["probe_id"])
    reply = F.when(F.col("outcome") == "held", "chunk").when(F.col("outcome") == "up", "busy").otherwise("timeout")
    out = A.probe_outcome(reply, F.col("t") % 10 != 0)
    return p.groupBy(out.alias("outcome")).agg(F.count(F.lit(1)).alias("n"))


def node_listings(spark, d):
    n = Q._nodes(spark, d)
    flags = n.select("peer", F.col("last_seen").alias("t"), (F.col("registered") % 3 == 0).alias("hidden"))
    return A.listings(n.join(A.hidden(flags), "peer", "left"), Q.AT).select("peer", "name")


def state_kept(spark, d):
    """Rows kept of each kind of state after expiry."""
    kept = A.expire(Q._nodes(spark, d), Q._lookups(spark, d), Q._credits(spark, d), Q._days(spark, d), Q.AT)
    every = None
    for kind, df in kept.items():
        one = df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(kind).alias("kind"), "n")
        every = one if every is None else every.unionByName(one)
    return every


def metric_lines(spark, d):
    r = table(spark, d, "receipts").dropDuplicates(["receipt_id"]).groupBy("server").agg(F.sum("bytes").alias("b"))
    return r.select("server", S.metric_line(F.lit("served_bytes"), F.lit("Bytes served."), F.lit("counter"), F.coalesce("b", F.lit(0))).alias("text"))


def fill_totals(spark, d):
    return L.fill_totals(table(spark, d, "orders").select(F.col("o_custkey").alias("done"), F.col("o_orderkey").alias("total")))


def digest_paths(spark, d):
    t = table(spark, d, "documents").filter("text is not null").select("doc_id", F.concat(F.when(F.col("doc_id") % 5 == 0, "md5:").otherwise("sha256:"), F.sha2("text", 256)).alias("digest"))
    media = F.when(F.col("doc_id") % 2 == 0, "application/vnd.ollama.image.model").otherwise("application/vnd.ollama.image.license")
    return t.select("doc_id", S.digest(F.col("digest")).alias("hex"), S.layer_path(media, S.digest(F.col("digest"))).alias("path"))


def transfer_share(spark, d):
    """Bytes of each root spread evenly over its distinct chunks, the remainder on the first ones; summed over chunks no other root has."""
    c = _chunks(spark, d).filter("hash is not null").groupBy("root", "hash").agg(F.sum("len").alias("len"))
    total = c.groupBy("root").agg(F.sum("len").alias("total"), F.count(F.lit(1)).alias("n"))
    ranked = c.join(total, "root").withColumn("ix", F.row_number().over(Window.partitionBy("root").orderBy("hash")) - 1)
    share = L.spread_range(F.col("n"), F.col("total"), F.col("ix"))
    roots = c.groupBy("hash").agg(F.count(F.lit(1)).alias("roots"))
    j = ranked.withColumn("share", share).join(roots, "hash")
    return j.groupBy("root").agg(F.sum("share").alias("bytes"), F.coalesce(F.sum(F.when(F.col("roots") == 1, F.col("share"))), F.lit(0)).alias("new_bytes"))


def served_percent(spark, d):
    p = table(spark, d, "probes").dropDuplicates(["probe_id"]).groupBy("node").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("outcome") == "held").alias("held"))
    return p.select("node", S.progress_percent(F.col("held"), F.col("n")).alias("pct"), S.short_hash(F.sha2("node", 256)).alias("short"))


QUERIES = {
    f.__name__: f
    for f in (operator_rights, trust_gate, records_usable, probe_outcomes, node_listings, state_kept, metric_lines, fill_totals, digest_paths, transfer_share, served_percent)
}

SQL = {
    "operator_rights": CHAIN
    + """, op AS (SELECT registry, arg_min(signer, seq) AS operator FROM effective WHERE c.kind = 'anchors' GROUP BY registry),
w AS (SELECT registry, seq, signer, st.time AS time, c.kind AS kind,
  last_value(CASE WHEN c.kind = 'delegate' THEN {'k': c.key, 'e': c.expires} END IGNORE NULLS) OVER (PARTITION BY registry ORDER BY seq ROWS UNBOUNDED PRECEDING) AS d FROM effective)
SELECT registry, seq, coalesce(signer = operator OR (signer = d.k AND time < d.e), false) AS acts FROM w JOIN op USING (registry) WHERE kind IN ('block', 'unblock', 'gate', 'anchors')""",
    "trust_gate": CHAIN
    + f"""SELECT {_K.format("c.root")} AS root, bool_or(st.time % 2 = 0 AND substr(signer, 1, 1) IN ('0', '2', '4', '6', '8', 'a', 'c', 'e')) AS trusted FROM effective WHERE c.kind = 'publish' GROUP BY 1""",
    "records_usable": _CH
    + f""", f AS (SELECT root, unnest(files, recursive := true) FROM (SELECT DISTINCT ON ({_K.format("root")}) {_K.format("root")} AS root, files FROM manifests)),
u AS (SELECT root, path, CAST(sum(len) AS BIGINT) AS us, min(hash) AS ue FROM ch WHERE path IS NOT NULL GROUP BY ALL)
SELECT f.root, f.path, (us IS NULL OR f.size = us) AND (NOT coalesce(regexp_full_match(ue, '[0-9a-f]{{40}}|[0-9a-f]{{64}}'), false) OR coalesce(f.hash = ue, false)) AS usable
FROM f LEFT JOIN u ON u.root = f.root AND u.path = f.path""",
    "probe_outcomes": """SELECT CASE WHEN outcome = 'held' AND t % 10 <> 0 THEN 'held' WHEN outcome = 'up' THEN 'up' ELSE 'down' END AS outcome, count(*) AS n
FROM (SELECT DISTINCT ON (probe_id) * FROM probes) GROUP BY 1""",
    "node_listings": Q._DAYS + f"SELECT peer, CASE WHEN registered % 3 <> 0 THEN name END AS name FROM nodes WHERE {Q.AT} - last_seen < 604800",
    "state_kept": Q._DAYS
    + f"""SELECT 'lookups' AS kind, count(*) AS n FROM lk WHERE {Q.AT} - t <= 172800
UNION ALL SELECT 'credits', count(*) FROM cr WHERE credited > 0 AND (day_no + 2 > {Q.TODAY} OR day_no + 7 >= {Q.TODAY})
UNION ALL SELECT 'days', count(*) FROM days WHERE day_no >= {Q.TODAY - 90}
UNION ALL SELECT 'nodes', count(*) FROM nodes WHERE {Q.AT} - last_seen < 90 * 86400""",
    "metric_lines": "SELECT server, '# HELP served_bytes Bytes served.' || chr(10) || '# TYPE served_bytes counter' || chr(10) || 'served_bytes ' || CAST(coalesce(sum(bytes), 0) AS BIGINT) AS text FROM (SELECT DISTINCT ON (receipt_id) * FROM receipts) GROUP BY server",
    "fill_totals": "SELECT CAST(sum(least(o_custkey, o_orderkey)) AS BIGINT) AS done, CAST(sum(o_orderkey) AS BIGINT) AS total FROM orders",
    "digest_paths": "SELECT doc_id, CASE WHEN doc_id % 5 <> 0 THEN sha256(text) END AS hex, CASE WHEN doc_id % 5 <> 0 THEN 'sha256-' || sha256(text) || CASE WHEN doc_id % 2 = 0 THEN '.gguf' ELSE '' END END AS path FROM documents WHERE text IS NOT NULL",
    "transfer_share": _CH
    + """, c AS (SELECT root, hash, sum(len) AS len FROM ch WHERE hash IS NOT NULL GROUP BY ALL),
t AS (SELECT *, CAST(sum(len) OVER (PARTITION BY root) AS BIGINT) AS total, count(*) OVER (PARTITION BY root) AS n, row_number() OVER (PARTITION BY root ORDER BY hash) - 1 AS ix, count(*) OVER (PARTITION BY hash) AS roots FROM c),
s AS (SELECT root, roots, total // n + CASE WHEN ix < total % n THEN 1 ELSE 0 END AS share FROM t)
SELECT root, CAST(sum(share) AS BIGINT) AS bytes, CAST(coalesce(sum(share) FILTER (WHERE roots = 1), 0) AS BIGINT) AS new_bytes FROM s GROUP BY root""",
    "served_percent": "SELECT node, CAST(floor(count(*) FILTER (WHERE outcome = 'held') * 100 / count(*)) AS INTEGER) AS pct, substr(sha256(node), 1, 12) AS short FROM (SELECT DISTINCT ON (probe_id) * FROM probes) GROUP BY node",
}
