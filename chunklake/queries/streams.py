"""Queries that run a stream over a table to its end, and byte-level queries; SQL gives the batch answer where there is one."""

from __future__ import annotations

from pyspark.sql import functions as F

from chunklake.common import table, written
from chunklake.plans import pipeline
from chunklake.queries.accounting import _BASE, _walk
from chunklake.streaming import board as B


def _stream(spark, d, name, seconds, *cols):
    return B.event_time(B.source(spark, f"{d}/{name}.parquet").select(*cols), seconds)


def stream_downloads(spark, d):
    """Downloads counted once per name, id and day as they come in."""
    s = B.source(spark, f"{d}/seen.parquet").select("registry", "name", "seen_id", "t").filter("seen_id is not null")
    one = B.run(B.once_a_day(s, ["registry", "name", "seen_id"], "t").select("registry", "name", "day_at"), name="downloads")
    return one.groupBy("registry", "name", F.date_format("day_at", "yyyy-MM-dd").alias("day")).agg(F.count(F.lit(1)).alias("n"))


def stream_daily_bytes(spark, d):
    s = _stream(spark, d, "receipts", "time", "receipt_id", "server", "bytes", "time")
    one = B.once(s, ["receipt_id"])
    u = B.run(B.daily(one, ["server"], n=F.count(F.lit(1)), total=F.sum("bytes")), mode="update", name="bytes")
    last = u.groupBy("server", "day").agg(F.max_by(F.struct("n", "total"), "batch").alias("v"))
    return last.select("server", F.date_format("day", "yyyy-MM-dd").alias("day"), "v.n", F.col("v.total").alias("total"))


def stream_days_closed(spark, d):
    """Days that the watermark has passed by two days, each given once and for good, as receipts come in."""
    s = _stream(spark, d, "receipts", "time", "receipt_id", "server", "bytes", "time")
    u = B.run(B.daily(B.once(s, ["receipt_id"]), ["server"], n=F.count(F.lit(1)), total=F.sum("bytes")), name="closed")
    return u.select("server", F.date_format("day", "yyyy-MM-dd").alias("day"), "n", "total")


def stream_restarted(spark, d):
    """A view of probes per node and outcome that was stopped after half of the files and went on from its checkpoint with the rest."""
    from chunklake.common import scratch

    src, out, state = (scratch(spark, x) for x in ("incoming", "view", "view-state"))
    p = table(spark, d, "probes").dropDuplicates(["probe_id"])

    def step(df, n):
        df.groupBy("node", "outcome").agg(F.count(F.lit(1)).alias("n")).write.mode("overwrite").parquet(f"{out}/batch={n}")

    for half in (F.col("t") < 1_744_000_000, ~F.coalesce(F.col("t") < 1_744_000_000, F.lit(False))):
        p.filter(half).write.mode("append").parquet(src)
        B.follow(B.source(spark, src, 3), step, state).awaitTermination()
    return spark.read.parquet(out).groupBy("node", "outcome").agg(F.sum("n").alias("n"), F.lit(True).alias("whole"))


EDGES, KEPT = (1_742_800_000, 1_747_000_000), 60 * 86400


def stream_retried(spark, d):
    """Receipts sent in three batches as they come: those with an odd id fail at first and are sent again with the next batch, unless they are
    more than 60 days older than its newest; what failed last still waits."""
    from chunklake.common import scratch

    src, out, queue, state = (scratch(spark, x) for x in ("incoming", "sent", "queue", "sent-state"))
    r = table(spark, d, "receipts").dropDuplicates(["receipt_id"]).filter("time is not null").select("receipt_id", "time")
    batch = F.when(F.col("time") < EDGES[0], 0).when(F.col("time") < EDGES[1], 1).otherwise(2)
    at = {"n": 0}

    def send(df):
        df = df.withColumn("batch", batch)
        fails = (F.col("batch") == at["n"]) & (F.col("receipt_id") % 2 == 1)
        df.filter(~fails).select("receipt_id").write.mode("overwrite").parquet(f"{out}/batch={at['n']}")
        return df.filter(fails).drop("batch")

    step = B.with_retry(send, KEPT, queue)

    def one(df, n):
        at["n"] = n
        step(df, n)

    for n in range(3):
        r.filter(batch == n).coalesce(1).write.mode("append").parquet(src)
        B.follow(B.source(spark, src, 1), one, state).awaitTermination()
    sent = spark.read.parquet(out).groupBy("batch").agg(F.count(F.lit(1)).alias("n")).select(F.concat(F.lit("sent "), F.col("batch").cast("string")).alias("what"), "n")
    return sent.unionByName(spark.read.parquet(f"{queue}/2").agg(F.count(F.lit(1)).alias("n")).select(F.lit("waits").alias("what"), "n"))


def stream_hourly_probes(spark, d):
    s = _stream(spark, d, "probes", "t", "probe_id", "node", "t")
    u = B.run(B.hourly(B.once(s, ["probe_id"]), ["node"], n=F.count(F.lit(1))), mode="update", name="probes")
    return u.groupBy("node", "hour").agg(F.max_by("n", "batch").alias("n")).select("node", F.date_format("hour", "yyyy-MM-dd HH").alias("hour"), "n")


def stream_probe_gap(spark, d):
    """Probes accepted per node up to two days before the last one, which the watermark has then passed."""
    s = B.event_time(B.source(spark, f"{d}/probes.parquet").select("probe_id", "anchor", "node", "t"), "t")
    one = B.once(s, ["probe_id"]).select("probe_id", "anchor", "node", "t", "at")
    return B.run(B.min_gap(one, ["anchor", "node"], "t", 3600, "probe_id"), name="gap").groupBy("node").agg(F.count(F.lit(1)).alias("n"))


def stream_latest_probe(spark, d):
    """The latest probe of each node, upserted as they come; of several at one time that with the largest id."""
    s = B.source(spark, f"{d}/probes.parquet").select("node", F.struct("t", "probe_id").alias("o"))
    u = B.run(B.latest(s.select("node", F.expr("o.t * 1000000000L + o.probe_id").alias("place"), F.col("o.t").alias("t"), F.col("o.probe_id").alias("probe_id")), ["node"], "place", ["t", "probe_id"]), mode="update", name="latest")
    return u.groupBy("node").agg(F.max_by(F.struct("t", "probe_id"), "place").alias("v")).select("node", "v.t", "v.probe_id")


def stream_follow_log(spark, d):
    """A view of claims per registry kept up to date batch by batch."""
    from chunklake.common import scratch

    out = scratch(spark, "follow")

    def step(df, n):
        df.filter("statement is not null").groupBy("registry", F.col("statement.claim.kind").alias("kind")).agg(F.count(F.lit(1)).alias("n")).write.mode("overwrite").parquet(f"{out}/batch={n}")

    B.follow(B.source(spark, f"{d}/log.parquet", 4), step, f"{out}-state").awaitTermination()
    return spark.read.parquet(out).groupBy("registry", "kind").agg(F.sum("n").alias("n"))


def _files(spark, d):
    t = table(spark, d, "documents").filter("text is not null")
    return t.select(F.concat_ws("/", "source", F.concat(F.col("doc_id").cast("string"), F.lit(".txt"))).alias("path"), F.encode("text", "UTF-8").alias("content")).withColumn("size", F.octet_length("content").cast("bigint"))


def cdc_chunks(spark, d):
    """Chunks of every text: how many and their bytes per source."""
    c = pipeline.cut(_files(spark, d))
    return c.groupBy(F.substring_index("path", "/", 1).alias("source")).agg(F.sum("len").alias("bytes"), F.countDistinct("path").alias("files"))


def codec_roundtrip(spark, d):
    """Every distinct chunk encoded, decoded and compared with its hash; the bytes of each source's files that came back."""
    c = written(pipeline.cut(_files(spark, d)), "pieces")
    good = pipeline.decode(pipeline.encode(c)).filter("ok").select("hash", F.octet_length("raw").cast("bigint").alias("back"))
    # pieces are united per source and hash first, so that a hash in very many files is no hot group of the join
    p = c.groupBy(F.substring_index("path", "/", 1).alias("source"), "hash").agg(F.count(F.lit(1)).alias("n"), F.sum("len").alias("len"))
    j = p.join(good, "hash", "left")
    return j.groupBy("source").agg(F.sum("len").alias("bytes"), F.coalesce(F.sum(F.col("n") * F.col("back")), F.lit(0)).alias("back"))


def codec_ratio(spark, d):
    """Bytes of the embeddings, raw, encoded as F32 and encoded as plain bytes."""
    from chunklake.functions import codec

    e = table(spark, d, "embeddings").select("vec_id", "embedding")

    def run(frames):
        import numpy as np
        import pandas as pd

        for f in frames:
            raw = [np.asarray(v, "<f4").tobytes() for v in f["embedding"]]
            yield pd.DataFrame({"raw": [len(r) for r in raw], "f32": [len(codec.encode(r, "f32")) for r in raw], "plain": [len(codec.encode(r, "raw")) for r in raw]})

    return e.mapInPandas(run, schema="raw long, f32 long, plain long").agg(F.sum("raw").alias("raw"), F.sum("f32").alias("f32"), F.sum("plain").alias("plain"))


def pack_manifest(spark, d):
    """Files, chunks and bytes of the manifest of all texts, with its root."""
    f = _files(spark, d)
    m = pipeline.manifest_root(pipeline.manifest_files(pipeline.cut(f), f))
    return m.select("files", "size", F.length("root").alias("root_digits"))



QUERIES = {
    f.__name__: f
    for f in (stream_downloads, stream_daily_bytes, stream_days_closed, stream_restarted, stream_retried, stream_hourly_probes, stream_probe_gap, stream_latest_probe, stream_follow_log, cdc_chunks, codec_roundtrip, codec_ratio, pack_manifest)
}

SQL = {
    "stream_downloads": "SELECT registry, name, strftime(make_timestamp(t * 1000000), '%Y-%m-%d') AS day, count(DISTINCT seen_id) AS n FROM seen WHERE seen_id IS NOT NULL GROUP BY ALL",
    "stream_daily_bytes": "SELECT server, strftime(make_timestamp(time * 1000000), '%Y-%m-%d') AS day, count(*) AS n, CAST(sum(bytes) AS BIGINT) AS total FROM (SELECT DISTINCT ON (receipt_id) * FROM receipts) GROUP BY ALL",
    "stream_days_closed": """WITH r AS (SELECT DISTINCT ON (receipt_id) * FROM receipts)
SELECT server, strftime(make_timestamp(time * 1000000), '%Y-%m-%d') AS day, count(*) AS n, CAST(sum(bytes) AS BIGINT) AS total FROM r
WHERE (time // 86400 + 1) * 86400 <= (SELECT max(time) FROM r) - 172800 GROUP BY ALL""",
    "stream_restarted": "SELECT node, outcome, count(*) AS n, true AS whole FROM (SELECT DISTINCT ON (probe_id) * FROM probes) GROUP BY ALL",
    "stream_retried": f"""WITH r AS (SELECT DISTINCT ON (receipt_id) receipt_id, time, CASE WHEN time < {EDGES[0]} THEN 0 WHEN time < {EDGES[1]} THEN 1 ELSE 2 END AS b FROM receipts WHERE time IS NOT NULL),
m AS (SELECT b, max(time) AS newest FROM r GROUP BY b)
SELECT 'sent ' || b AS what, count(*) AS n FROM (
  SELECT b FROM r WHERE receipt_id % 2 = 0 UNION ALL SELECT r.b + 1 FROM r JOIN m ON m.b = r.b + 1 WHERE receipt_id % 2 = 1 AND r.time > m.newest - {KEPT}) GROUP BY b
UNION ALL SELECT 'waits', count(*) FROM r WHERE b = 2 AND receipt_id % 2 = 1""",
    "stream_hourly_probes": "SELECT node, strftime(make_timestamp(t * 1000000), '%Y-%m-%d %H') AS hour, count(*) AS n FROM (SELECT DISTINCT ON (probe_id) * FROM probes) GROUP BY ALL",
    "stream_probe_gap": _BASE + _walk(3600) + "SELECT node, count(*) AS n FROM ap WHERE t < (SELECT max(t) FROM probes) - 172800 GROUP BY node",
    "stream_latest_probe": "SELECT node, t, probe_id FROM (SELECT DISTINCT node, t, probe_id FROM probes) QUALIFY row_number() OVER (PARTITION BY node ORDER BY t DESC, probe_id DESC) = 1",
    "stream_follow_log": "SELECT registry, statement.claim.kind AS kind, count(*) AS n FROM log WHERE statement IS NOT NULL GROUP BY ALL",
    "cdc_chunks": "SELECT source, CAST(sum(strlen(text)) AS BIGINT) AS bytes, count(*) FILTER (WHERE strlen(text) > 0) AS files FROM documents WHERE text IS NOT NULL GROUP BY source",
    "codec_roundtrip": "SELECT source, CAST(sum(strlen(text)) AS BIGINT) AS bytes, CAST(sum(strlen(text)) AS BIGINT) AS back FROM documents WHERE strlen(text) > 0 GROUP BY source",
    "pack_manifest": "SELECT count(*) AS files, CAST(sum(strlen(text)) AS BIGINT) AS size, 64 AS root_digits FROM documents WHERE text IS NOT NULL",
}
