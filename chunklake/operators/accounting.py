"""Counting downloads, receipts and probes; daily numbers of nodes; the leaderboard."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chunklake.common import epoch_day, global_rank

#: Windows, gaps and limits of the accounting.
RECENT_DAYS, HISTORY_DAYS, HELD_DAYS, LOOKUP_SECS, SKEW, PROBE_GAP, POSTS_PER_HOUR, MAX_MODELS = 30, 90, 7, 86400, 600, 60, 10, 500
DAY = 86400
METRICS = {"bytes": ("bytes", "downloads"), "downloads": ("downloads", "bytes"), "uptime": ("uptime", "models"), "models": ("models", "bytes")}


def counted_downloads(events: DataFrame) -> DataFrame:
    """One row per (name, network, day): a network counts once a day for a name. events: name, network, t."""
    return events.select("name", "network", epoch_day(F.col("t")).alias("day_no")).filter("network is not null").distinct()


def download_days(counted: DataFrame) -> DataFrame:
    return counted.groupBy("name", "day_no").agg(F.count(F.lit(1)).alias("downloads"))


def downloads_of(days: DataFrame, today: int) -> DataFrame:
    """name, total, last_30_days (today and the 29 days before)."""
    late = (F.col("day_no") > today - RECENT_DAYS) & (F.col("day_no") <= today)
    return days.groupBy("name").agg(F.sum("downloads").alias("total"), F.coalesce(F.sum(F.when(late, F.col("downloads"))), F.lit(0)).alias("last_30_days"))


def download_totals(days: DataFrame) -> DataFrame:
    """day_no, downloads over all names, and the running total; the unpartitioned window holds one row per day."""
    d = days.groupBy("day_no").agg(F.sum("downloads").alias("downloads"))
    return d.withColumn("total", F.sum("downloads").over(Window.orderBy("day_no").rowsBetween(Window.unboundedPreceding, 0)))


def retained(days: DataFrame, today: int) -> DataFrame:
    return days.filter(F.col("day_no") + RECENT_DAYS > today)


def bind_lookups(lookups: DataFrame) -> DataFrame:
    """The first lookup of each (peer, root); ties by network."""
    w = Window.partitionBy("peer", "root").orderBy("t", "network")
    return lookups.filter("peer is not null and root is not null").withColumn("_r", F.row_number().over(w)).filter("_r = 1").drop("_r")


def take_receipts(receipts: DataFrame, lookups: DataFrame) -> DataFrame:
    """Receipts that match a bound lookup, one per (fetcher, server, root), the latest; ties keep the earliest arrival.

    receipts: fetcher, server, root, bytes, time, arrived (seconds). lookups: peer, root, network, t, cap. The receipt must
    arrive within a day of the lookup, not begin before it nor lie in the future, both with ten minutes of grace, and come from somebody else."""
    l = lookups.select(F.col("peer").alias("fetcher"), "root", "network", F.col("t").alias("lookup_t"), "cap")
    ok = (
        (F.col("arrived") - F.col("lookup_t") <= LOOKUP_SECS) & (F.col("time") <= F.col("arrived") + SKEW) & (F.col("time") + SKEW >= F.col("lookup_t"))
        & (F.col("server") != F.col("fetcher")) & (F.col("cap") > 0)
    )
    j = receipts.join(l, ["fetcher", "root"]).filter(ok)
    best = F.max_by(F.struct("bytes", "time", "network", "lookup_t", "cap"), F.struct("time", -F.col("arrived"), "bytes"))
    return j.groupBy("fetcher", "server", "root").agg(best.alias("v")).select("fetcher", "server", "root", "v.*", epoch_day(F.col("v.lookup_t")).alias("day_no"))


def credit(taken: DataFrame) -> DataFrame:
    """Bytes scaled down to the cap where a fetcher's receipts for a root claim more than it: floor(bytes * cap / claimed), in whole numbers."""
    claimed = F.sum("bytes").over(Window.partitionBy("fetcher", "root", "day_no"))
    scaled = F.expr("cast(cast(bytes as decimal(19,0)) * cast(cap as decimal(19,0)) div cast(claimed as decimal(20,0)) as bigint)")
    c = taken.withColumn("claimed", claimed).withColumn("credited", F.when(F.col("claimed") > F.col("cap"), scaled).otherwise(F.col("bytes")))
    return c.filter("credited > 0")


def admitted_probes(probes: DataFrame, anchors: DataFrame | None = None, nodes: DataFrame | None = None) -> DataFrame:
    """Probes of allowed anchors (anchor) and registered nodes (peer, models); one that held a root which its node doesn't claim is dropped whole."""
    if anchors is not None:
        probes = probes.join(anchors.select("anchor").distinct(), "anchor", "left_semi").select(probes.columns)
    if nodes is not None:
        cols = probes.columns
        claims = F.coalesce(F.array_contains("_models", F.col("root")), F.lit(False))
        probes = probes.join(nodes.select(F.col("peer").alias("node"), F.col("models").alias("_models")), "node")
        probes = probes.filter(F.coalesce(F.col("outcome") != "held", F.lit(True)) | claims).select(cols)
    return probes


def accepted_probes(probes: DataFrame, gap: int = PROBE_GAP, anchors: DataFrame | None = None, nodes: DataFrame | None = None) -> DataFrame:
    """Of the admitted probes, those at least `gap` seconds after the last accepted one of the same anchor and node. probes: probe_id, anchor, node, root, outcome, t.

    Most pairs' probes lie further apart than the gap anyway: a probe that follows its predecessor by the gap or more starts a run, and only
    runs of closer ones are gone through in order. Their rows stream through sorted, so a burst of any length is never held, only the
    last accepted time."""
    probes = admitted_probes(probes, anchors, nodes)
    pair = Window.partitionBy("anchor", "node").orderBy("t", "probe_id")
    p = probes.withColumn("_far", F.coalesce(F.col("t") - F.lag("t").over(pair) >= gap, F.lit(True)))
    p = p.withColumn("_run", F.sum(F.col("_far").cast("int")).over(pair.rowsBetween(Window.unboundedPreceding, 0)))
    p = p.withColumn("_alone", F.col("_far") & F.coalesce(F.lead("_far").over(pair), F.lit(True)))
    cols = probes.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, last = None, None
        for b in batches:
            keep = []
            for key, t in zip(zip(*(b.column(c).to_pylist() for c in ("anchor", "node", "_run"))), b.column("t").to_pylist()):
                if key != at:
                    at, last = key, None
                ok = last is None or t - last >= gap
                last = t if ok else last
                keep.append(ok)
            yield b.filter(pa.array(keep, pa.bool_())).select(cols)

    close = p.filter("not _alone").repartition("anchor", "node", "_run").sortWithinPartitions("anchor", "node", "_run", "t", "probe_id").select(*cols, "_run")
    return p.filter("_alone").select(cols).unionByName(close.mapInArrow(run, schema=probes.schema))


def node_days(credits: DataFrame, probes: DataFrame) -> DataFrame:
    """day_no, peer, bytes, downloads (distinct networks), probes, answered: every server and every probed node, zeros where one side has none."""
    a = credits.groupBy("day_no", F.col("server").alias("peer")).agg(F.sum("credited").alias("bytes"), F.countDistinct("network").alias("downloads"))
    b = probes.groupBy(epoch_day(F.col("t")).alias("day_no"), F.col("node").alias("peer")).agg(
        F.count(F.lit(1)).alias("probes"), F.count_if(F.col("outcome").isNull() | (F.col("outcome") != "down")).alias("answered")
    )
    z = [F.coalesce(F.col(c), F.lit(0)).alias(c) for c in ("bytes", "downloads", "probes", "answered")]
    return a.join(b, ["day_no", "peer"], "full").select("day_no", "peer", *z)


def held(probes: DataFrame, at: int) -> DataFrame:
    """peer, root of the models that a probe found on a node in the last seven days."""
    last = probes.filter("outcome = 'held' and root is not null").groupBy(F.col("node").alias("peer"), "root").agg(F.max("t").alias("t"))
    return last.filter(at - F.col("t") < HELD_DAYS * DAY)


def register(posts: DataFrame) -> DataFrame:
    """Nodes from their posts: peer, registered (first), last_seen, name and models (sorted, distinct) of the latest. posts: peer, name, models, t."""
    last = F.max_by(F.struct("name", "models"), F.struct("t", "name", "models"))
    n = posts.filter(F.size("models") <= MAX_MODELS).groupBy("peer").agg(F.min("t").alias("registered"), F.max("t").alias("last_seen"), last.alias("v"))
    return n.select("peer", "registered", "last_seen", "v.name", F.array_sort(F.array_distinct("v.models")).alias("models"))


def rate_limited(posts: DataFrame, who: list[str], t: str, order: list[str], limit: int = POSTS_PER_HOUR) -> DataFrame:
    """The first `limit` posts of each network and hour. Only posts that are valid otherwise should come here."""
    w = Window.partitionBy(*who, F.floor(F.col(t) / 3600)).orderBy(t, *order)
    return posts.withColumn("place", F.row_number().over(w)).filter(F.col("place") <= limit)


def hidden(flags: DataFrame) -> DataFrame:
    return flags.groupBy("peer").agg(F.max_by("hidden", "t").alias("hidden"))


def listings(nodes: DataFrame, at: int) -> DataFrame:
    """Active nodes; the name of a hidden one is null."""
    hide = F.coalesce("hidden", F.lit(False)) if "hidden" in nodes.columns else F.lit(False)
    return nodes.filter(at - F.col("last_seen") < 7 * DAY).select("peer", F.when(~hide, F.col("name")).alias("name"), "last_seen")


def leaderboard(nodes: DataFrame, days: DataFrame, held_: DataFrame, metric: str, span: int, at: int) -> DataFrame:
    """Active nodes with their sums over the last 1 to 90 days and their rank by a metric; ties by its second metric, then peer."""
    today, span = at // DAY, min(max(span, 1), HISTORY_DAYS)
    d = days.filter((F.col("day_no") > today - span) & (F.col("day_no") <= today))
    sums = d.groupBy("peer").agg(*[F.sum(c).alias(c) for c in ("bytes", "downloads", "probes", "answered")])
    models = held_.groupBy("peer").agg(F.count(F.lit(1)).alias("models"))
    z = lambda c: F.coalesce(F.col(c), F.lit(0)).alias(c)
    rows = listings(nodes, at).join(sums, "peer", "left").join(models, "peer", "left").select(
        "peer", "name", z("bytes"), z("downloads"), F.when(F.col("probes") > 0, F.col("answered") / F.col("probes")).alias("uptime"), z("models")
    )
    first, second = METRICS[metric]
    order = [F.desc(F.coalesce(F.col(c).cast("double"), F.lit(-1.0))) for c in (first, second)]
    return global_rank(rows, [*order, F.asc("peer")])


def history(nodes: DataFrame, days: DataFrame, at: int, signed: DataFrame | None = None) -> DataFrame:
    """One row per node and day back to its registration, 90 days at most, zeros on days without activity; signed tells whether the day is closed."""
    today = at // DAY
    first = F.greatest(epoch_day(F.col("registered")), F.lit(today - HISTORY_DAYS + 1))
    spine = nodes.filter(epoch_day(F.col("registered")) <= today).select("peer", F.explode(F.sequence(first, F.lit(today).cast("int"))).alias("day_no"))
    z = [F.coalesce(F.col(c), F.lit(0)).alias(c) for c in ("bytes", "downloads", "probes", "answered")]
    is_signed: Column = F.col("day_no") + 2 <= today
    return spine.join(days, ["peer", "day_no"], "left").select("peer", "day_no", *z, is_signed.alias("signed"))


def bytes_served(days: DataFrame, today: int) -> DataFrame:
    """Credited bytes of every node, registered or not, of all days up to today."""
    return days.filter(F.col("day_no") <= today).agg(F.coalesce(F.sum("bytes"), F.lit(0)).alias("bytes_served"))


def finalize(days: DataFrame, nodes: DataFrame, today: int) -> DataFrame:
    """Days that are closed (two days old): per-node numbers of registered nodes, and bytes_served of all."""
    d = days.filter(F.col("day_no") + 2 <= today)
    total = d.groupBy("day_no").agg(F.sum("bytes").alias("bytes_served"))
    return d.join(nodes.select("peer"), "peer", "left_semi").join(total, "day_no")


def expire(nodes: DataFrame, lookups: DataFrame, credits: DataFrame, days: DataFrame, at: int, probes: DataFrame | None = None) -> dict[str, DataFrame]:
    """What is still kept at a time: lookups two days, receipts of closed days a week, days and nodes 90 days.

    Of accepted probes, where given: those of days not closed yet, the models held in the last seven days, and the last one of each anchor
    and node within a day (anchor, node, t)."""
    today = at // DAY
    more = {}
    if probes is not None:
        last = probes.groupBy("anchor", "node").agg(F.max("t").alias("t"))
        more = {
            "probes": probes.filter(epoch_day(F.col("t")) + 2 > today),
            "held": held(probes, at),
            "last_probe": last.filter(at - F.col("t") < DAY),
        }
    return more | {
        "lookups": lookups.filter(at - F.col("t") <= LOOKUP_SECS + DAY),
        "credits": credits.filter((F.col("day_no") + 2 > today) | (F.col("day_no") + 7 >= today)),
        "days": days.filter(F.col("day_no") >= today - HISTORY_DAYS),
        "nodes": nodes.filter(at - F.col("last_seen") < HISTORY_DAYS * DAY),
    }


def probe_outcome(reply: Column, hash_ok: Column) -> Column:
    """held when a chunk came and was right; up when the node answered without one; else down."""
    return F.when((reply == "chunk") & hash_ok, "held").when(reply.isin("none", "busy", "gated"), "up").otherwise("down")


def served_totals(transfers: DataFrame) -> DataFrame:
    return transfers.groupBy("source").agg(F.sum("bytes").alias("bytes"), F.sum("chunks").alias("chunks"))


def node_page(hist: DataFrame) -> DataFrame:
    return hist.groupBy("peer").agg(*[F.sum(c).alias(c) for c in ("bytes", "downloads", "probes", "answered")])
