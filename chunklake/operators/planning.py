"""Plans of reads and transfers: offsets, ranges, blocks, sources, votes, trees."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Gap below which ranges are fetched as one, part sizes, block size, read-ahead.
RANGE_GAP, PART_FROM, PART, BLOCK, AHEAD = 1 << 20, 64 << 20, 100 << 20, 64 << 20, 16


def offsets(chunks: DataFrame, file: list[str], ix: str = "chunk_ix") -> DataFrame:
    """chunks with `start` and `stop`, the running sums of len in their file."""
    run = F.sum("len").over(Window.partitionBy(*file).orderBy(ix).rowsBetween(Window.unboundedPreceding, 0))
    return chunks.withColumn("stop", run).withColumn("start", F.col("stop") - F.col("len"))


def overlaps(placed: DataFrame, ranges: DataFrame, file: list[str], bucket: int = 4 << 20) -> DataFrame:
    """placed (start, stop) joined with the ranges (lo, hi) of its file that it overlaps.

    Both sides are put into the byte buckets they reach into, so the join is an equi-join by file and bucket and never pairs all ranges of a
    file with all its chunks; a pair counts in the first bucket that both reach into. Empty chunks and ranges overlap nothing."""

    def reach(a: str, z: str) -> Column:
        return F.sequence(F.expr(f"{a} div {bucket}"), F.expr(f"({z} - 1) div {bucket}"))

    p = placed.filter("stop > start").withColumn("_b", F.explode(reach("start", "stop")))
    r = ranges.filter("hi > lo").withColumn("_b", F.explode(reach("lo", "hi")))
    first = F.expr(f"_b = greatest(start, lo) div {bucket}")
    return p.join(r, [*file, "_b"]).filter((F.col("stop") > F.col("lo")) & (F.col("start") < F.col("hi")) & first).drop("_b")


def range_parts(placed: DataFrame, ranges: DataFrame, file: list[str]) -> DataFrame:
    """The parts of each range (range_id, file, lo, hi) that its chunks give: skip and take within the chunk, in order.

    Ranges beyond the end are short, empty ones give nothing."""
    skip = F.greatest(F.col("lo") - F.col("start"), F.lit(0))
    return overlaps(placed, ranges, file).withColumn("skip", skip).withColumn("take", F.least(F.col("hi"), F.col("stop")) - F.col("start") - skip)


def read_ahead(placed: DataFrame, parts: DataFrame, file: list[str], n: int = AHEAD) -> DataFrame:
    """The next n chunks after each range's last one: range_id, file, chunk_ix."""
    last = parts.groupBy("range_id", *file).agg(F.max("chunk_ix").alias("_last"))
    want = last.select("range_id", *file, F.explode(F.sequence(F.col("_last") + 1, F.col("_last") + n)).alias("chunk_ix"))
    return want.join(placed.select(*file, "chunk_ix"), [*file, "chunk_ix"], "left_semi").select("range_id", *file, "chunk_ix")


def coalesce_ranges(ranges: DataFrame, by: list[str], gap: int = RANGE_GAP) -> DataFrame:
    """Ranges (start, stop) of each group joined while at most `gap` bytes lie between: lo, hi, parts."""
    w = Window.partitionBy(*by).orderBy("start", "stop")
    before = F.max("stop").over(w.rowsBetween(Window.unboundedPreceding, -1))
    r = ranges.withColumn("_new", F.coalesce((F.col("start") - before > gap).cast("int"), F.lit(1)))
    r = r.withColumn("_island", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return r.groupBy(*by, "_island").agg(F.min("start").alias("lo"), F.max("stop").alias("hi"), F.count(F.lit(1)).alias("parts")).drop("_island")


def first_seen(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The first row of each key in order: what counts as new."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_r", F.row_number().over(w)).filter("_r = 1").drop("_r")


def cut_blocks(chunks: DataFrame, size: int = BLOCK) -> DataFrame:
    """root, file_ix, chunk_ix, hash, len, block_ix of each root's unique chunks: a block ends with the chunk that brings it to `size`.

    The sum begins again after each cut, so this is a fold; each root's chunks stream through it in order and only the running sum is held."""
    unique = first_seen(chunks.select("root", "file_ix", "chunk_ix", "hash", "len"), ["root", "hash"], ["file_ix", "chunk_ix"])
    ordered = unique.repartition("root").sortWithinPartitions("root", "file_ix", "chunk_ix")

    def run(frames):
        root, held, block = None, 0, 0
        for f in frames:
            out = []
            for r, n in zip(f["root"], f["len"]):
                if r != root:
                    root, held, block = r, 0, 0
                out.append(block)
                held += n
                if held >= size:
                    held, block = 0, block + 1
            yield f.assign(block_ix=pd.Series(out, index=f.index, dtype="int64"))

    return ordered.mapInPandas(run, schema="root string, file_ix int, chunk_ix int, hash string, len long, block_ix long")


def block_ids(cut: DataFrame) -> DataFrame:
    """root, block_ix, block_id (SHA-256 over the hashes in order), chunks, bytes."""
    hashes = F.transform(F.array_sort(F.collect_list(F.struct("file_ix", "chunk_ix", "hash"))), lambda x: x["hash"])
    b = cut.groupBy("root", "block_ix").agg(hashes.alias("h"), F.count(F.lit(1)).alias("chunks"), F.sum("len").alias("bytes"))
    return b.select("root", "block_ix", F.sha2(F.concat(F.lit("block/v1|"), F.array_join("h", "")), 256).alias("block_id"), "chunks", "bytes")


def held_blocks(blocks: DataFrame, store: DataFrame) -> DataFrame:
    """root, block_ix, held: whether every chunk of the block is in the store (relational division)."""
    s = store.select("hash").distinct().withColumn("_have", F.lit(True))
    return blocks.join(s, "hash", "left").groupBy("root", "block_ix").agg(F.bool_and(F.coalesce("_have", F.lit(False))).alias("held"))


def missing_plan(wanted: DataFrame, store: DataFrame, blocked: DataFrame) -> DataFrame:
    """Unique wanted chunks (root, hash, len, order columns file_ix and chunk_ix) with state: blocked, local or missing."""
    u = first_seen(wanted.filter("hash is not null"), ["root", "hash"], ["file_ix", "chunk_ix"])
    s = store.select("hash").distinct().withColumn("_have", F.lit(True))
    b = blocked.select("hash").distinct().withColumn("_bad", F.lit(True))
    state = F.when(F.col("_bad"), "blocked").when(F.col("_have"), "local").otherwise("missing")
    return u.join(s, "hash", "left").join(b, "hash", "left").withColumn("state", state).drop("_have", "_bad")


def rotate(hash_: Column, sources: Column) -> Column:
    """The sources in cyclic order from the one that the hash's first four digits choose."""
    n = F.size(sources)
    start = F.pmod(F.conv(F.substring(hash_, 1, 4), 16, 10).cast("int"), F.greatest(n, F.lit(1)))
    return F.when(n > 0, F.concat(F.slice(sources, start + 1, n), F.slice(sources, F.lit(1), start))).otherwise(sources)


def preferred(hash_: Column, holders: Column, complete: Column, anchors: Column) -> Column:
    """Holders of the block, then complete holders, both rotated, then anchors; each source once."""
    return F.array_distinct(F.concat(rotate(hash_, holders), rotate(hash_, complete), anchors))


def first_good(tries: DataFrame, by: list[str]) -> DataFrame:
    """Of ordered tries (rank, source, ok): the first good source, and the bad ones before it. Two partial aggregations; no list of tries is built."""
    rank = F.when(F.col("ok"), F.col("rank"))
    t = tries.groupBy(*by).agg(F.min(rank).alias("_at"), F.min_by("source", rank).alias("_source"))
    j = tries.join(t, by)
    bad = ~F.col("ok") & (F.col("_at").isNull() | (F.col("rank") < F.col("_at")))
    return j.groupBy(*by).agg(F.max(F.when(F.col("_at").isNotNull(), F.col("_source"))).alias("source"), F.count_if(bad).cast("int").alias("rejected"))


def tiered(lookups: list[DataFrame], by: str, value: str) -> DataFrame:
    """The value from the first tier that has it."""
    every = None
    for i, d in enumerate(lookups):
        one = d.select(by, F.lit(i).alias("tier"), value)
        every = one if every is None else every.unionByName(one)
    return every.filter(F.col(value).isNotNull()).groupBy(by).agg(F.min_by(value, F.struct("tier", value)).alias(value), F.min("tier").alias("tier"))


def vote(ballots: DataFrame, by: list[str], digest: str, need: int = 2) -> DataFrame:
    """The digest with most votes if they are enough; ties go to the greatest digest."""
    n = ballots.groupBy(*by, digest).agg(F.count(F.lit(1)).alias("votes"))
    top = n.groupBy(*by).agg(F.max(F.struct("votes", digest)).alias("t"))
    return top.select(*by, F.col(f"t.{digest}").alias(digest), "t.votes").filter(F.col("votes") >= need)


def part_ranges(files: DataFrame) -> DataFrame:
    """Files (name, size) in parts: whole below 64 MiB, else 2 to 16 equal parts of about 100 MiB: name, part, lo, hi."""
    n = F.when(F.col("size") < PART_FROM, 1).otherwise(F.least(F.greatest(F.ceil(F.col("size") / PART), F.lit(2)), F.lit(16))).cast("int")
    step = F.expr("(size + n - 1) div n")
    f = files.withColumn("n", n).withColumn("step", step)
    p = f.select("name", "size", "step", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("part"))
    return p.select("name", "part", (F.col("part") * F.col("step")).alias("lo"), F.least(F.col("size"), (F.col("part") + 1) * F.col("step")).alias("hi"))


def places(placed: DataFrame, by: list[str]) -> DataFrame:
    """Every offset at which each unique chunk goes."""
    return placed.groupBy(*by, "hash").agg(F.array_sort(F.collect_list("start")).alias("starts"))


def prefetch(ranges: DataFrame, placed: DataFrame) -> DataFrame:
    """Order in which a root's chunks are fetched: ranges (root, file_ix, phase, k1, k2, k3, lo, hi) by phase and keys, each chunk at its first range.

    Phases: 0 small files by size, 1 headers, 2 tensors by layer, 3 what is left."""
    j = overlaps(placed, ranges, ["root", "file_ix"], 64 << 20)
    order = ["phase", "k1", "k2", "k3", "file_ix", "lo", "chunk_ix"]
    u = first_seen(j, ["root", "hash"], order)
    return u.withColumn("rank", F.row_number().over(Window.partitionBy("root").orderBy(*order))).select("root", "hash", "phase", "rank")


def tree(paths: DataFrame, by: list[str], path: str = "path") -> DataFrame:
    """Every folder and file of a set of paths: by, node, parent, name, is_file, and children sorted by name as rank."""
    parts = F.split(path, "/")
    p = paths.select(*by, F.col(path).alias("_p"), F.explode(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.struct(F.array_join(F.slice(parts, F.lit(1), i), "/").alias("node"), (i == F.size(parts)).alias("leaf")))).alias("n"))
    t = p.groupBy(*by, F.col("n.node").alias("node")).agg(F.bool_or("n.leaf").alias("is_file"))
    name = F.substring_index("node", "/", -1)
    parent = F.when(F.instr("node", "/") > 0, F.regexp_replace("node", "/[^/]*$", "")).otherwise("")
    t = t.withColumn("name", name).withColumn("parent", parent)
    return t.withColumn("rank", F.row_number().over(Window.partitionBy(*by, "parent").orderBy("name")))


def listing(paths: DataFrame, prefix: str, recursive: bool = False) -> DataFrame:
    """Paths below a prefix; only direct children unless recursive."""
    rest = F.substring(F.col("path"), len(prefix) + 1, 1 << 30)
    f = paths.filter(F.col("path").startswith(prefix))
    return f if recursive else f.filter(F.instr(rest, "/") == 0)


def announce(blocks_held: DataFrame, provided: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(to announce, to withdraw): keys held but not provided, and the other way round. A root counts as held when all its blocks are."""
    roots = blocks_held.groupBy("root").agg(F.bool_and("held").alias("all")).filter("all").select(F.col("root").alias("key"))
    keys = roots.unionByName(blocks_held.filter("held").select(F.concat_ws("/", "root", "block_ix").alias("key"))).distinct()
    p = provided.select("key").distinct()
    return keys.join(p, "key", "left_anti"), p.join(keys, "key", "left_anti")


def chunk_peers(chunks: DataFrame, providers: DataFrame) -> DataFrame:
    """hash, peers of the chunks that somebody provides: through the blocks that hold them, in the order in which a reader of this chunk asks them.

    chunks: hash, block_id; providers: block_id, peer. A hash in very many blocks, or a block of very many peers, is made distinct by partial
    aggregates on both sides of the join; the list of a chunk has a peer once."""
    held = chunks.select("hash", "block_id").filter("hash is not null and block_id is not null").distinct()
    offered = providers.select("block_id", "peer").filter("block_id is not null and peer is not null").distinct()
    pairs = held.join(offered, "block_id").select("hash", "peer").distinct()
    sources = pairs.groupBy("hash").agg(F.array_sort(F.collect_list("peer")).alias("peers"))
    return sources.select("hash", rotate(F.col("hash"), F.col("peers")).alias("peers"))


def peers(*sets: DataFrame) -> DataFrame:
    every = sets[0]
    for s in sets[1:]:
        every = every.unionByName(s)
    return every.distinct()


def fill_totals(blobs: DataFrame) -> DataFrame:
    return blobs.agg(F.sum(F.least("done", "total")).alias("done"), F.sum("total").alias("total"))


def spread_range(count: Column, total: Column, ix: Column) -> Column:
    """The share of part ix (from 0) when `total` bytes are spread evenly over `count` parts, the remainder on the first ones."""
    return F.floor(total / count) + (ix < F.pmod(total, count)).cast("bigint")


def subnet_cap(joins: DataFrame, most: int) -> DataFrame:
    """Which joins are admitted: at most `most` peers of a subnet at once; a peer already in is let in again; leaving frees its place.

    joins: subnet, peer, seq, kind (join or leave). One fold per subnet, whose state is at most `most` peers."""
    ordered = joins.repartition("subnet").sortWithinPartitions("subnet", "seq")

    def run(frames):
        subnet, inside = None, set()
        for f in frames:
            ok = []
            for s, p, k in zip(f["subnet"], f["peer"], f["kind"]):
                if s != subnet:
                    subnet, inside = s, set()
                if k == "leave":
                    inside.discard(p)
                    ok.append(True)
                elif p in inside or len(inside) < most:
                    inside.add(p)
                    ok.append(True)
                else:
                    ok.append(False)
            yield f.assign(admitted=ok)[["subnet", "peer", "seq", "kind", "admitted"]]

    return ordered.select("subnet", "peer", "seq", "kind").mapInPandas(run, schema="subnet string, peer string, seq long, kind string, admitted boolean")


def chunk_gates(chunks: DataFrame, gates: DataFrame) -> DataFrame:
    """registry, hash, repos (sorted, joined by commas) of the chunks of gated roots. chunks: root, hash; gates: registry, root, repo."""
    held = chunks.select("root", "hash").filter("root is not null and hash is not null").distinct()
    return held.join(gates, "root").groupBy("registry", "hash").agg(F.array_join(F.array_sort(F.collect_set("repo")), ",").alias("repos"))


def token_bucket(sends: DataFrame, rate: float) -> DataFrame:
    """When each send (source, seq, t seconds, bytes) may go at `rate` bytes a second with a burst of one second, in order: at."""
    ordered = sends.select("source", "seq", "t", "bytes").repartition("source").sortWithinPartitions("source", "seq")

    def run(frames):
        source, tokens, last = None, 0.0, 0.0
        for f in frames:
            out = []
            for s, t, n in zip(f["source"], f["t"], f["bytes"]):
                if s != source:
                    source, tokens, last = s, rate, float(t)
                now = max(float(t), last)
                tokens = min(rate, tokens + (now - last) * rate) - n
                at = now if tokens >= 0 else now - tokens / rate
                tokens, last = max(tokens, 0.0), at
                out.append(at)
            yield f.assign(at=out)

    return ordered.mapInPandas(run, schema="source string, seq long, t double, bytes long, at double")
