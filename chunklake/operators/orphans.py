"""References to records that do not exist: a linear merge of references and parent validity intervals.

Both sides are brought into one stream, hash-partitioned and sorted by (kind, key, time); running counters over that
order then tell, for each reference, whether a parent is open, was closed before, or opens later. Nothing is joined
and no list of intervals is ever built, so a key with any number of references or intervals streams through.
Keys that hold a large share of the references are salted: their references are spread over `salts` and only their
parents are repeated once per salt.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from chunklake.common import hot_hashes, key, micros, table

ALWAYS = -(2**62)


def find_orphans(refs: DataFrame, parents: DataFrame, salts: int = 32) -> DataFrame:
    """The rows of `refs` without a valid parent at their time, with `state`.

    refs: kind, key, at (bigint) and any other columns. parents: kind, key, since, until (null: open).
    state is `deleted` if a parent ended at or before `at`, else `late` if one starts after, else `missing`.
    A null or blank key is no reference and gives no row; a reference with a null time is held against no
    interval: it is an orphan only if its key has no parent at all (`missing`). A parent with null key or since
    never exists. Repeated parents change nothing; repeated references give repeated rows. Empty inputs are fine.
    """
    names = [c for c in refs.columns if c not in ("kind", "key", "at")]
    # clashing names stay apart: every other column of the reference travels in one struct
    refs = refs.filter("key is not null").select("kind", "key", "at", F.struct(F.lit(0).alias("_"), *[F.col(f"`{c}`") for c in names]).alias("row"))
    parents = parents.filter("key is not null and since is not null").select("kind", "key", "since", "until")
    # of a key's open parents only the first start and the last one matter; both are partial aggregates, so a parent recorded over and over is no hot key
    still = parents.filter("until is null").groupBy("kind", "key").agg(F.min("since").alias("since"), F.max("since").alias("last"))
    closed = parents.filter("until is not null").distinct()
    parents = still.select("kind", "key", "since", F.lit(None).cast("bigint").alias("until"), "last").unionByName(closed.withColumn("last", F.col("since")))
    hot = F.xxhash64("kind", "key").isin(hot_hashes(refs, ["kind", "key"]))  # at most 512 numbers
    left = (
        refs.withColumn("salt", F.when(hot, F.pmod(F.xxhash64("row", "at"), F.lit(salts)).cast("int")).otherwise(0))
        .select("kind", "key", "salt", F.lit(1).alias("phase"), F.col("at").alias("t"), F.lit(1).alias("side"),
                F.lit(0).alias("opened"), F.lit(0).alias("ended"), F.lit(None).cast("bigint").alias("since"), "at", "row")
    )
    nothing = F.lit(None).cast(refs.schema["row"].dataType)
    # one announcement of the parent (it tells of later starts), one row where it starts, one where it ends
    marks = F.array(
        F.struct(F.lit(0).alias("phase"), F.col("since").alias("t"), F.lit(0).alias("opened"), F.lit(0).alias("ended")),
        F.struct(F.lit(1).alias("phase"), F.col("since").alias("t"), F.lit(1).alias("opened"), F.lit(0).alias("ended")),
        F.struct(F.lit(1).alias("phase"), F.col("until").alias("t"), F.lit(-1).alias("opened"), F.lit(1).alias("ended")),
    )
    right = (
        parents.withColumn("salt", F.explode(F.when(hot, F.sequence(F.lit(0), F.lit(salts - 1))).otherwise(F.array(F.lit(0)))))
        .withColumn("m", F.explode(F.filter(marks, lambda m: m["t"].isNotNull())))
        .select("kind", "key", "salt", "m.phase", "m.t", F.lit(0).alias("side"), "m.opened", "m.ended", F.col("last").alias("since"), F.lit(None).cast("bigint").alias("at"), nothing.alias("row"))
    )
    w = Window.partitionBy("kind", "key", "salt").orderBy("phase", "t", "side").rowsBetween(Window.unboundedPreceding, 0)
    merged = left.unionByName(right).select(
        "kind", "key", "side", "at", "row",
        F.sum("opened").over(w).alias("open"), F.sum("ended").over(w).alias("gone"), F.max("since").over(w).alias("latest"),
    )
    timed = F.when(F.col("gone") > 0, "deleted").when(F.col("latest") > F.col("at"), "late").otherwise("missing")
    return (
        merged.filter("side = 1 and open <= 0 and (at is not null or latest is null)")
        .withColumn("state", timed)
        .select("kind", "key", "at", *[F.col("row")[c].alias(c) for c in names], "state")
    )


def store_references(spark, sf_dir: str) -> DataFrame:
    """Every reference of the store's tables: source_table, row_id, field, kind, key, at (microseconds)."""

    def of(name: str, row: str, field: str, kind: str, at: str) -> DataFrame:
        return table(spark, sf_dir, name).select(
            F.lit(name).alias("source_table"), F.col(row).alias("row_id"), F.lit(field).alias("field"),
            F.lit(kind).alias("kind"), key(field).alias("key"), F.expr(at).alias("at"),
        )

    packed = micros("packed")
    return (
        of("receipts", "receipt_id", "root", "root", "time * 1000000L")
        .unionByName(of("probes", "probe_id", "root", "root", "t * 1000000L"))
        .unionByName(of("chunks", "chunk_id", "hash", "hash", packed))
        .unionByName(of("chunks", "chunk_id", "block_id", "block", packed))
    )


def store_parents(spark, sf_dir: str) -> DataFrame:
    """Validity intervals of roots, blocks and hashes; pinned items are always there."""
    manifests, blobs, pinned = (table(spark, sf_dir, x) for x in ("manifests", "blobs", "pinned"))
    span = [F.expr(micros("added")).alias("since"), F.expr(micros("removed")).alias("until")]
    return (
        manifests.select(F.lit("root").alias("kind"), key("root").alias("key"), *span)
        .unionByName(manifests.select(F.lit("block").alias("kind"), F.explode("blocks").alias("b"), *span).select("kind", key("b").alias("key"), "since", "until"))
        .unionByName(
            blobs.filter("payload is not null").select(
                F.lit("hash").alias("kind"), key("hash").alias("key"), F.expr(micros("written")).alias("since"), F.expr(micros("removed")).alias("until")
            )
        )
        .unionByName(pinned.select("kind", key("item_key").alias("key"), F.lit(ALWAYS).cast("bigint").alias("since"), F.lit(None).cast("bigint").alias("until")))
    )
