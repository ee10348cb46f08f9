"""The deduplication report: bytes, stored bytes and new bytes per input and type, each chunk counted where it is first seen."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def report(pieces: DataFrame, by: list[str], order: list[str], sizes: DataFrame | None = None) -> DataFrame:
    """pieces: hash, raw, the columns of by and order, and stored. Repeated rows in one place count once.

    sizes: hash, stored, one row per hash, instead of a column stored; what it lacks is stored as it is. What is new are the first rows of
    each hash, found by a partial aggregation; their totals and those of all rows are added up side by side. Rows are united per input and hash
    before they meet the sizes, so one hash with a third of all rows is no hot group. Null hashes are one content."""
    p = pieces.dropDuplicates(order)
    cols = [*by, "raw"] if sizes is not None else [*by, "raw", "stored"]
    first = p.groupBy("hash").agg(F.min_by(F.struct(*cols), F.struct(*order)).alias("v")).select("hash", "v.*", F.lit(1).cast("bigint").alias("n"))
    if sizes is None:
        every = p.select(*by, "raw", "stored", F.lit(1).cast("bigint").alias("n"))
    else:
        every = p.groupBy(*by, "hash").agg(F.sum("raw").alias("raw"), F.count(F.lit(1)).alias("n"))
        size = lambda df: df.join(sizes.select("hash", "stored"), "hash", "left").withColumn("stored", F.coalesce(F.col("n") * F.col("stored"), F.col("raw")))
        first, every = size(first), size(every)
    zero = F.lit(0).cast("bigint")

    def totals(df: DataFrame, new: bool) -> DataFrame:
        each = {"chunks": F.coalesce(F.sum("n"), zero), "raw_bytes": F.coalesce(F.sum("raw"), zero), "stored_bytes": F.coalesce(F.sum("stored"), zero)}
        t = df.groupBy(*by).agg(*[c.alias(("new_" if new else "") + n) for n, c in each.items()])
        return t.select(*by, *[F.col(c) if c in t.columns else zero.alias(c) for c in _TOTALS])

    return totals(every, False).unionByName(totals(first, True)).groupBy(*by).agg(*[F.sum(c).alias(c) for c in _TOTALS])


_TOTALS = ("chunks", "new_chunks", "raw_bytes", "new_raw_bytes", "stored_bytes", "new_stored_bytes")


def versions(pieces: DataFrame, have: str, fetch: str) -> DataFrame:
    """What a holder of one input needs to fetch another: size, already held and transferred bytes of unique chunks."""
    a = pieces.filter(F.col("input") == have).select("hash").distinct().withColumn("_have", F.lit(True))
    w = Window.partitionBy("hash").orderBy("raw")
    b = pieces.filter(F.col("input") == fetch).withColumn("_r", F.row_number().over(w)).filter("_r = 1")
    j = b.join(a, "hash", "left")
    return j.agg(
        F.coalesce(F.sum("raw"), F.lit(0)).alias("size"), F.coalesce(F.sum(F.when(F.col("_have"), F.col("raw"))), F.lit(0)).alias("held"),
        F.coalesce(F.sum(F.when(F.col("_have").isNull(), F.col("stored"))), F.lit(0)).alias("transfer"),
    )
