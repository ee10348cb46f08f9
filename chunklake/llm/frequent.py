"""Most frequent items: three-phase threshold top-k over local counts.

A node is a run of rows of one partition with at most `node_values` distinct values, so its counts always fit. Nodes write
their local counts to the shared folder once. Phase 1 exchanges the k largest of each node, which gives a lower bound of the k-th
largest total. Every node has a share of the bound, in proportion to its rows, so that the shares add up to the bound: a value that
reaches the bound reaches the share of some node. Phase 2 fetches the values whose local count reaches their node's share;
phase 3 adds up the candidates' counts over all nodes exactly.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chunklake.common import written

NODE_VALUES = 2_000_000
SMALL = 1_000_000


def _count(node_values: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from uuid import uuid4

        held: list[pa.Table] = []
        distinct = waiting = 0

        def fold() -> pa.Table:
            t = pa.concat_tables(held).group_by("item").aggregate([("n", "sum")])
            return t.rename_columns(["item", "n"]) if t.column_names == ["item", "n_sum"] else t.select(["item", "n_sum"]).rename_columns(["item", "n"])

        def give(t: pa.Table) -> Iterator[pa.RecordBatch]:
            node = uuid4().hex
            t = t.sort_by([("n", "descending"), ("item", "ascending")])
            rows = pc.sum(t.column("n")).as_py()
            t = t.append_column("node_rows", pa.array([rows] * t.num_rows, pa.int64()))
            t = t.append_column("place", pa.array(range(1, t.num_rows + 1), pa.int64())).append_column("node", pa.array([node] * t.num_rows, pa.string()))
            yield from t.combine_chunks().to_batches(max_chunksize=100_000)

        for b in batches:
            v = pc.value_counts(b.column(0))
            held.append(pa.table({"item": v.field("values"), "n": v.field("counts")}))
            waiting += len(v)
            if waiting >= max(200_000, distinct):
                held = [fold()]
                distinct, waiting = held[0].num_rows, 0
                if distinct >= node_values:
                    yield from give(held[0])
                    held, distinct = [], 0
        if held:
            yield from give(fold())

    return run


def local_counts(items: DataFrame, node_values: int = NODE_VALUES) -> DataFrame:
    """(node, node_rows, item, n, place) of one column of strings, null included as a value; written, so all phases see the same nodes."""
    one = items.toDF("item")
    return written(one.mapInArrow(_count(node_values), schema="item string, n long, node_rows long, place long, node string"), "counts")


def _exact(local: DataFrame, candidates: DataFrame) -> DataFrame:
    """Phase 3. The candidates are broadcast only if there are few; else both sides are shuffled."""
    few = candidates.limit(SMALL + 1).count() <= SMALL
    side = F.broadcast(candidates) if few else candidates.hint("merge")
    return local.join(side, local["item"].eqNullSafe(candidates["item"]), "left_semi").groupBy("item").agg(F.sum("n").alias("n"))


def _most(items: DataFrame, k: int, share: float, node_values: int) -> tuple[DataFrame, float]:
    """Exact counts of all values that may be among the k largest and reach a share of all rows, and how many rows that share is."""
    local = local_counts(items, node_values)
    total = local.filter("place = 1").agg(F.coalesce(F.sum("node_rows"), F.lit(0))).first()[0]
    least = total * share
    # phase 1: k-th largest sum of the leaders, a lower bound of the k-th largest total
    leaders = local.filter(F.col("place") <= k).groupBy("item").agg(F.sum("n").alias("n"))
    low = leaders.orderBy(F.desc("n")).limit(k).agg(F.min("n"), F.count("n")).first()
    bound = max(low[0] if low[1] == k else 0, least)
    # phase 2; with a bound so low that every share is one row, all values are candidates
    candidates = local.filter(F.col("n") * total >= F.lit(float(bound)) * F.col("node_rows")).select("item").distinct()
    return _exact(local, candidates), least


def top_k(items: DataFrame, k: int, node_values: int = NODE_VALUES) -> DataFrame:
    """The k most frequent values and their exact counts (item, n); ties at the end: the smaller value, nulls first.

    Null is a value like any other; fewer than k distinct values give all of them, an empty column gives none. Where all values are about
    equally frequent the bound parts nothing: all of them are counted, by partial counts and one shuffle, as exactness demands."""
    counts, _ = _most(items, k, 0.0, node_values)
    return counts.orderBy(F.desc("n"), F.asc_nulls_first("item")).limit(k)


def over_share(items: DataFrame, share: float, node_values: int = NODE_VALUES) -> DataFrame:
    """The values in at least `share` of all rows, with exact counts (item, n). Rows with null count for the total and may be a value.

    At most 1/share values can reach it, so they are among the 1/share most frequent: the bound is the larger one of both."""
    counts, least = _most(items, int(1 / share + 1e-9), share, node_values)
    return counts.filter(F.col("n") >= least)
