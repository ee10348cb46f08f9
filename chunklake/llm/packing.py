"""Filling containers of fixed capacity: harmonic packing by reciprocal-capacity classes, refined.

A piece of length l belongs to class k if it fits k times, but not k+1 times, into a container: capacity/(k+1) < l <=
capacity/k. Each class is cut into subclasses of equal width, each known by its upper bound. A container begins with k pieces of one
class k and, as k pieces of the class's bound leave room, goes on with the largest subclass whose bound fits into that room, and so on:
its pattern, so many pieces of each subclass, follows from the bounds alone. All containers of a pattern hold the same number of
pieces of each class; how many containers of a pattern there are follows from how many pieces the subclasses have. No length of one
piece is ever compared with another's, so a share is filled from a histogram of its subclasses, and workers fill their shares
without looking at each other's.

The only loss is a piece's distance to its subclass's bound and the last containers of a share. `parts` sets the width: with one
part a class this is plain harmonic packing, in which also pieces of different classes share containers where the bounds allow it.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CAPACITY = 1024
PARTS = 1024
SHARE_ROWS = 50_000
COPIES = 1 << 16

PLACED = "container string, item_id long, part int, start int, length int, used int"


def bounds(capacity: int, parts: int = PARTS) -> np.ndarray:
    """Upper bounds of the subclasses, largest first: capacity/k, and each class k cut into ceil(parts/(k+1)) of equal width; integers.

    So a subclass is at most about 1/parts of a container wide relative to its place, and short lengths have a bound each."""
    out = {1}
    for k in range(1, capacity + 1):
        high, low = capacity / k, capacity / (k + 1)
        n = -(-parts // (k + 1))
        out |= {int(high - (high - low) * i / n + 1e-9) for i in range(n)}
    return np.array(sorted((b for b in out if b > 0), reverse=True), dtype=np.int64)


def patterns(counts: np.ndarray, bound: np.ndarray, capacity: int) -> list[tuple[int, list[tuple[int, int]]]]:
    """Patterns (number of containers, [(subclass, pieces), ...]) that hold `counts` pieces of each subclass.

    A pattern takes the largest subclass left, as often as its class number says, then the largest that fits into the room left, and
    is repeated as long as the subclasses last."""
    left = counts.astype(np.int64).copy()
    # nxt[i]: the first subclass from i on with pieces left, found by following links that are shortened on the way
    nxt = list(range(len(left) + 1))

    def first(i: int) -> int:
        j = i
        while j < len(left) and left[j] == 0:
            j = nxt[j + 1] if nxt[j + 1] > j + 1 else j + 1
        while i < j:
            nxt[i], i = j, max(i + 1, nxt[i])
        return j

    rising = bound[::-1]
    out = []
    i = first(0)
    while i < len(left):
        room, pattern, j = capacity, [], i
        while j < len(left):
            n = min(int(left[j]), room // int(bound[j]))
            if n:
                pattern.append((j, n))
                room -= n * int(bound[j])
            fits = len(bound) - int(np.searchsorted(rising, room, side="right"))  # the largest bound within the room
            j = first(max(fits, j + 1)) if room else len(left)
        times = min(int(left[s]) // n for s, n in pattern)
        for s, n in pattern:
            left[s] -= times * n
        out.append((times, pattern))
        i = first(i)
    return out


def pack_lengths(lengths: np.ndarray, capacity: int = CAPACITY, parts: int = PARTS) -> tuple[np.ndarray, int]:
    """The container (from 0) of each piece, and the number of containers. Every length is from 1 to the capacity."""
    bound = bounds(capacity, parts)
    of = len(bound) - 1 - np.searchsorted(bound[::-1], lengths, side="left")
    order = np.lexsort((lengths, of))  # pieces by subclass
    counts = np.bincount(of, minlength=len(bound))
    at = np.concatenate(([0], np.cumsum(counts)[:-1]))  # where the next piece of a subclass is taken from
    where = np.empty(len(lengths), dtype=np.int64)
    count = 0
    for times, pattern in patterns(counts, bound, capacity):
        for s, n in pattern:
            where[order[at[s] : at[s] + times * n]] = count + np.arange(times * n) // n
            at[s] += times * n
        count += times
    return where, count


def _share(capacity: int, parts: int):
    def run(t: pa.Table) -> pa.Table:
        # the result must not depend on the order in which the share's rows arrived
        t = t.sort_by([("item_id", "ascending"), ("part", "ascending"), ("length", "ascending")])
        share = t.column("share")[0].as_py()
        lengths = t.column("length").to_numpy().astype(np.int64)
        where, count = pack_lengths(lengths, capacity, parts)
        used = np.bincount(where, weights=lengths, minlength=count).astype(np.int32)
        return pa.table(
            {
                "container": pa.array([f"{share}-{w}" for w in where.tolist()]),
                "item_id": t.column("item_id"), "part": t.column("part"), "start": t.column("start"), "length": t.column("length"),
                "used": pa.array(used[where]),
            }
        )

    return run


def pack(items: DataFrame, item: str, size: str, capacity: int = CAPACITY, parts: int = PARTS, share_rows: int = SHARE_ROWS) -> DataFrame:
    """Every piece with its container: container, item_id, part, start, length (of the item's tokens), used (of the container).

    Only an item above the capacity is cut: into full containers and a last piece, which is packed like any other. Items are dealt to
    shares of about `share_rows` rows by the hash of item, size and number of the copy, so that no worker holds more, however often an
    item is repeated. A null or repeated item is an item like any other; a null, zero or negative size needs no place and gives no row; no
    items, no containers. Containers' names follow from their share or from what they hold: a repeated attempt of a task gives the same names."""
    ones = items.select(F.col(item).cast("bigint").alias("item_id"), F.col(size).cast("int").alias("n")).filter("n > 0")
    # equal items are counted instead of shuffled one by one, and numbered
    # equal items are counted instead of shuffled one by one; their copies are numbered again in runs of bounded length, each run where it falls
    runs = F.sequence(F.lit(0).cast("bigint"), F.expr(f"(copies - 1) div {COPIES}"))
    ones = ones.groupBy("item_id", "n").agg(F.count(F.lit(1)).alias("copies")).withColumn("run", F.explode(runs)).repartition("item_id", "n", "run")
    ones = ones.withColumn("copy", F.explode(F.expr(f"sequence(run * {COPIES} + 1, least(copies, (run + 1) * {COPIES}))")))
    cut = F.sequence(F.lit(0), F.expr(f"cast((n - 1) div {capacity} as int)"))
    pieces = ones.select("item_id", "n", "copy", F.explode(cut).alias("part")).select(
        "item_id", "n", "copy", "part", (F.col("part") * capacity).alias("start"), F.least(F.lit(capacity), F.col("n") - F.col("part") * capacity).alias("length")
    )
    shares = max(1, -(-items.count() // share_rows))
    full = pieces.filter(F.col("length") == capacity).select(
        F.concat_ws("-", F.lit("full"), F.coalesce(F.col("item_id").cast("string"), F.lit("null")), "n", "copy", "part").alias("container"), "item_id", "part", "start", "length", F.col("length").alias("used")
    )
    rest = pieces.filter(F.col("length") < capacity).withColumn("share", F.pmod(F.xxhash64("item_id", "part", "length", "copy"), F.lit(shares)).cast("int"))
    return full.unionByName(rest.groupBy("share").applyInArrow(_share(capacity, parts), schema=PLACED))
