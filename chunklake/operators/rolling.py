"""Rolling totals over trailing periods, kept as a versioned daily state.

The state of an entity on a day is yesterday's state plus the day's arrivals minus the amounts that leave the period that day.
`advance` makes the states of the next day, or of a block of days, from a stored state: per entity it joins yesterday's totals with
the arrivals and the expiring amounts of these days and goes through the days in turn. Each block is written before the next one
starts from its last day. What is saved after a day was closed is a correction: `apply_corrections` recomputes the dates
whose periods hold a corrected day, and gives them a higher version; all other dates stay as they are.
"""

from __future__ import annotations

from datetime import date, timedelta
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chunklake.common import written

PERIODS = (7, 30)
BLOCK = 30
CLOSE = 2


def amount_versions(saves: DataFrame, close: int = CLOSE) -> DataFrame:
    """Signed changes (registry, name, day, change, version, late) of each day's amount, one per effective save.

    saves: registry, day, name, downloads, saved. Saves without an amount count for nothing; repeated rows count once;
    of several amounts saved at one moment the largest counts last. `late`: saved `close` days after the beginning of its day or
    later, when the day's state was already made. Null registries and names are entities of their own; rows without a day are
    left out, as they belong to no period; a save without a moment comes before all others."""
    rows = saves.select("registry", "day", "name", "downloads", "saved").filter("downloads is not null and day is not null").distinct()
    w = Window.partitionBy("registry", "name", "day").orderBy(F.col("saved").asc_nulls_first(), "downloads")
    late = F.col("saved") >= F.date_add("day", close).cast("timestamp_ntz")
    return rows.select(
        "registry", "name", "day",
        (F.col("downloads") - F.coalesce(F.lag("downloads").over(w), F.lit(0))).alias("change"),
        F.row_number().over(w).alias("version"), F.coalesce(late, F.lit(False)).alias("late"),
    )


def _same(entity: list[str], prefix: str) -> Column:
    """Equal entities, null being one of them."""
    return reduce(lambda a, b: a & b, [F.col(e).eqNullSafe(F.col(f"{prefix}{e}")) for e in entity])


def seed(amounts: DataFrame, entity: list[str], day: str, periods=PERIODS) -> DataFrame:
    """The state (entity, day, total_P) of every entity of `amounts` (entity, day, amount) on a day, from the amounts themselves."""
    d = F.to_date(F.lit(day))
    within = lambda p: (F.col("day") > F.date_add(d, -p)) & (F.col("day") <= d)
    return amounts.groupBy(*entity).agg(*[F.coalesce(F.sum(F.when(within(p), F.col("amount"))), F.lit(0)).cast("bigint").alias(f"total_{p}") for p in periods]).select(
        *entity, d.alias("day"), *[f"total_{p}" for p in periods]
    )


def advance(state: DataFrame, amounts: DataFrame, entity: list[str], first: str, last: str, periods=PERIODS) -> DataFrame:
    """The states (entity, day, total_P, version) of the days from first to last, from the state of the day before first.

    state: entity, total_P of that day, one row per entity. amounts: entity, day, amount, version, one row per entity and day; only
    the block's days and the longest period before them are read. Entities new in the block begin with zero; a state's
    version is the highest of the amounts in its longest period, 0 without any. At most block + longest period amounts of an
    entity are held at once, whatever its activity."""
    start, longest = date.fromisoformat(first), max(periods)
    n = (date.fromisoformat(last) - start).days + 1
    near = amounts.filter(F.col("day").between(F.lit(start - timedelta(days=longest)), F.lit(last).cast("date")))
    ix = F.datediff("day", F.lit(start))
    moves = near.groupBy(*entity).agg(F.collect_list(F.struct(ix.alias("ix"), "amount", "version")).alias("_moves"))
    moves = moves.withColumnsRenamed({e: f"_of_{e}" for e in entity})
    s = state.select(*entity, *[f"total_{p}" for p in periods])
    joined = s.join(moves, _same(entity, "_of_"), "full").select(
        *[F.coalesce(e, f"_of_{e}").alias(e) for e in entity], *[F.coalesce(f"total_{p}", F.lit(0)).cast("bigint").alias(f"total_{p}") for p in periods],
        F.map_from_entries(F.transform(F.coalesce("_moves", F.array()), lambda x: F.struct(x["ix"], x["amount"]))).alias("_amount"),
        F.coalesce("_moves", F.array()).alias("_moves"),
    )
    at = lambda i: F.coalesce(F.try_element_at("_amount", i), F.lit(0).cast("bigint"))

    def day_after(states: Column, i: Column) -> Column:
        y = F.element_at(states, -1)
        held = F.filter("_moves", lambda x: (x["ix"] <= i) & (x["ix"] > i - longest))
        today = F.struct(
            i.alias("i"), *[(y[f"total_{p}"] + at(i) - at(i - p)).alias(f"total_{p}") for p in periods],
            F.coalesce(F.array_max(F.transform(held, lambda x: x["version"])), F.lit(0)).alias("version"),
        )
        return F.concat(states, F.array(today))

    yesterday = F.array(F.struct(F.lit(-1).alias("i"), *[F.col(f"total_{p}") for p in periods], F.lit(0).alias("version")))
    days = F.aggregate(F.sequence(F.lit(0), F.lit(n - 1)), yesterday, day_after)
    return joined.select(*entity, F.explode(F.slice(days, 2, n)).alias("s")).select(
        *entity, F.date_add(F.lit(start), F.col("s.i")).alias("day"), *[f"s.total_{p}" for p in periods], "s.version"
    )


def apply_corrections(state: DataFrame, corrections: DataFrame, entity: list[str], periods=PERIODS) -> DataFrame:
    """A stored state (entity, day, total_P, version) after corrections (entity, day, change, version) of past amounts.

    Only dates whose longest period holds a corrected day change, and have the correction's version if it is higher."""
    longest = max(periods)
    touched = (
        corrections.groupBy(*entity, "day").agg(F.sum("change").alias("c"), F.max("version").alias("_v"))
        .select(*entity, "c", "_v", F.explode(F.sequence(F.lit(0), F.lit(longest - 1))).alias("o"), "day")
        .groupBy(*entity, F.expr("date_add(day, o)").alias("day"))
        .agg(F.max("_v").alias("_v"), *[F.sum(F.when(F.col("o") < p, F.col("c")).otherwise(0)).alias(f"_c{p}") for p in periods])
    )
    t = touched.select(*[F.col(e).alias(f"_of_{e}") for e in entity], F.col("day").alias("_on"), "_v", *[f"_c{p}" for p in periods])
    old = state.select(*entity, "day", *[f"total_{p}" for p in periods], "version")
    return old.join(t, _same(entity, "_of_") & (F.col("day") == F.col("_on")), "left").select(
        *entity, "day", *[(F.col(f"total_{p}") + F.coalesce(f"_c{p}", F.lit(0))).cast("bigint").alias(f"total_{p}") for p in periods],
        F.greatest("version", F.coalesce("_v", F.lit(0))).alias("version"),
    )


def rolling_state(changes: DataFrame, entity: list[str], first: str, last: str, periods=PERIODS, block: int = BLOCK) -> DataFrame:
    """total_P and mean_P of each period, and version, for each entity on every day from first to last.

    changes: entity columns, day, change, version, late. An entity with any change has a row on every day, also without activity.
    Amounts of days before `first` count in the periods that reach back to them. No changes: no rows.

    The state is advanced block by block with what was known when each day was closed, every block from the written state of the
    one before it; then the late changes are applied as corrections to the dates they touch."""
    changes = written(changes.groupBy(*entity, "day", "late").agg(F.sum("change").alias("change"), F.max("version").alias("version")), "amounts")
    known = changes.filter("not late").select(*entity, "day", F.col("change").alias("amount"), "version")
    start, end = date.fromisoformat(first), date.fromisoformat(last)
    # entities that only corrections know have a state, too: zeros
    every = known.select(*entity, "day", "amount").unionByName(changes.filter("late").select(*entity, "day", F.lit(0).cast("bigint").alias("amount")))
    state = seed(every, entity, str(start - timedelta(days=1)), periods)
    made: list[DataFrame] = []
    while start <= end:
        until = min(end, start + timedelta(days=block - 1))
        made.append(written(advance(state, known, entity, str(start), str(until), periods), "state"))
        state = made[-1].filter(F.col("day") == F.lit(until))
        start = until + timedelta(days=1)
    states = apply_corrections(reduce(DataFrame.unionByName, made), changes.filter("late"), entity, periods)
    return states.select(*entity, "day", *[x for p in periods for x in (F.col(f"total_{p}"), (F.col(f"total_{p}") / p).alias(f"mean_{p}"))], "version")
