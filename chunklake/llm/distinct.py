"""Distinct counts over huge identifier sets: linear counting on fixed bitmaps, merged by bitwise union.

An identifier sets one bit of a bitmap of m = 2^k bits. A bitmap is held as its non-zero 64-bit words, one row each
(group, word_ix, word), so a set of few values costs few rows however large m is, a huge one at most m/64, and no group ever
lies in one row or one task. The union of bitmaps is bit_or per word, with partial unions before the shuffle; the estimate is
m * ln(m / empty bits), its standard error follows from the load. Bitmaps of different m merge after folding the larger one.

The partial counts of the finest groups are the stored, mergeable result (`partials`); every combination of groups is counted
from them (`cube_counts`), never from rows again.
"""

from __future__ import annotations

import math
from functools import reduce
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chunklake.common import hot_hashes

ERROR = 0.01
LEAST_BITS = 1 << 16


def standard_error(n: float, m: float) -> float:
    """The relative standard error of linear counting of n values on m bits."""
    t = n / m
    return math.sqrt(m * (math.exp(t) - t - 1)) / n if n else 0.0


def bits_for(most: int, error: float = ERROR) -> int:
    """The smallest power of two of bits, 65,536 at least, at which the standard error is at most `error` for `most` values.

    The load n/m is also held to 8, beyond which a bitmap may fill up."""
    m = LEAST_BITS
    while most > 8 * m or standard_error(most, m) > error:
        m *= 2
    return m


def bit_of(value: Column, m: int) -> Column:
    """The bit of a value: the first 60 bits of its MD5, modulo m. m is a power of two, so a bitmap of 2m bits folds to one of m."""
    return F.conv(F.substring(F.md5(value), 1, 15), 16, 10).cast("bigint").bitwiseAND(m - 1)


def partials(df: DataFrame, groups: list[str], value: str, m: int) -> DataFrame:
    """Partial counts (groups, word_ix bigint, word bigint), to be merged with any others. Rows with a null value set no bit; null groups are groups.

    Words are united in each partition before the shuffle, so what is shuffled is bitmaps: a value that a partition holds over
    and over leaves it once."""
    b = df.filter(F.col(value).isNotNull()).select(*groups, bit_of(F.col(value).cast("string"), m).alias("_b"))
    return b.groupBy(*groups, F.shiftright("_b", 6).alias("word_ix")).agg(F.bit_or(F.expr("shiftleft(1L, cast(_b & 63 as int))")).alias("word"))


def fold(part: DataFrame, groups: list[str], m: int) -> DataFrame:
    """Partial counts of a larger bitmap as those of one of m bits."""
    return part.groupBy(*groups, F.col("word_ix").bitwiseAND(m // 64 - 1).alias("word_ix")).agg(F.bit_or("word").alias("word"))


def merge(parts: list[tuple[DataFrame, int]], groups: list[str]) -> tuple[DataFrame, int]:
    """The union of partial counts, each with its bits, over any number of tables, days or runs, and its bits: the least of theirs."""
    m = min(bits for _, bits in parts)
    same = [fold(p, groups, m) if bits > m else p.select(*groups, "word_ix", "word") for p, bits in parts]
    return reduce(DataFrame.unionByName, same).groupBy(*groups, "word_ix").agg(F.bit_or("word").alias("word")), m


def with_estimate(n: DataFrame, m: int) -> DataFrame:
    """bits_set with `estimate`, rounded, null when every bit is set, as the set is then too large for m, and `error`, the estimate's
    relative standard error (six decimals), at most the one m was chosen for."""
    s = F.col("bits_set")
    load = F.log(m / (m - s))
    error = F.round(F.sqrt(F.lit(float(m)) * (F.exp(load) - load - 1)) / (m * load), 6)
    return n.withColumn("estimate", F.when(s < m, F.round(m * load).cast("bigint"))).withColumn("error", F.when(s < m, error))


def cube_counts(part: DataFrame, groups: list[str], m: int, salts: int = 16) -> DataFrame:
    """(grouping, groups, bits_set, estimate, error) of every combination of groups, from the partial counts of the finest ones.

    A column `grouping` tells which columns are held, the others are null. The first group should be the one with the most
    values: words are shuffled once by it, and every combination that holds it is united and counted where it lies. Its values with
    1/512 of the words or more are spread by word over `salts` partitions and only their counts are added up. The combinations without
    it have few groups and are united with partial unions before the shuffle. A combination without words has no row."""
    wide, rest = groups[0], groups[1:]

    def sets(cols: list[str], always: list[str]) -> Column:
        of = [c for n in range(len(cols) + 1) for c in combinations(cols, n)]
        return F.explode(F.array(*[
            F.struct(F.lit(",".join(g for g in groups if g in c or g in always)).alias("grouping"), *[(F.col(g) if g in c else F.lit(None).cast(part.schema[g].dataType)).alias(g) for g in cols])
            for c in of
        ]))

    hot = hot_hashes(part, [wide])
    salt = F.when(F.xxhash64(wide).isin(hot), F.pmod("word_ix", F.lit(salts)).cast("int")).otherwise(0) if hot else F.lit(0)
    a = part.withColumn("_salt", salt).repartition(wide, "_salt")
    g = [wide, "_salt", "grouping", *rest]
    a = a.select(wide, "_salt", "word_ix", "word", sets(rest, [wide]).alias("_s")).select(wide, "_salt", "word_ix", "word", "_s.*")
    a = a.groupBy(*g, "word_ix").agg(F.bit_or("word").alias("word")).groupBy(*g).agg(F.sum(F.bit_count("word")).cast("bigint").alias("bits_set"))
    if hot:
        whole = a.filter(~F.xxhash64(wide).isin(hot))
        spread = a.filter(F.xxhash64(wide).isin(hot)).groupBy("grouping", *groups).agg(F.sum("bits_set").alias("bits_set"))
        counted = [whole, spread]
    else:
        counted = [a]
    b = part.select("word_ix", "word", sets(rest, []).alias("_s")).select("word_ix", "word", "_s.*", F.lit(None).cast(part.schema[wide].dataType).alias(wide))
    b = b.groupBy("grouping", *groups, "word_ix").agg(F.bit_or("word").alias("word")).groupBy("grouping", *groups).agg(F.sum(F.bit_count("word")).cast("bigint").alias("bits_set"))
    every = [x.select("grouping", *groups, "bits_set") for x in (*counted, b)]
    return with_estimate(reduce(DataFrame.unionByName, every), m)
