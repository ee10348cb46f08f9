"""Queries p1, p5, p7, p8 and p9, with SQL where DuckDB can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chunklake.common import epoch_day, key, table, written
from chunklake.llm import bpe, distinct, frequent, packing, pii

SHARE = 0.01
TOP = 100
HALF = "2025-04-15"


def _bits(df: DataFrame) -> int:
    """Bits for a bitmap that may have to hold as many values as the table has rows."""
    return distinct.bits_for(df.count())


def _fetchers(spark, d):
    return table(spark, d, "receipts").select(
        epoch_day(F.col("time")).alias("day_no"), key("root").alias("root"), "server", "fetcher", "arrived"
    )


def _seen(spark, d):
    return table(spark, d, "seen").select("day_no", "registry", "name", "seen_id", "arrived")


FETCHERS = (_fetchers, ["root", "server", "day_no"], "fetcher")
SEEN = (_seen, ["name", "registry", "day_no"], "seen_id")


def _partials(spark, d, source, keep=None) -> tuple[DataFrame, int]:
    """The stored partial counts of a source (or of its rows to keep), and their bits."""
    rows, groups, value = source
    df = rows(spark, d)
    df = df if keep is None else df.filter(keep)
    m = _bits(df)
    return written(distinct.partials(df, groups, value, m), "partials"), m


def _counts(spark, d, source):
    part, m = _partials(spark, d, source)
    return distinct.cube_counts(part, source[1], m)


def p1_fetchers(spark, d):
    """Distinct fetchers per day, root and server and over every combination of these."""
    return _counts(spark, d, FETCHERS)


def p1_seen(spark, d):
    """Distinct seen ids per day, registry and name and over every combination of these."""
    return _counts(spark, d, SEEN)


def _both(a: DataFrame, b: DataFrame, *cols: str) -> DataFrame:
    a = a.withColumnsRenamed({"root": "group_a", "server": "group_b"}).withColumn("source", F.lit("receipts"))
    b = b.withColumnsRenamed({"name": "group_a", "registry": "group_b"}).withColumn("source", F.lit("seen"))
    return a.unionByName(b).select("source", *cols)


def p1_distinct(spark, d):
    """Both, in one table: source, grouping, day_no, the two other groups, bits_set, estimate, error (its relative standard error)."""
    return _both(p1_fetchers(spark, d), p1_seen(spark, d), "grouping", "day_no", "group_a", "group_b", "bits_set", "estimate", "error")


def p1_partials(spark, d):
    """The mergeable partial counts themselves: the bitmaps of the finest groups by their non-zero words."""
    return _both(_partials(spark, d, FETCHERS)[0], _partials(spark, d, SEEN)[0], "day_no", "group_a", "group_b", "word_ix", "word")


def p1_merged(spark, d):
    """As p1_distinct, from partial counts of what arrived before a moment and of the rest, each with bits of its own, merged."""
    early = F.col("arrived") < F.lit(HALF).cast("timestamp_ntz")

    def of(source):
        halves = [_partials(spark, d, source, early), _partials(spark, d, source, early.isNull() | ~early)]
        part, m = distinct.merge(halves, source[1])
        return distinct.cube_counts(written(part, "merged"), source[1], m)

    return _both(of(FETCHERS), of(SEEN), "grouping", "day_no", "group_a", "group_b", "bits_set", "estimate", "error")


def distinct_bound(spark, d):
    """The exact number of distinct ids per day, server or registry, and in all, and whether the estimate lies within four standard errors of it."""

    def of(source):
        rows, (wide, group, day), value = source
        est = _counts(spark, d, source).filter(F.col("grouping").isin("", day, group))
        df = rows(spark, d).filter(F.col(value).isNotNull())
        n = F.count_distinct(value).alias("n_distinct")
        none = {group: F.lit(None).cast(df.schema[group].dataType), day: F.lit(None).cast(df.schema[day].dataType)}
        exact = [
            df.groupBy(*g).agg(n).select(F.lit(",".join(g)).alias("grouping"), *[F.col(c) if c in g else none[c].alias(c) for c in (group, day)], "n_distinct")
            for g in ([], [day], [group])
        ]
        e = exact[0].unionByName(exact[1]).unionByName(exact[2]).filter("n_distinct > 0")
        same = (F.col("e.grouping") == F.col("s.grouping")) & F.col(f"e.{day}").eqNullSafe(F.col(f"s.{day}")) & F.col(f"e.{group}").eqNullSafe(F.col(f"s.{group}"))
        near = F.abs(F.col("estimate") - F.col("n_distinct")) <= F.greatest(F.lit(1.0), F.lit(4 * distinct.ERROR) * F.col("n_distinct"))
        return e.alias("e").join(est.alias("s"), same, "left").select("e.grouping", f"e.{day}", f"e.{group}", "n_distinct", F.coalesce(near, F.lit(False)).alias("within"))

    return _both(of(FETCHERS), of(SEEN), "day_no", "group_b", "n_distinct", "within")


def _hashes(spark, d):
    return table(spark, d, "chunks").select(key("hash").alias("hash"))


def p5_found(spark, d):
    return frequent.over_share(_hashes(spark, d), SHARE).filter("item is not null").select(F.col("item").alias("hash"))


def p5_topk(spark, d):
    return frequent.top_k(_hashes(spark, d), TOP).select(F.col("item").alias("hash"), "n")


def _texts(spark, d, *more):
    return table(spark, d, "documents").select("doc_id", "text", *more)


def p7_ids(spark, d):
    return bpe.encode(_texts(spark, d)).select("doc_id", "ids")


def _packed(spark, d):
    # the sizes are made once: packing counts and reads them several times
    return packing.pack(written(bpe.count_tokens(_texts(spark, d)), "sizes"), "doc_id", "tokens")


def p8_found(spark, d):
    """An item alone exceeds a container when it was cut, i.e. has a part that doesn't start at 0."""
    return _packed(spark, d).filter("start > 0").select(F.col("item_id").alias("doc_id")).distinct()


def p8_packing(spark, d):
    return _packed(spark, d).withColumnRenamed("item_id", "doc_id")


def _packed_characters(spark, d):
    """The same packing with texts sized in characters, which SQL can count, too."""
    return packing.pack(_texts(spark, d).select("doc_id", F.length("text").alias("n")), "doc_id", "n")


def p8_invariants(spark, d):
    """Per text, sized in characters: how much of it is placed, in how many pieces, whether they cover it without gaps or overlaps,
    and whether all its containers hold what they should and no more than they may."""
    p = _packed_characters(spark, d)
    held = p.groupBy("container").agg(((F.sum("length") == F.max("used")) & (F.max("used") == F.min("used")) & (F.max("used") <= packing.CAPACITY)).alias("ok"))
    return p.join(held, "container").groupBy(F.col("item_id").alias("doc_id")).agg(
        F.sum("length").alias("placed"), F.count(F.lit(1)).alias("pieces"),
        ((F.min("start") == 0) & (F.max(F.col("start") + F.col("length")) == F.sum("length")) & (F.count_distinct("start") == F.count(F.lit(1)))).alias("whole"),
        F.bool_and("ok").alias("fits"),
    )


def p8_fill(spark, d):
    """All texts, sized in characters: pieces, characters, and whether the containers are at most 1 % (and 16) more than needed at least."""
    p = _packed_characters(spark, d)
    n = p.agg(F.count(F.lit(1)).alias("pieces"), F.coalesce(F.sum("length"), F.lit(0)).alias("characters"), F.count_distinct("container").alias("containers"))
    return n.select("pieces", "characters", (F.col("containers") <= F.ceil(F.col("characters") / packing.CAPACITY) * 1.01 + 16).alias("full"))


def p9_found(spark, d):
    """The cases of which the redaction makes pseudonyms, from the same operator."""
    return pii.find_all(_texts(spark, d), table(spark, d, "name_list")).select("doc_id", "kind", "start_at")


def p9_redacted(spark, d):
    return pii.redact_all(_texts(spark, d), table(spark, d, "name_list"))


QUERIES = {f.__name__: f for f in (p1_distinct, p1_fetchers, p1_seen, p1_partials, p1_merged, distinct_bound, p5_found, p5_topk, p7_ids, p8_found, p8_packing, p8_invariants, p8_fill, p9_found, p9_redacted)}

_K = "nullif(lower(trim({0}, ' \t\r\n')), '')"


def _bits_sql(n: str) -> str:
    """SQL of bits_for."""
    return f"""(SELECT coalesce(min(m), 65536) FROM (SELECT CAST(pow(2, k) AS BIGINT) AS m FROM range(16, 48) r(k)), (SELECT {n} AS n)
  WHERE n = 0 OR (n <= 8 * m AND sqrt(m * (exp(n / m) - n / m - 1)) / n <= {distinct.ERROR}))"""


def _linear_counting(source: str, value: str, groups: list[str], names: list[str], tag: str | None = None, rows: str = "(SELECT count(*) FROM t)") -> str:
    """SQL of the same estimate; the bits follow from the table's rows as in bits_for."""
    g = ", ".join(groups)
    sets = [[x for i, x in enumerate(groups) if k >> i & 1] for k in range(1 << len(groups))]
    label = "concat_ws(',', " + ", ".join(f"CASE WHEN grouping({x}) = 0 THEN '{x}' END" for x in groups) + ")"
    out = ", ".join(f"{x} AS {n}" for x, n in zip(groups, names))
    lead = f"'{tag}' AS source, " if tag else ""
    return f"""
(WITH t AS ({source}),
bits AS (SELECT {_bits_sql(rows)} AS m),
b AS (SELECT {g}, CAST(('0x' || substr(md5({value}), 1, 15)) AS BIGINT) & ((SELECT m FROM bits) - 1) AS bit FROM t WHERE {value} IS NOT NULL),
c AS (SELECT {label} AS grp, {g}, count(DISTINCT bit) AS bits_set FROM b GROUP BY GROUPING SETS ({", ".join("(" + ", ".join(s) + ")" for s in sets)})),
e AS (SELECT *, CASE WHEN bits_set < m THEN ln(m / (m - bits_set)) END AS load FROM c, bits WHERE bits_set > 0)
SELECT {lead}grp AS "grouping", {out}, bits_set, CAST(round(m * load) AS BIGINT) AS estimate, round(sqrt(m * (exp(load) - load - 1)) / (m * load), 6) AS error FROM e)"""


def _words_sql(source: str, value: str, groups: list[str], names: list[str], tag: str) -> str:
    """SQL of the partial counts: bit 63 is the sign of a word."""
    out = ", ".join(f"{x} AS {n}" for x, n in zip(groups, names))
    return f"""
(WITH t AS ({source}),
b AS (SELECT {", ".join(groups)}, CAST(('0x' || substr(md5({value}), 1, 15)) AS BIGINT) & ({_bits_sql("(SELECT count(*) FROM t)")} - 1) AS bit FROM t WHERE {value} IS NOT NULL)
SELECT '{tag}' AS source, {out}, bit >> 6 AS word_ix, bit_or(CASE WHEN bit & 63 = 63 THEN CAST('-9223372036854775808' AS BIGINT) ELSE CAST(1 AS BIGINT) << (bit & 63) END) AS word
FROM b GROUP BY {", ".join(groups)}, bit >> 6)"""


def _exact_sql(source: str, value: str, groups: list[str], tag: str) -> str:
    _, b, day = groups
    return f"""
SELECT '{tag}' AS source, day_no, group_b, n_distinct, true AS "within" FROM (
  SELECT {day} AS day_no, {b} AS group_b, count(DISTINCT {value}) AS n_distinct FROM ({source}) WHERE {value} IS NOT NULL GROUP BY GROUPING SETS ((), ({day}), ({b}))
) WHERE n_distinct > 0"""


_FETCHERS = (f"SELECT CAST(floor(time / 86400) AS INTEGER) AS day_no, {_K.format('root')} AS root, server, fetcher, arrived FROM receipts", "fetcher", ["root", "server", "day_no"])
_SEEN = ("SELECT day_no, registry, name, seen_id, arrived FROM seen", "seen_id", ["name", "registry", "day_no"])
_ABC = ["group_a", "group_b", "day_no"]
_LESS = f"(SELECT least(count(*) FILTER (WHERE arrived < TIMESTAMP '{HALF}'), count(*) FILTER (WHERE arrived IS NULL OR arrived >= TIMESTAMP '{HALF}')) FROM t)"

SQL = {
    "p1_fetchers": _linear_counting(*_FETCHERS, ["root", "server", "day_no"]),
    "p1_seen": _linear_counting(*_SEEN, ["name", "registry", "day_no"]),
    "p1_distinct": _linear_counting(*_FETCHERS, _ABC, "receipts") + " UNION ALL " + _linear_counting(*_SEEN, _ABC, "seen"),
    "p1_partials": _words_sql(*_FETCHERS, _ABC, "receipts") + " UNION ALL " + _words_sql(*_SEEN, _ABC, "seen"),
    "p1_merged": _linear_counting(*_FETCHERS, _ABC, "receipts", _LESS) + " UNION ALL " + _linear_counting(*_SEEN, _ABC, "seen", _LESS),
    "distinct_bound": _exact_sql(*_FETCHERS, "receipts") + " UNION ALL " + _exact_sql(*_SEEN, "seen"),
    "p8_invariants": f"""SELECT doc_id, CAST(length(text) AS BIGINT) AS placed, CAST(ceil(length(text) / {packing.CAPACITY}) AS BIGINT) AS pieces, true AS whole, true AS fits
FROM documents WHERE length(text) > 0""",
    "p8_fill": f"""SELECT CAST(sum(ceil(length(text) / {packing.CAPACITY})) AS BIGINT) AS pieces, CAST(sum(length(text)) AS BIGINT) AS characters, true AS "full"
FROM documents WHERE length(text) > 0""",
    "p5_found": f"SELECT hash FROM (SELECT {_K.format('hash')} AS hash, count(*) AS n FROM chunks GROUP BY 1) WHERE hash IS NOT NULL AND n >= {SHARE} * (SELECT count(*) FROM chunks)",
    "p5_topk": f"SELECT hash, n FROM (SELECT {_K.format('hash')} AS hash, count(*) AS n FROM chunks GROUP BY 1) ORDER BY n DESC, hash NULLS FIRST LIMIT {TOP}",
}
