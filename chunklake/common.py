"""Helpers shared by every operator: reading tables, comparing keys, UTC time, the shared folder."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
import zipfile
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

BLANKS = " \t\r\n"
DAY_US = 86_400_000_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def key(c: Column | str) -> Column:
    """A key in its compared form: trimmed, lower case, null when blank."""
    c = F.col(c) if isinstance(c, str) else c
    k = F.lower(F.btrim(c, F.lit(BLANKS)))
    return F.when(k != "", k)


def micros(c: str) -> str:
    """SQL for the microseconds since 1970 of a zoneless timestamp, whatever the session's zone."""
    return (
        f"(unix_date(cast({c} as date)) * 86400L + hour({c}) * 3600 + minute({c}) * 60) * 1000000L"
        f" + cast(extract(second from {c}) * 1000000 as bigint)"
    )


def epoch_day(seconds: Column) -> Column:
    return F.floor(seconds / F.lit(86400)).cast("int")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir. Where that is unset, a temporary one of this machine, but only for a
    local master (tests): executors on other machines would each write to a folder of their own, so a cluster is refused."""
    sc = spark.sparkContext
    root = sc.getConf().get("spark.checkpoint.dir", None)
    if root is None:
        if not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        root = getattr(sc, "_chunklake_shared", None)
        if root is None:
            local = tempfile.mkdtemp(prefix="chunklake-")
            atexit.register(shutil.rmtree, local, ignore_errors=True)
            root = sc._chunklake_shared = f"file://{local}"
            sc.setCheckpointDir(root)
    return root.rstrip("/")


def ship(spark: SparkSession) -> None:
    """Send this package to the session's Python workers, once per context: they need not have it installed nor start in its folder."""
    sc = spark.sparkContext
    if getattr(sc, "_chunklake_shipped", False):
        return
    here = Path(__file__).resolve().parent
    folder = tempfile.mkdtemp(prefix="chunklake-code-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    target = f"{folder}/chunklake_code.zip"
    with zipfile.ZipFile(target, "w") as z:
        for p in sorted(here.rglob("*.py")):
            z.write(p, str(Path(here.name) / p.relative_to(here)))
    sc.addPyFile(target)
    sc._chunklake_shipped = True


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder name under the shared folder."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a table in the shared folder: its lineage is cut and it survives the loss of executors.

    The folder is deleted when the driver's process ends, as results may be read from it until then."""
    spark = df.sparkSession
    path = scratch(spark, name)
    _delete_at_exit(spark, path)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def stored(df: DataFrame, name: str, make: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """make(df), written once for each version of df's files in this session: a view that many queries read. df reads files and nothing else.

    A version is the names, lengths and times of the files, so a changed table is made anew; a view whose folder is gone is, too."""
    spark = df.sparkSession
    sc = spark.sparkContext
    conf, path_of = sc._jsc.hadoopConfiguration(), sc._jvm.org.apache.hadoop.fs.Path

    def status(f: str) -> tuple:
        at = path_of(f)
        s = at.getFileSystem(conf).getFileStatus(at)
        return f, s.getLen(), s.getModificationTime()

    views = sc.__dict__.setdefault("_chunklake_views", {})
    version = (name, tuple(sorted(map(status, df.inputFiles()))))
    if version in views:
        path, schema = views[version]
        at = path_of(path)
        if at.getFileSystem(conf).exists(at):
            return spark.read.schema(schema).parquet(path)
    made = make(df)
    path = scratch(spark, name)
    _delete_at_exit(spark, path)
    made.write.parquet(path)
    views[version] = (path, made.schema)
    return spark.read.schema(made.schema).parquet(path)


def _delete_at_exit(spark: SparkSession, path: str) -> None:
    sc = spark.sparkContext
    if not hasattr(sc, "_chunklake_written"):
        sc._chunklake_written = []
        stop = sc.stop

        def cleaned(*args, **kwargs):
            _delete(sc)
            stop(*args, **kwargs)

        sc.stop = cleaned
        atexit.register(_delete, sc)
    sc._chunklake_written.append(path)


def _delete(sc) -> None:
    """Delete the context's written tables, as far as the context still lives."""
    paths, sc._chunklake_written = sc._chunklake_written, []
    if sc._jsc is None:
        return
    try:
        conf = sc._jsc.hadoopConfiguration()
        for p in paths:
            at = sc._jvm.org.apache.hadoop.fs.Path(p)
            at.getFileSystem(conf).delete(at, True)
    except Exception:  # noqa: BLE001 - the process is ending; what is left is a folder of the shared one
        pass


def spread(df: DataFrame, least: int | None = None) -> DataFrame:
    """df over at least `least` partitions (twice the cores by default); left alone when it has them already."""
    least = least or 2 * df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= least else df.repartition(least)


def hot_hashes(df: DataFrame, keys: list[str], share: float = 1 / 512) -> list[int]:
    """xxhash64 of the keys that hold at least `share` of df's rows: at most 1/share numbers, for `isin` on either side of a join.

    One pass without a shuffle of keys: a frequent-items sketch of bounded size, which misses no key of that share and may add one slightly
    below it. Whoever salts by it must be right for any set of keys, so that only speed depends on it. An empty df has no hot keys."""
    most = int(1 / share)
    top = F.expr(f"approx_top_k(_h, {2 * most}, {16 * most})")
    row = df.select(F.xxhash64(*keys).alias("_h")).agg(F.count(F.lit(1)).alias("n"), top.alias("top")).first()
    return [x["item"] for x in row["top"] or [] if x["count"] >= max(2, row["n"] * share)][:most]


def rank_within(df: DataFrame, by: list[str], order: list[Column], name: str = "rank") -> DataFrame:
    """df with its rows' places (from 1) in an order within each group of `by`, without bringing a group into one task.

    Rows are range-partitioned by group and order and written; each partition counts its own. Only the first group of a partition can have
    rows in an earlier one, so the rows before are one number per partition, added up over the partitions. The order should leave no
    ties, else their places are arbitrary. Null groups are groups."""
    n = df.sparkSession.sparkContext.defaultParallelism
    s = written(df.repartitionByRange(n, *by, *order).withColumn("_part", F.spark_partition_id()), "ranked")
    parts = s.groupBy("_part", *by).agg(F.count(F.lit(1)).alias("_rows"))
    # of a group: its partitions in order; all but its first one begin with it
    w = Window.partitionBy(*by).orderBy("_part")
    parts = parts.withColumn("_before", F.sum("_rows").over(w.rowsBetween(Window.unboundedPreceding, -1))).filter("_before is not null")
    parts = parts.select("_part", *[F.col(b).alias(f"_of_{b}") for b in by], "_before")
    own = F.row_number().over(Window.partitionBy("_part", *by).orderBy(*order))
    same = F.col("s._part") == F.col("p._part")
    for b in by:
        same = same & F.col(f"s.{b}").eqNullSafe(F.col(f"p._of_{b}"))
    ranked = s.withColumn("_own", own).alias("s").join(F.broadcast(parts).alias("p"), same, "left")  # at most one row per partition
    return ranked.select(*[F.col(f"s.`{c}`") for c in df.columns], (F.coalesce("_before", F.lit(0)) + F.col("_own")).cast("int").alias(name))


def global_rank(df: DataFrame, order: list[Column], name: str = "rank") -> DataFrame:
    """df with its rows' places (from 1) in one order over all rows."""
    return rank_within(df, [], order, name)
