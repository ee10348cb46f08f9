"""Compaction of tiny files: balanced longest-first scheduling, streamed writes, an atomically published manifest."""

from __future__ import annotations

import heapq
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chunklake.common import hot_hashes, key, micros, scratch

TARGET = 64 << 20
GROUPS = 4
FLUSH = 4 << 20
MANIFEST = "path string, rows long, bytes long, check decimal(38,0)"
RECORD = "hash string, raw_len long, version byte, codec byte, param byte, payload binary, written long"
_RECORD = pa.schema(
    [("hash", pa.string()), ("raw_len", pa.int64()), ("version", pa.int8()), ("codec", pa.int8()), ("param", pa.int8()), ("payload", pa.binary()), ("written", pa.int64())]
)


def assign_longest_first(units: Iterator[tuple[object, int]], groups: int) -> Iterator[int]:
    """The output group of each unit (name, size), given longest first: always the least loaded, ties the lowest."""
    heap = [(0, g) for g in range(groups)]
    for _, size in units:
        load, g = heap[0]
        heapq.heapreplace(heap, (load + size, g))
        yield g


def mark() -> Column:
    """A number of a record's every column; sums of it don't depend on the order of records."""
    return F.xxhash64(*_RECORD.names).cast("decimal(20,0)")


class _Out:
    """One output file: batches are gathered to row groups of FLUSH bytes; the file gets its name when it is whole."""

    def __init__(self, files: fs.FileSystem, folder: str, name: str):
        self.files, self.path, self.temp = files, f"{folder}/data/{name}", f"{folder}/tmp/{name}.{uuid.uuid4().hex}"
        self.writer = pq.ParquetWriter(files.open_output_stream(self.temp), _RECORD, compression="zstd")
        self.parts, self.held, self.rows, self.check = [], 0, 0, 0

    def add(self, t: pa.Table, check: int) -> None:
        self.parts.append(t)
        self.held += t.nbytes
        self.rows += t.num_rows
        self.check += check
        if self.held >= FLUSH:
            self.flush()

    def flush(self) -> None:
        if self.parts:
            self.writer.write_table(pa.concat_tables(self.parts))
            self.parts, self.held = [], 0

    def close(self) -> tuple[str, int, int, int]:
        self.flush()
        self.writer.close()
        size = self.files.get_file_info(self.temp).size
        self.files.move(self.temp, self.path)  # same name for every attempt of a task, so a repeated attempt replaces its own file
        return self.path, self.rows, size, self.check


def _pack(folder_uri: str, groups: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from decimal import Decimal

        files, folder = fs.FileSystem.from_uri(folder_uri)
        files.create_dir(f"{folder}/data", recursive=True)
        files.create_dir(f"{folder}/tmp", recursive=True)
        outs: dict[int, _Out] = {}
        heap = [(0, g) for g in range(groups)]
        share, last, group = None, None, 0
        for b in batches:  # one share: sorted by size of the unit downwards, then unit
            share = b.column("share")[0].as_py()
            unit = b.column("unit").to_numpy(zero_copy_only=False)
            size = b.column("unit_bytes").to_numpy()
            new = np.empty(len(unit), bool)
            new[0] = last is None or unit[0] != last
            new[1:] = unit[1:] != unit[:-1]
            last = unit[-1]
            begins = np.flatnonzero(new)
            chosen = [group]
            for n in size[begins].tolist():  # one step of the heap for each unit
                load, group = heap[0]
                heapq.heapreplace(heap, (load + n, group))
                chosen.append(group)
            where = np.asarray(chosen)[np.cumsum(new)]
            marks = b.column("mark").to_numpy()
            t = pa.Table.from_batches([b]).select(_RECORD.names).cast(_RECORD)
            for g in np.unique(where).tolist():
                ix = np.flatnonzero(where == g)
                if g not in outs:
                    outs[g] = _Out(files, folder, f"part-{share:06d}-{g:03d}.parquet")
                outs[g].add(t.take(pa.array(ix)), sum(marks[ix].tolist()))
        done = [outs[g].close() for g in sorted(outs)]
        if done:
            paths, rows, sizes, checks = zip(*done)
            yield pa.RecordBatch.from_arrays(
                [pa.array(paths), pa.array(rows, pa.int64()), pa.array(sizes, pa.int64()), pa.array(map(Decimal, checks), pa.decimal128(38, 0))], ["path", "rows", "bytes", "check"]
            )

    return run


def _live(blobs: DataFrame) -> DataFrame:
    return blobs.filter("payload is not null and removed is null").select(
        key("hash").alias("hash"), "file_id", "raw_len", "version", "codec", "param", "payload", F.expr(micros("written")).alias("written")
    ).filter("hash is not null")


def _order() -> list[Column]:
    """Which of the rows of a hash is its record: that with the least of these values."""
    return [F.col("raw_len").isNull(), F.col("written").isNull(), -F.col("written"), *map(F.col, ("file_id", "version", "codec", "param", "mark"))]


def live_records(blobs: DataFrame, shares: int = 1) -> DataFrame:
    """One record per hash that has a payload and isn't removed, with its `share`: the last written one of those that tell raw_len, else
    the last written one; ties: smallest file, then version, codec, param and `mark`.

    Null and blank hashes name no record. Payloads are shuffled once, to the shares of their hashes. Of a hash with 1/512 of the rows
    or more one record is found before that, by partial aggregates, so copies of one record, however many, are no hot group."""
    live = _live(blobs).withColumn("mark", mark())
    hot = hot_hashes(live, ["hash"])
    if hot:
        is_hot = F.xxhash64("hash").isin(hot)
        best = F.min_by(F.struct(*live.columns), F.struct(*_order()))
        live = live.filter(~is_hot).unionByName(live.filter(is_hot).groupBy("hash").agg(best.alias("r")).select("r.*"))
    live = live.withColumn("share", F.pmod(F.xxhash64("hash", F.lit(1)), F.lit(shares)).cast("int")).repartitionById(shares, "share")
    w = Window.partitionBy("share", "hash").orderBy(*_order())
    return live.withColumn("r", F.row_number().over(w)).filter("r = 1").drop("r")


def _totals(blobs: DataFrame) -> tuple[int, int, int]:
    """Number of records, the sum of their marks and their bytes, from the source alone: payloads are only hashed, not shuffled."""
    size = F.octet_length("payload") + F.lit(80)  # bytes of a record's other columns
    best = _live(blobs).withColumn("mark", mark()).select("hash", F.struct(*_order()).alias("o"), size.alias("n")).groupBy("hash").agg(F.min_by("n", "o").alias("n"), F.min("o").alias("o"))
    r = best.agg(F.count(F.lit(1)).alias("rows"), F.coalesce(F.sum("o.mark"), F.lit(0)).cast("decimal(38,0)").alias("check"), F.coalesce(F.sum("n"), F.lit(0)).alias("bytes")).first()
    return r["rows"], int(r["check"]), r["bytes"]


def compact(blobs: DataFrame, folder: str | None = None, target: int = TARGET, groups: int = GROUPS) -> str:
    """Write the live records of loose files into few files of about `target` bytes; gives the folder.

    Records are dealt to shares by hash; within a share the loose files (as far as their records lie in it) are assigned to `groups`
    output files by a least-loaded heap, longest first, and each output file is streamed through pyarrow. Before anything counts, the
    new files are read again: each must hold the records that went into it, and all together those of the source, by number and by a
    sum over every record's content made from the source alone. Then one small file, which alone makes the new files count,
    is put in place. A failed or repeated task leaves at most a file that no manifest names. No live records: a manifest of no files."""
    spark = blobs.sparkSession
    folder = folder or scratch(spark, "compacted")
    files, path = fs.FileSystem.from_uri(folder)
    files.create_dir(f"{path}/data", recursive=True)
    want = _totals(blobs)
    shares = max(1, -(-want[2] // (target * groups)))
    size = F.octet_length("payload") + F.lit(80)
    dealt = (
        live_records(blobs, shares)
        .withColumn("unit_bytes", F.sum(size).over(Window.partitionBy("share", "file_id")).cast("long"))
        .withColumn("unit", F.coalesce("file_id", F.lit(-1).cast("long")))
        .sortWithinPartitions("share", F.desc("unit_bytes"), "unit", "hash")
        .select("share", "unit", "unit_bytes", F.col("mark").cast("long").alias("mark"), *_RECORD.names)
    )
    dealt.mapInArrow(_pack(folder, groups), schema=MANIFEST).write.parquet(f"{folder}/manifest")
    verify(spark, folder, want[:2])
    if files.get_file_info(f"{path}/tmp").type != fs.FileType.NotFound:
        files.delete_dir(f"{path}/tmp")
    _publish(files, path)
    return folder


def _listed(spark, folder: str) -> DataFrame:
    name = F.regexp_extract("path", r"[^/]+$", 0).alias("_file")
    return spark.read.schema(MANIFEST).parquet(f"{folder}/manifest").select(name, "rows", "check")


def _named(spark, folder: str) -> DataFrame:
    return spark.read.schema(RECORD).parquet(f"{folder}/data").withColumn("_file", F.regexp_extract(F.input_file_name(), r"[^/]+$", 0))


def verify(spark, folder: str, want: tuple[int, int]) -> None:
    """Read the new files and hold them against the manifest, file by file, and its totals against the source's (records, sum of marks)."""
    held = _named(spark, folder).groupBy("_file").agg(F.count(F.lit(1)).alias("n"), F.sum(mark()).cast("decimal(38,0)").alias("c"))
    both = _listed(spark, folder).join(held, "_file", "left").withColumn("ok", F.expr("n <=> rows and c <=> check"))
    r = both.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.coalesce(F.sum("c"), F.lit(0)).alias("c"), F.coalesce(F.bool_and("ok"), F.lit(True)).alias("ok")).first()
    if not r["ok"]:
        raise OSError(f"files of {folder} don't hold what went into them")
    if (r["n"], int(r["c"])) != want:
        raise OSError(f"the new files hold {r['n']} records, the old ones {want[0]}, or their content differs")


def _publish(files: fs.FileSystem, path: str) -> None:
    """One file appears whole or not at all: by a rename where the file system has it, else as one object."""
    rename = files.type_name in ("local", "hdfs")
    with files.open_output_stream(f"{path}/CURRENT.tmp" if rename else f"{path}/CURRENT") as f:
        f.write(b"manifest")
    if rename:
        files.move(f"{path}/CURRENT.tmp", f"{path}/CURRENT")


def compacted(spark, folder: str) -> DataFrame:
    """The records of the files that the published manifest names, and no others; a folder without a published manifest is refused."""
    files, path = fs.FileSystem.from_uri(folder)
    if files.get_file_info(f"{path}/CURRENT").type == fs.FileType.NotFound:
        raise FileNotFoundError(f"{folder} has no published manifest")
    return _named(spark, folder).join(_listed(spark, folder).select("_file"), "_file", "left_semi").drop("_file")
