"""Packing files into chunks and back: scan, segment, chunk, hash, encode; rebuild and verify."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from chunklake.functions import predicates as P

PIECES = "path string, file_ix long, chunk_ix int, start long, len long, dtype string, hash string, raw binary"


def views(a: pa.Array) -> Iterator[memoryview | None]:
    """The values of a binary column as views of its buffer, without copies."""
    _, offsets, data = a.buffers()
    wide = pa.types.is_large_binary(a.type)
    at = np.frombuffer(offsets, np.int64 if wide else np.int32)[a.offset : a.offset + len(a) + 1].tolist()
    whole = memoryview(data) if data is not None else memoryview(b"")
    there = a.is_valid().to_pylist() if a.null_count else None
    for i in range(len(a)):
        yield whole[at[i] : at[i + 1]] if there is None or there[i] else None


def scan(spark: SparkSession, folder: str) -> DataFrame:
    """path (relative), size, content of the regular files below a folder; file_ix is their order by path."""
    root = folder.rstrip("/") + "/"
    f = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    rel = F.expr(f"substring(path, instr(path, '{root}') + {len(root)})")
    some = f.select(rel.alias("path"), F.col("length").alias("size"), "content")
    # Spark's file scan leaves out empty files; the listing (names and sizes only, as Spark itself makes it) has them
    files, at = fs.FileSystem.from_uri(folder if "://" in folder else f"file://{folder}")
    empty = [(i.path[len(at.rstrip("/")) + 1 :], 0, b"") for i in files.get_file_info(fs.FileSelector(at, recursive=True)) if i.type == fs.FileType.File and i.size == 0]
    return some.unionByName(spark.createDataFrame(empty, "path string, size long, content binary")) if empty else some


def safe(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(kept, refused) by extension, before any content is read."""
    bad = P.is_unsafe(F.col("path"))
    return files.filter(~bad), files.filter(bad).select("path", "size")


def cut(files: DataFrame) -> DataFrame:
    """The chunks of files (path, content): one row each, with its bytes and SHA-256. Empty files have none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from chunklake.functions.chunker import chunk
        from chunklake.sources.formats import file_segments

        for b in batches:
            for path, content in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                data = content or b""
                rows = [(path, i, a, z - a, t, hashlib.sha256(data[a:z]).hexdigest(), data[a:z]) for i, (a, z, t) in enumerate(chunk(data, file_segments(path, data)))]
                for i in range(0, len(rows), 64):
                    c = list(zip(*rows[i : i + 64]))
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(c[0]), pa.array(c[1], pa.int32()), pa.array(c[2], pa.int64()), pa.array(c[3], pa.int64()), pa.array(c[4]), pa.array(c[5]), pa.array(c[6], pa.binary())],
                        ["path", "chunk_ix", "start", "len", "dtype", "hash", "raw"],
                    )

    return files.select("path", "content").mapInArrow(run, schema="path string, chunk_ix int, start long, len long, dtype string, hash string, raw binary")


def large_segments(paths: DataFrame) -> DataFrame:
    """path, size, seg_ix, start, end, dtype of files (path as a URI or absolute path) of any size: only their headers are read.

    Safetensors headers are read whole, of GGUF files as much as it takes; other files are one raw segment."""

    def run(frames):
        import struct

        import pandas as pd

        from chunklake.sources import formats

        for f in frames:
            out = []
            for path in f["path"]:
                files, at = fs.FileSystem.from_uri(path if "://" in path else f"file://{path}")
                size = files.get_file_info(at).size
                with files.open_input_file(at) as file:
                    ext = path.rpartition(".")[2]
                    segments = None
                    if ext == "safetensors" and size >= 8:
                        (n,) = struct.unpack("<Q", file.read_at(8, 0))
                        if n <= formats.MAX_HEADER:
                            segments = formats.safetensors_segments(file.read_at(8 + n, 0), size)
                    elif ext == "gguf":
                        n = 1 << 20
                        while segments is None:
                            n = min(n, size)
                            head = file.read_at(n, 0)
                            try:
                                formats.gguf_header(head)
                                segments = formats.gguf_segments(head, size)
                            except formats.FormatError:
                                segments = [(0, size, "raw")] if n >= size or n >= formats.MAX_HEADER else None
                            n *= 8
                    for i, (a, z, t) in enumerate(segments if segments is not None else [(0, size, "raw")] if size else []):
                        out.append((path, size, i, a, z, t))
            yield pd.DataFrame(out, columns=["path", "size", "seg_ix", "start", "end", "dtype"])

    return paths.select("path").mapInPandas(run, schema="path string, size long, seg_ix int, start long, end long, dtype string")


def cut_large(segments: DataFrame, tasks: int | None = None) -> DataFrame:
    """The chunks of segments, as `cut` gives them (seg_ix and the place in it instead of chunk_ix): each segment is read in windows of 32 MiB
    by the task that has it, so neither a file nor a segment has to fit into memory, and one huge file is spread over many tasks by its segments."""
    n = tasks or 2 * segments.sparkSession.sparkContext.defaultParallelism

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from chunklake.functions.chunker import chunk_stream

        for b in batches:
            for path, ix, start, end, dtype in zip(*(b.column(i).to_pylist() for i in range(5))):
                files, at = fs.FileSystem.from_uri(path if "://" in path else f"file://{path}")
                with files.open_input_file(at) as file:
                    for a, z, raw in chunk_stream(lambda p, n, file=file: file.read_at(n, p), start, end, dtype):
                        yield pa.RecordBatch.from_arrays(
                            [pa.array([path]), pa.array([ix], pa.int32()), pa.array([a], pa.int64()), pa.array([z - a], pa.int64()), pa.array([dtype]), pa.array([hashlib.sha256(raw).hexdigest()]), pa.array([raw], pa.binary())],
                            ["path", "seg_ix", "start", "len", "dtype", "hash", "raw"],
                        )

    return segments.select("path", "seg_ix", "start", "end", "dtype").repartition(n, "path", "seg_ix").mapInArrow(
        run, schema="path string, seg_ix int, start long, len long, dtype string, hash string, raw binary"
    )


def encode(pieces: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """Blobs of chunks that `known` (hash) lacks, one per hash: hash, raw_len, blob. The anti-join comes before the work."""
    p = pieces.join(known.select("hash").distinct(), "hash", "left_anti") if known is not None else pieces
    p = p.withColumn("_r", F.row_number().over(Window.partitionBy("hash").orderBy("path", "chunk_ix"))).filter("_r = 1")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from chunklake.functions import codec

        for b in batches:
            raws = list(views(b.column(1)))
            blobs = [codec.encode(r, t) for r, t in zip(raws, b.column(2).to_pylist())]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([len(r) for r in raws], pa.int64()), pa.array(blobs, pa.binary())], ["hash", "raw_len", "blob"])

    return p.select("hash", "raw", "dtype").mapInArrow(run, schema="hash string, raw_len long, blob binary")


def decode(blobs: DataFrame) -> DataFrame:
    """hash, raw of blobs (hash, raw_len, blob), and ok: whether the bytes decode and hash to it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from chunklake.functions import codec

        for b in batches:
            raws, oks = [], []
            for h, n, blob in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), views(b.column(2))):
                try:
                    raw = codec.decode(blob, n) if blob is not None else None
                except codec.BlobError:
                    raw = None
                raws.append(raw)
                oks.append(raw is not None and hashlib.sha256(raw).hexdigest() == h)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(raws, pa.binary()), pa.array(oks)], ["hash", "raw", "ok"])

    return blobs.select("hash", "raw_len", "blob").mapInArrow(run, schema="hash string, raw binary, ok boolean")


def manifest_files(pieces: DataFrame, files: DataFrame) -> DataFrame:
    """path, size, hash and line of each file of a manifest; the line commits to all of these and to its chunks in order, but not to their types."""
    chunks = F.array_sort(F.collect_list(F.struct("chunk_ix", "hash", "len")))
    c = pieces.groupBy("path").agg(chunks.alias("c"))
    f = files.select("path", "size", F.sha2("content", 256).alias("hash")).join(c, "path", "left")
    none = F.array().cast("array<struct<chunk_ix:int,hash:string,len:bigint>>")
    f = f.withColumn("c", F.coalesce("c", none))
    line = F.concat_ws("|", "path", "size", "hash", F.size("c").cast("string"), F.array_join(F.transform("c", lambda x: F.concat_ws(":", x["hash"], x["len"].cast("string"))), ","))
    return f.select("path", "size", "hash", line.alias("line"))


def manifest_root(listed: DataFrame) -> DataFrame:
    """root, files, size of a manifest. The root is a tree: 4,096 buckets of files by the hash of their path, each hashed over its sorted lines,
    and the hash over the buckets; so no task holds more than one bucket, and no order over all files is needed."""
    bucket = F.substring(F.sha2("path", 256), 1, 3)
    b = listed.groupBy(bucket.alias("bucket")).agg(F.sha2(F.array_join(F.array_sort(F.collect_list("line")), "\n"), 256).alias("h"), F.count(F.lit(1)).alias("files"), F.sum("size").alias("size"))
    top = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("bucket", "h"))), lambda x: F.concat(x["bucket"], x["h"])), "")
    return b.agg(F.sha2(F.concat(F.lit("manifest/v2|"), top), 256).alias("root"), F.coalesce(F.sum("files"), F.lit(0)).alias("files"), F.coalesce(F.sum("size"), F.lit(0)).alias("size"))


def unpack(pieces: DataFrame, raws: DataFrame, files: DataFrame, folder: str) -> DataFrame:
    """Rebuild files below a folder (a URI or absolute path that all workers see): chunks in order, each verified, then the file's hash; path,
    ok. Paths that could leave the folder are refused.

    Each task writes its files from sorted rows, chunk by chunk; a file gets its name only when it is whole and right."""
    want = files.select("path", F.col("hash").alias("file_hash"))
    good = raws.filter("ok").select("hash", "raw")
    rows = want.join(pieces.select("path", "chunk_ix", "hash"), "path", "left").join(good, "hash", "left")
    rows = rows.select("path", "file_hash", F.coalesce("chunk_ix", F.lit(-1)).alias("chunk_ix"), "raw", P.is_unsafe_path(F.col("path")).alias("bad"))
    rows = rows.repartition("path").sortWithinPartitions("path", "chunk_ix")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import uuid

        files, root = fs.FileSystem.from_uri(folder if "://" in folder else f"file://{folder}")
        path, out, digest, whole, hash_, temp = None, None, None, True, None, ""
        done: list[tuple[str, bool]] = []

        def close():
            if path is None:
                return
            ok = whole
            if out is not None:
                out.close()
                ok = whole and digest.hexdigest() == hash_
                files.move(temp, f"{root}/{path}") if ok else files.delete_file(temp)
            done.append((path, ok))

        for b in batches:
            for p, h, ix, raw, bad in zip(*(b.column(i).to_pylist() for i in range(5))):
                if p != path:
                    close()
                    path, hash_, whole, out, digest = p, h, not bad, None, hashlib.sha256()
                    if not bad:
                        files.create_dir(f"{root}/{p}".rpartition("/")[0], recursive=True)
                        temp = f"{root}/{p}.{uuid.uuid4().hex}"
                        out = files.open_output_stream(temp)
                if ix >= 0 and out is not None:
                    if raw is None:
                        whole = False
                    else:
                        out.write(raw)
                        digest.update(raw)
        close()
        if done:
            yield pa.RecordBatch.from_arrays([pa.array([d[0] for d in done]), pa.array([d[1] for d in done])], ["path", "ok"])

    return rows.mapInArrow(run, schema="path string, ok boolean")
