"""A store of chunks, manifests, signatures and links as Parquet tables; JSON manifests and JSON-lines logs as sources."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from chunklake.functions import predicates as P

VERSION = 1
MANIFEST = "format string, root string, files array<struct<path string, size bigint, hash string, chunks array<struct<hash string, len bigint, dtype string>>>>"
CLAIM = "kind string, name string, rev string, root string, description string, gated string, org string, key string, hash string, reason string, repo string, addrs array<string>, expires bigint"
LOG = f"seq bigint, prev string, statement struct<claim struct<{CLAIM}>, time bigint, signature struct<key string, sig string>>"
MAX_HEADERS = 128 << 20


class NewerVersion(ValueError):
    """The store was written by a newer version."""


class Store:
    """Tables below one folder: chunks by their first two hex digits, manifests, signatures, links, meta."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self._check_version()

    def _check_version(self) -> None:
        """Stamp a new store; refuse one that is newer than this code."""
        files, at = fs.FileSystem.from_uri(self.root if "://" in self.root else f"file://{self.root}")
        path = f"{at}/VERSION"
        if files.get_file_info(path).type == fs.FileType.NotFound:
            files.create_dir(at, recursive=True)
            with files.open_output_stream(f"{path}.new") as f:
                f.write(str(VERSION).encode())
            files.move(f"{path}.new", path)
            return
        with files.open_input_stream(path) as f:
            found = int(f.read().decode().strip() or 0)
        if found > VERSION:
            raise NewerVersion(f"version {found}; this code knows {VERSION}")

    def table(self, name: str, schema: str) -> DataFrame:
        """A table of the store; empty before its first write."""
        files, at = self._files()
        folder = self._folder(name)
        if files.get_file_info(f"{at}/{folder}").type == fs.FileType.NotFound:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(f"{self.root}/{folder}")

    # chunks: put if absent, get, contains

    CHUNKS = "hash string, raw_len bigint, blob binary, hh string"

    def chunks(self) -> DataFrame:
        return self.table("chunks", self.CHUNKS)

    def put(self, blobs: DataFrame) -> int:
        """Append the blobs (hash, raw_len, blob) that the store lacks, each once; gives their number. Putting again adds nothing."""
        w = Window.partitionBy("hash").orderBy(F.octet_length("blob"), "blob")
        one = blobs.filter(P.is_hash(F.col("hash"))).withColumn("_r", F.row_number().over(w)).filter("_r = 1").drop("_r")
        before = self.chunks().count()
        new = one.join(self.chunks().select("hash"), "hash", "left_anti").withColumn("hh", F.substring("hash", 1, 2))
        new.write.mode("append").partitionBy("hh").parquet(f"{self.root}/{self._folder('chunks')}")
        return self.chunks().count() - before

    def get(self, wanted: DataFrame) -> DataFrame:
        """Blobs of the wanted hashes; the two digits let the scan skip the other folders."""
        w = wanted.select("hash").distinct().withColumn("hh", F.substring("hash", 1, 2))
        return self.chunks().join(w, ["hh", "hash"])

    def contains(self, wanted: DataFrame, blocked: DataFrame) -> DataFrame:
        """hash, there: valid, not blocked, and in the store or linked."""
        have = self.chunks().select("hash").unionByName(self.links().select("hash")).distinct().withColumn("_have", F.lit(True))
        bad = blocked.select("hash").distinct().withColumn("_bad", F.lit(True))
        j = wanted.select("hash").distinct().join(have, "hash", "left").join(bad, "hash", "left")
        return j.select("hash", (P.is_hash(F.col("hash")) & F.coalesce("_have", F.lit(False)) & F.col("_bad").isNull()).alias("there"))

    # manifests

    def put_manifests(self, manifests: DataFrame, blocked: DataFrame) -> DataFrame:
        """Append sound manifests and give the refused ones with the reason."""
        ok = F.col("root").isNotNull() & P.is_hash(F.col("root"))
        b = blocked.select(F.col("hash").alias("root"), F.lit(True).alias("_bad")).distinct()
        m = manifests.join(b, "root", "left")
        why = (
            F.when(~P.manifest_known(F.col("format")), "unknown format").when(~ok, "invalid root").when(F.col("_bad"), "blocked")
            .when(P.first_unsafe(F.col("files")).isNotNull(), "unsafe file").when(F.exists("files", lambda f: P.is_unsafe_path(f["path"])), "unsafe path")
            .when(~F.forall("files", lambda f: P.manifest_sound(f["size"], F.transform(f["chunks"], lambda c: c["len"]))), "lengths don't add up")
        )
        m = m.withColumn("refused", why).drop("_bad")
        old = self.manifests().select("root")
        m.filter("refused is null").drop("refused").dropDuplicates(["root"]).join(old, "root", "left_anti").select("format", "root", "files").write.mode("append").parquet(f"{self.root}/{self._folder('manifests')}")
        return m.filter("refused is not null")

    def manifests(self) -> DataFrame:
        return self.table("manifests", MANIFEST)

    def roots(self, blocked: DataFrame) -> DataFrame:
        r = self.manifests().select("root").filter(P.is_hash(F.col("root"))).distinct()
        return r.join(blocked.select(F.col("hash").alias("root")), "root", "left_anti").orderBy("root")

    def block(self, blocked: DataFrame) -> tuple[int, int]:
        """Rewrite chunks and manifests without what is blocked; gives how many of each went.

        A table's rows are in numbered folders (name, name.1, name.2, ...) and a small file tells the one that counts. The rewritten table is
        whole before that file is replaced, and the old folder goes after it: a crash in between loses nothing and blocks on the next run."""
        out = []
        for name, column, df in (("chunks", "hash", self.chunks()), ("manifests", "root", self.manifests())):
            gone = df.join(blocked.select(F.col("hash").alias(column)).distinct(), column, "left_semi").count()
            if gone:
                keep = df.join(blocked.select(F.col("hash").alias(column)).distinct(), column, "left_anti")
                old, n = self._folder(name), self._number(name) + 1
                w = keep.write.mode("overwrite")
                (w.partitionBy("hh") if name == "chunks" else w).parquet(f"{self.root}/{name}.{n}")
                files, at = self._files()
                with files.open_output_stream(f"{at}/{name}.at.new") as f:
                    f.write(str(n).encode())
                files.move(f"{at}/{name}.at.new", f"{at}/{name}.at")
                files.delete_dir(f"{at}/{old}")
            out.append(gone)
        return tuple(out)

    def _files(self) -> tuple[fs.FileSystem, str]:
        return fs.FileSystem.from_uri(self.root if "://" in self.root else f"file://{self.root}")

    def _number(self, name: str) -> int:
        files, at = self._files()
        if files.get_file_info(f"{at}/{name}.at").type == fs.FileType.NotFound:
            return 0
        with files.open_input_stream(f"{at}/{name}.at") as f:
            return int(f.read())

    def _folder(self, name: str) -> str:
        return f"{name}.{n}" if (n := self._number(name)) else name

    # signatures, links, metadata

    SIGNATURES = "root string, key string, sig string, at bigint"

    def add_signatures(self, signatures: DataFrame) -> None:
        """Valid signatures (root, key, sig, at, ok), one per root and key, the first; known ones stay."""
        w = Window.partitionBy("root", "key").orderBy("at", "sig")
        one = signatures.filter("ok").withColumn("_r", F.row_number().over(w)).filter("_r = 1").select("root", "key", "sig", "at")
        one.join(self.signatures().select("root", "key"), ["root", "key"], "left_anti").write.mode("append").parquet(f"{self.root}/{self._folder('signatures')}")

    def signatures(self) -> DataFrame:
        return self.table("signatures", self.SIGNATURES)

    LINKS = "root string, hash string, target string, start bigint, len bigint, size bigint, mtime bigint"

    def links(self) -> DataFrame:
        return self.table("links", self.LINKS)

    def gc_links(self, listing: DataFrame) -> DataFrame:
        """Links whose file (target, size, mtime) is still as it was and whose manifest is still there."""
        now = listing.select("target", "size", "mtime").distinct()
        return self.links().join(now, ["target", "size", "mtime"], "left_semi").join(self.manifests().select("root"), "root", "left_semi")

    META = "key string, value string, at bigint"

    def put_meta(self, rows: DataFrame) -> None:
        rows.filter(P.is_meta_key(F.col("key"))).select("key", "value", "at").write.mode("append").parquet(f"{self.root}/{self._folder('meta')}")

    def meta(self) -> DataFrame:
        """The latest value of each key, in order of keys."""
        return self.table("meta", self.META).groupBy("key").agg(F.max_by("value", F.struct("at", "value")).alias("value")).orderBy("key")


def link_index(manifests: DataFrame, files: DataFrame) -> DataFrame:
    """Where linked files hold each chunk: running offsets in each file; the first place of a hash wins. files: root, path, target, size, mtime."""
    f = manifests.select("root", F.posexplode("files").alias("file_ix", "f")).select("root", "file_ix", "f.path", F.posexplode("f.chunks").alias("chunk_ix", "c"))
    w = Window.partitionBy("root", "file_ix").orderBy("chunk_ix")
    placed = f.select("root", "file_ix", "path", "chunk_ix", "c.hash", "c.len", (F.sum("c.len").over(w) - F.col("c.len")).alias("start"))
    j = placed.join(files, ["root", "path"])
    first = Window.partitionBy("hash").orderBy("root", "file_ix", "chunk_ix")
    return j.withColumn("_r", F.row_number().over(first)).filter("_r = 1").select("root", "hash", "target", "start", "len", "size", "mtime")


def read_linked(links: DataFrame) -> DataFrame:
    """hash, raw, ok of linked chunks (hash, target, start, len, size, mtime), read from their files and hashed again.

    target is a URI or an absolute path of a folder that all workers see. A file that changed (size or time) or is gone gives ok = false, so
    that another copy can be tried."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import hashlib

        for f in frames:
            out = []
            for r in f.itertuples():
                raw = None
                try:
                    files, at = fs.FileSystem.from_uri(r.target if "://" in r.target else f"file://{r.target}")
                    st = files.get_file_info(at)
                    if st.size == r.size and st.mtime_ns == r.mtime:
                        with files.open_input_file(at) as file:
                            raw = file.read_at(r.len, r.start)
                except OSError:
                    pass
                out.append((r.hash, raw, raw is not None and hashlib.sha256(raw).hexdigest() == r.hash))
            yield pd.DataFrame(out, columns=["hash", "raw", "ok"])

    return links.select("hash", "target", "start", "len", "size", "mtime").mapInPandas(run, schema="hash string, raw binary, ok boolean")


def read_manifests(spark: SparkSession, path: str, lines: bool = False) -> tuple[DataFrame, DataFrame]:
    """(manifests, refused) from JSON files, one manifest each, or each line one: the format is looked at first; newer or broken ones are refused."""
    raw = spark.read.text(path, wholetext=not lines)
    j = raw.select("value", F.get_json_object("value", "$.format").alias("format"))
    known = P.manifest_known(F.col("format"))
    m = j.filter(known).select("value", F.from_json("value", MANIFEST, {"mode": "PERMISSIVE"}).alias("m"))
    good = m.filter("m.root is not null and m.files is not null").select("m.*")
    bad = j.filter(~known).select("value").unionByName(m.filter("m.root is null or m.files is null").select("value"))
    return good, bad


def write_manifests(manifests: DataFrame, path: str) -> None:
    manifests.select(F.to_json(F.struct("format", "root", "files")).alias("value")).write.text(path)


def read_log(spark: SparkSession, path: str) -> DataFrame:
    """Entries of a JSON-lines log; blank lines are skipped, broken ones have null fields."""
    return spark.read.schema(LOG).json(path)


def append_log(entries: DataFrame, path: str) -> None:
    entries.select("seq", "prev", "statement").write.mode("append").json(path)


def model_headers(leading: DataFrame) -> DataFrame:
    """root, path, header (JSON) and params of files whose leading chunks hold a whole safetensors header; both are null where a file has a
    header that is longer than MAX_HEADER or no JSON object, so that it is known to be missing.

    leading: root, path, chunk_ix, raw. Chunks stream through in order, file by file, until the header is whole; the rest is skipped."""
    ordered = leading.repartition("root", "path").sortWithinPartitions("root", "path", "chunk_ix").select("root", "path", "raw")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from chunklake.sources.formats import MAX_HEADER, header_length, safetensors_header, safetensors_params

        at, held, done = None, b"", False
        for f in frames:
            out = []
            for root, path, raw in zip(f["root"], f["path"], f["raw"]):
                if (root, path) != at:
                    at, held, done = (root, path), b"", False
                if done or raw is None:
                    continue
                held += raw
                need = header_length(held)
                if need is None or need <= MAX_HEADER and len(held) < 8 + need:
                    continue
                got = safetensors_header(held)
                out.append((root, path, json.dumps(got[1]), sum(safetensors_params(held).values())) if got else (root, path, None, None))
                held, done = b"", True
            yield pd.DataFrame(out, columns=["root", "path", "header", "params"]).astype({"params": "Int64"})

    return ordered.mapInPandas(run, schema="root string, path string, header string, params long")

