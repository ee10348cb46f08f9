"""Queries that write tables, files and stores into the shared folder and read them back, with SQL over the tables they were made of."""

from __future__ import annotations

import struct

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chunklake.common import key, scratch, table, written
from chunklake.functions import predicates as P
from chunklake.functions import scalars as S
from chunklake.functions.hashing import ed25519_sign
from chunklake.operators import accounting as A
from chunklake.operators import planning as L
from chunklake.operators import registry as R
from chunklake.operators.signatures import verified
from chunklake.plans import pipeline
from chunklake.queries import accounting as Q
from chunklake.queries.planning import _CH, _chunks
from chunklake.queries.problems import _K
from chunklake.queries.streams import _files
from chunklake.sources import store as st


def _store(spark) -> st.Store:
    return st.Store(spark, scratch(spark, "store"))


def _texts(spark, d) -> DataFrame:
    t = table(spark, d, "documents").filter("text is not null")
    return t.select("doc_id", "lang", F.sha2("text", 256).alias("hash"), F.octet_length("text").cast("bigint").alias("raw_len"), F.encode("text", "UTF-8").alias("blob"))


def store_chunks(spark, d):
    """Every text put into a store as a chunk, twice; those of one language read back and hashed again."""
    s, t = _store(spark), _texts(spark, d)
    first, second = s.put(t), s.put(t)
    got = s.get(t.filter("lang = 'en'"))
    return got.select("hash", "raw_len", (F.sha2("blob", 256) == F.col("hash")).alias("ok"), F.lit(second).cast("bigint").alias("again"), (F.lit(first) > 0).alias("some"))


def store_has(spark, d):
    """Which texts a store has: those it was given, but for the blocked ones (of one language); an invalid hash is never there."""
    s, t = _store(spark), _texts(spark, d)
    s.put(t.filter("coalesce(lang, '') <> 'de'"))
    asked = t.select("hash").unionByName(t.select(F.upper("hash").alias("hash")))
    return s.contains(asked, t.filter("lang = 'fr'").select("hash"))


def store_blocked(spark, d):
    """Chunks left in a store after blocking those of one language."""
    s, t = _store(spark), _texts(spark, d)
    s.put(t)
    gone, _ = s.block(t.filter("lang = 'es'").select("hash"))
    return s.chunks().select("hash", "raw_len", F.lit(gone).cast("bigint").alias("gone"))


def _manifests(spark, d) -> DataFrame:
    """The manifests with the chunk lists of their files, as one record of each root."""
    m = table(spark, d, "manifests").select(F.coalesce("format", F.lit("none")).alias("format"), key("root").alias("root"), "files").filter("root is not null")
    m = m.groupBy("root").agg(F.min("format").alias("format"), F.min_by("files", F.struct("format", F.to_json("files"))).alias("files"))
    f = m.select("root", "format", F.posexplode("files").alias("ix", "f"))
    c = _chunks(spark, d).filter("path is not null and hash is not null")
    c = c.groupBy("root", "path").agg(F.array_sort(F.collect_list(F.struct("chunk_ix", "hash", "len", "dtype"))).alias("c"))
    j = f.join(c, (f["root"] == c["root"]) & (F.col("f.path") == c["path"]), "left").select(f["root"], "format", "ix", "f", "c")
    chunks = F.transform(F.coalesce("c", F.array()), lambda x: F.struct(x["hash"].alias("hash"), x["len"].alias("len"), x["dtype"].alias("dtype")))
    file = F.struct(F.col("ix"), F.struct(F.col("f.path").alias("path"), F.col("f.size").alias("size"), F.col("f.hash").alias("hash"), chunks.alias("chunks")).alias("file"))
    return j.groupBy("root", "format").agg(F.transform(F.array_sort(F.collect_list(file)), lambda x: x["file"]).alias("files")).select("format", "root", "files")


def store_manifests(spark, d):
    """Manifests put into a store: those refused, with the reason, and those it lists afterwards, in order."""
    s = _store(spark)
    m = written(_manifests(spark, d), "manifests")
    bad = m.filter("root like '0%'").select(F.col("root").alias("hash"))
    refused = s.put_manifests(m, bad).select("root", "refused")
    return refused.unionByName(s.roots(bad).select("root", F.lit("").alias("refused")))


def manifests_json(spark, d):
    """Manifests written as JSON and read back; their files, bytes and chunks."""
    path = scratch(spark, "json")
    st.write_manifests(_manifests(spark, d), path)
    good, bad = st.read_manifests(spark, path, lines=True)
    refused = bad.select(F.get_json_object("value", "$.format").alias("format"), F.get_json_object("value", "$.root").alias("root"), F.lit(-1).alias("files"), F.lit(-1).cast("bigint").alias("chunks"))
    return refused.unionByName(good.select("format", "root", F.size("files").alias("files"), F.aggregate("files", F.lit(0).cast("bigint"), lambda a, f: a + F.size(f["chunks"])).alias("chunks")))


def log_json(spark, d):
    """The log appended to JSON lines in two steps and read back: entries and their times per kind."""
    path = scratch(spark, "log")
    log = table(spark, d, "log").filter("statement is not null")
    st.append_log(log.filter("seq < 500"), path)
    st.append_log(log.filter("seq >= 500 or seq is null"), path)
    e = st.read_log(spark, path)
    return e.groupBy(F.col("statement.claim.kind").alias("kind")).agg(F.count(F.lit(1)).alias("n"), F.min("statement.time").alias("first"), F.max("seq").alias("last"), F.count_distinct("statement.signature.sig").alias("sigs"))


def store_meta(spark, d):
    """Saves of downloads as metadata, a key per registry and day: the latest value of each."""
    s = _store(spark)
    r = table(spark, d, "recent").filter("name is not null and registry is not null and downloads is not null and saved is not null")
    at = F.expr("unix_date(cast(saved as date)) * 86400L + hour(saved) * 3600 + minute(saved) * 60 + second(saved)")
    k = F.concat_ws("/", "registry", F.date_format("day", "yyyy-MM-dd"))
    s.put_meta(r.select(k.alias("key"), F.col("downloads").cast("string").alias("value"), at.alias("at")).unionByName(r.select(F.concat(k, F.lit("/../x")).alias("key"), F.lit("1").alias("value"), at.alias("at"))))
    return s.meta()


SECRETS = [bytes([i]) * 32 for i in (1, 2)]


def _signed(spark, d) -> DataFrame:
    """A signature of each root by one of two keys; of roots that begin with an even digit it is of another text."""
    roots = table(spark, d, "manifests").select(key("root").alias("root")).filter("root is not null").distinct()

    def run(frames):
        for f in frames:
            out = []
            for root in f["root"]:
                secret = SECRETS[int(root[1], 16) % 2] if root[1] in "0123456789abcdef" else SECRETS[0]
                public, sig = ed25519_sign(secret, (root if root[0] in "13579bdf" else root + "!").encode())
                out.append((root, public.hex(), sig.hex(), len(root)))
            yield __import__("pandas").DataFrame(out, columns=["root", "key", "sig", "at"])

    return written(roots.repartition(spark.sparkContext.defaultParallelism).mapInPandas(run, "root string, key string, sig string, at long"), "signed")


def signatures_checked(spark, d):
    """Which signatures of roots are valid, and which a store keeps when they are added twice."""
    s = _store(spark)
    sigs = written(verified(_signed(spark, d), "key", F.encode("root", "UTF-8"), "sig"), "verified")
    s.add_signatures(sigs)
    s.add_signatures(sigs)
    kept = s.signatures().groupBy("root").agg(F.count(F.lit(1)).alias("kept"))
    return sigs.join(kept, "root", "left").select("root", "ok", F.coalesce("kept", F.lit(0)).cast("bigint").alias("kept"))


def trusted_signers(spark, d):
    """Which roots have a valid signature by a trusted key, the first of the two."""
    sigs = verified(_signed(spark, d), "key", F.encode("root", "UTF-8"), "sig")
    public = ed25519_sign(SECRETS[0], b"")[0].hex()
    return sigs.groupBy("root").agg(F.collect_list(F.struct("key", "ok")).alias("s")).select("root", P.trusted(F.col("s"), F.array(F.lit(public))).alias("trusted"))


def _safetensors(spark, d) -> DataFrame:
    """A safetensors file of each text: a BF16 tensor of its bytes but the last odd one, after it a raw one, and a gap of three bytes behind."""
    t = table(spark, d, "documents").filter("octet_length(text) >= 2").select("doc_id", F.encode("text", "UTF-8").alias("b"))
    n = F.octet_length("b")
    even = (n - n % 2).cast("string")
    header = F.concat(
        F.lit('{"__metadata__":{"x":"y"},"layer.0.w":{"dtype":"BF16","shape":[2,'), F.floor(n / 4).cast("string"), F.lit('],"data_offsets":[0,'), even, F.lit("]}"),
        F.lit(',"tail":{"dtype":"U8","shape":['), (n % 2).cast("string"), F.lit('],"data_offsets":['), even, F.lit(","), n.cast("string"), F.lit("]}}"),
    )
    h = F.encode(header, "UTF-8")
    size = F.hex(F.octet_length(h))
    little = F.unhex(F.rpad(F.array_join(F.reverse(F.regexp_extract_all(F.lpad(size, 8, "0"), F.lit("(..)"), F.lit(1))), ""), 16, "0"))
    return t.select("doc_id", F.concat(F.lit("m/"), F.col("doc_id").cast("string"), F.lit(".safetensors")).alias("path"), n.cast("bigint").alias("n"), F.octet_length(h).cast("bigint").alias("h"), F.concat(little, h, F.col("b"), F.unhex(F.lit("000000"))).alias("content"))


def safetensors_segments(spark, d):
    """Segments of safetensors files made of the texts, and the length prefix read as an integer."""
    f = _safetensors(spark, d)

    def run(frames):
        import pandas as pd

        from chunklake.sources import formats

        for x in frames:
            out = []
            for i, path, content in zip(x["doc_id"], x["path"], x["content"]):
                out += [(i, j, a, z, t) for j, (a, z, t) in enumerate(formats.file_segments(path, content))]
            yield pd.DataFrame(out, columns=["doc_id", "seg_ix", "lo", "hi", "dtype"])

    s = f.select("doc_id", "path", "content").mapInPandas(run, "doc_id long, seg_ix int, lo long, hi long, dtype string")
    return s.join(f.select("doc_id", S.le_integer(F.substring("content", 1, 8)).alias("prefix")), "doc_id")


def safetensors_headers(spark, d):
    """Headers of the same files from their leading chunks of 16 bytes, and their parameters."""
    f = _safetensors(spark, d)
    k = F.explode(F.sequence(F.lit(0), F.ceil((F.col("h") + 8) / 16).cast("int") - 1))
    lead = f.select(F.lit("r").alias("root"), "path", "content", k.alias("chunk_ix"))
    lead = lead.select("root", "path", "chunk_ix", F.expr("substring(content, chunk_ix * 16 + 1, 16)").alias("raw"))
    h = st.model_headers(lead)
    return h.select("path", "params", F.get_json_object("header", "$.tail.dtype").alias("tail"))


def gguf_segments(spark, d):
    """Segments and parameters of GGUF files with three tensors: F32 of a text's length, one of a type of unknown size, and BF16."""
    t = table(spark, d, "documents").filter("text is not null").select("doc_id", F.length("text").cast("bigint").alias("n"))

    def run(frames):
        import pandas as pd

        from chunklake.sources import formats

        text = lambda s: struct.pack("<Q", len(s)) + s
        for x in frames:
            out = []
            for i, n in zip(x["doc_id"], x["n"]):
                offsets = [0, -(-4 * n // 64) * 64]
                offsets.append(offsets[1] + 128)
                head = b"GGUF" + struct.pack("<IQQ", 3, 3, 1) + text(b"general.alignment") + struct.pack("<II", 4, 64)
                for name, kind, dims, at in zip((b"a", b"b", b"c"), (0, 19, 30), ((n,), (256,), (2, n)), offsets):
                    head += text(name) + struct.pack("<I", len(dims)) + struct.pack(f"<{len(dims)}Q", *dims) + struct.pack("<IQ", kind, at)
                first = -(-len(head) // 64) * 64
                data = head.ljust(first, b"\0") + bytes(offsets[2] + 4 * n + 1)
                params = sum(formats.gguf_params(data).values())
                out += [(i, j, a, z, k, params) for j, (a, z, k) in enumerate(formats.file_segments("x.gguf", data))]
            yield pd.DataFrame(out, columns=["doc_id", "seg_ix", "lo", "hi", "dtype", "params"])

    return t.mapInPandas(run, "doc_id long, seg_ix int, lo long, hi long, dtype string, params long")


def files_unpacked(spark, d):
    """Every text as a file: cut, encoded, decoded, rebuilt in a folder, and the folder scanned: each file's path, size and hash."""
    f = written(_files(spark, d), "texts")
    c = written(pipeline.cut(f), "pieces")
    m = pipeline.manifest_files(c, f)
    folder = scratch(spark, "unpacked")
    done = written(pipeline.unpack(c, pipeline.decode(pipeline.encode(c)), m, folder), "done")
    got = pipeline.scan(spark, folder).select("path", "size", F.sha2("content", 256).alias("sha256"))
    return got.join(done, "path", "left").select("path", "size", "sha256", F.coalesce("ok", F.lit(False)).alias("ok"))


def pack_lines(spark, d):
    """The lines of the manifest of all texts that are one chunk each: what its root commits to."""
    f = written(_files(spark, d), "texts").filter("size between 1 and 1000")
    return pipeline.manifest_files(pipeline.cut(f), f).select("path", "line")


def pack_root(spark, d):
    """The root of the manifest of all texts of at most 1,000 bytes, which are one chunk each."""
    f = written(_files(spark, d), "texts").filter("size between 1 and 1000")
    return pipeline.manifest_root(pipeline.manifest_files(pipeline.cut(f), f))


def byte_planes(spark, d):
    """Sums of the byte planes of the embeddings as F32, split plainly and with the exponent alone, and whether both join again."""
    e = table(spark, d, "embeddings").select("embedding")

    def run(frames):
        import numpy as np
        import pandas as pd

        from chunklake.functions import codec

        for f in frames:
            out = []
            for v in f["embedding"]:
                raw = np.asarray(v, "<f4").tobytes()
                for kind, split, join in (("plain", codec.split_planes, codec.join_planes), ("exponent", codec.split_exponent, codec.join_exponent)):
                    planes = split(raw, 4)
                    n = len(raw) // 4
                    ok = join(planes, 4) == raw
                    out += [(kind, i, int(np.frombuffer(planes, np.uint8)[i * n : (i + 1) * n].sum()), ok) for i in range(4)]
            yield pd.DataFrame(out, columns=["kind", "plane", "total", "ok"])

    return e.mapInPandas(run, "kind string, plane int, total long, ok boolean").groupBy("kind", "plane").agg(F.sum("total").alias("total"), F.bool_and("ok").alias("ok"))


def links_kept(spark, d):
    """The index of linked files' chunks (first place of each), and which links stay when the files of one in three roots have changed."""
    m = written(_manifests(spark, d), "manifests")
    s = _store(spark)
    s.put_manifests(m, m.limit(0).select(F.col("root").alias("hash")))
    f = m.select("root", F.explode("files").alias("f")).select("root", "f.path", F.concat_ws("/", F.lit("/srv"), "root", "f.path").alias("target"), "f.size", F.lit(7).cast("bigint").alias("mtime"))
    link = st.link_index(m, f)
    link.write.mode("append").parquet(f"{s.root}/links")
    now = f.withColumn("mtime", F.when(F.substring("root", 1, 1).isin(*"01234"), 8).otherwise(F.col("mtime")))
    kept = s.gc_links(now).select("hash", F.lit(True).alias("kept"))
    return link.join(kept, "hash", "left").select("hash", "root", "start", "len", F.coalesce("kept", F.lit(False)).alias("kept"))


def linked_read(spark, d):
    """Chunks read from linked files: texts lie one behind the other in a file per source; those whose file is said to be another size aren't read."""
    folder = scratch(spark, "linked")
    t = _texts(spark, d).join(table(spark, d, "documents").select("doc_id", "source"), "doc_id").filter("source is not null")

    def put(frames):
        import pandas as pd
        from pyarrow import fs

        files, at = fs.FileSystem.from_uri(folder)
        files.create_dir(at, recursive=True)
        for f in frames:
            out = []
            for i, h, blob in zip(f["doc_id"], f["hash"], f["blob"]):
                target = f"{at}/{i // 100}-{i}"
                with files.open_output_stream(target) as x:
                    x.write(b"head")
                    x.write(blob)
                info = files.get_file_info(target)
                out.append((i, h, f"{folder}/{i // 100}-{i}", len(blob), info.size + (i % 5 == 0), info.mtime_ns))
            yield pd.DataFrame(out, columns=["doc_id", "hash", "target", "len", "size", "mtime"])

    links = written(t.mapInPandas(put, "doc_id long, hash string, target string, len long, size long, mtime long"), "links").withColumn("start", F.lit(4).cast("bigint"))
    got = st.read_linked(links)
    return got.groupBy("hash", "ok").agg(F.count(F.lit(1)).alias("n"))


def probes_admitted(spark, d):
    """Probes by anchors with at least 100 of them, of registered nodes, and where a model was held, one that the node claims; at least an hour apart."""
    p = written(Q._probes(spark, d), "probes")
    anchors = p.groupBy("anchor").agg(F.count(F.lit(1)).alias("n")).filter("n >= 100")
    return A.accepted_probes(p, 3600, anchors, Q._nodes(spark, d)).select("probe_id", "anchor", "node", "t")


def chunk_peers(spark, d):
    """From whom to fetch each chunk: the nodes that a probe found holding a root of which the chunk's block is a part, one in turn."""
    held = A.held(A.accepted_probes(Q._probes(spark, d)), Q.AT)
    offered = _chunks(spark, d).select("root", "block_id").distinct().join(held, "root").select("block_id", "peer")
    return L.chunk_peers(_chunks(spark, d), offered).select("hash", F.array_join("peers", ",").alias("peers"))


def peers_all(spark, d):
    """The peers known from receipts and from probes, each once."""
    r = table(spark, d, "receipts").select(F.col("server").alias("peer"))
    return L.peers(r, table(spark, d, "receipts").select(F.col("fetcher").alias("peer")), table(spark, d, "probes").select(F.col("node").alias("peer")))


def subnets_admitted(spark, d):
    """Receipts as joins of a fetcher to its server's subnet, of which three may be in at once; every third one is a leave."""
    r = Q._receipts(spark, d).select(F.col("server").alias("subnet"), F.substring("fetcher", 1, 1).alias("peer"), F.col("receipt_id").alias("seq"), F.when(F.col("receipt_id") % 3 == 0, "leave").otherwise("join").alias("kind"))
    return L.subnet_cap(r, 3).select("seq", "admitted")


def sends_paced(spark, d):
    """When each receipt's bytes may go at 1,000,000 a second per server, in order of time."""
    r = Q._receipts(spark, d)
    from pyspark.sql import Window

    n = F.row_number().over(Window.partitionBy("server").orderBy("time", "receipt_id"))
    s = r.select(F.col("server").alias("source"), n.cast("bigint").alias("seq"), F.col("time").cast("double").alias("t"), F.col("bytes").alias("bytes"))
    return L.token_bucket(s, 1_000_000.0).select("source", "seq", F.round(F.col("at"), 3).alias("at"))


def more_predicates(spark, d):
    """Display names, repos and commits, clock skew, tickets and answers to lookups, over the customers."""
    c = table(spark, d, "customer").select(F.col("c_custkey").alias("k"), F.col("c_name").alias("n"), F.col("c_mktsegment").alias("seg"))
    c = c.withColumn("odd", F.concat(F.when(F.col("k") % 2 == 0, " ").otherwise(""), F.repeat("n", (F.col("k") % 4).cast("int"))))
    hex40 = F.substring(F.sha2("n", 256), 1, F.when(F.col("k") % 3 == 0, 41).otherwise(40))
    issuers = F.array(F.lit("AUTOMOBILE"), F.lit("BUILDING"))
    return c.select(
        "k", P.is_display_name(F.col("odd")).alias("display"), P.is_repo(F.concat_ws("/", "seg", F.replace("n", F.lit("#"), F.lit("_")))).alias("repo"), P.is_repo(F.col("n")).alias("no_repo"), P.is_commit(hex40).alias("commit"),
        P.within_skew(F.col("k") * 7, F.lit(5000)).alias("skew"),
        P.ticket_valid(F.col("seg"), issuers, F.lit("p"), F.when(F.col("k") % 5 == 0, "q").otherwise("p"), F.col("k"), F.lit(100), F.col("k") % 7 != 0).alias("ticket"),
        P.entry_answers(F.when(F.col("k") % 2 == 0, "publish").otherwise("gate"), F.lit("a/b"), F.lit("v"), F.sha2("n", 256), F.lit("a/b"), F.when(F.col("k") % 3 == 0, "v").otherwise("w"), F.lit(True)).alias("answers"),
    )


def auth_challenges(spark, d):
    """The parts of authentication headers, and the next page of Link headers, made of the parts table."""
    p = table(spark, d, "part").select(F.col("p_partkey").alias("k"), "p_brand", "p_type")
    h = F.concat(F.lit('Bearer realm="https://r.example/'), F.col("p_brand"), F.lit('",service="'), F.col("p_type"), F.lit('",scope="pull"'))
    link = F.concat(F.lit("<https://x/?p="), F.col("k").cast("string"), F.lit('>; rel="'), F.when(F.col("k") % 2 == 0, "next").otherwise("prev"), F.lit('"'))
    m = S.challenge(h)
    return p.select("k", m["realm"].alias("realm"), m["service"].alias("service"), m["scope"].alias("scope"), m["none"].alias("missing"), S.next_link(link).alias("next"))


def headers_checked(spark, d):
    """Whether the texts' first 64 bytes, cut at 16, hash to the announced hashes; of every third text one hash is wrong."""
    t = table(spark, d, "documents").filter("octet_length(text) >= 64").select("doc_id", F.encode("text", "UTF-8").alias("b"))
    t = t.select("doc_id", F.substring("b", 1, 64).alias("header"), F.explode(F.sequence(F.lit(0), F.lit(4))).alias("chunk_ix"))
    part = F.expr("substring(header, chunk_ix * 16 + 1, 16)")
    h = F.when((F.col("doc_id") % 3 == 0) & (F.col("chunk_ix") == 2), "x").when(F.col("chunk_ix") == 4, "beyond the header").otherwise(F.sha2(part, 256))
    lead = t.select(F.lit("r").alias("root"), F.col("doc_id").cast("string").alias("path"), "header", "chunk_ix", h.alias("hash"), F.lit(16).cast("bigint").alias("len"))
    return R.check_headers(lead).select("path", "ok")


def model_params(spark, d):
    """Parameters of models from those of their safetensors files, else of their GGUF files. A file is counted when all its chunks' types are known;
    a byte of a raw one stands for a parameter."""
    m = table(spark, d, "manifests").select(key("root").alias("root"), "files").filter("root is not null").groupBy("root").agg(F.min_by("files", F.to_json("files")).alias("files"))
    f = m.select("root", F.explode("files.path").alias("path"))
    width = F.when(F.col("dtype").isin("bf16", "f16"), 2).when(F.col("dtype") == "f32", 4).when(F.col("dtype") == "raw", 1)
    c = _chunks(spark, d).filter("path is not null").groupBy("root", "path").agg(
        F.when(F.bool_and(width.isNotNull()), F.sum(F.floor(F.col("len") / width))).cast("bigint").alias("params")
    )
    return R.model_params(f.join(c, ["root", "path"], "left"))


QUERIES = {
    f.__name__: f
    for f in (
        store_chunks, store_has, store_blocked, store_manifests, manifests_json, log_json, store_meta, signatures_checked, trusted_signers, safetensors_segments, safetensors_headers,
        gguf_segments, files_unpacked, pack_lines, pack_root, byte_planes, links_kept, linked_read, probes_admitted, chunk_peers, peers_all, subnets_admitted, sends_paced, more_predicates,
        auth_challenges, headers_checked, model_params,
    )
}

_T = "WITH t AS (SELECT doc_id, lang, sha256(text) AS hash, CAST(strlen(text) AS BIGINT) AS raw_len, text FROM documents WHERE text IS NOT NULL)"
_MF = f""", mo AS (
  SELECT root, min(format) AS format, arg_min(files, {{'f': format, 'j': to_json(files)}}) AS files FROM (
    SELECT coalesce(format, 'none') AS format, {_K.format("root")} AS root, files FROM manifests) WHERE root IS NOT NULL GROUP BY root
), mf AS (SELECT root, format, ix, files[ix] AS f FROM (SELECT *, unnest(generate_series(1, len(files))) AS ix FROM mo)),
fc AS (SELECT root, path, file_ix, chunk_ix, hash, len FROM ch WHERE path IS NOT NULL AND hash IS NOT NULL)"""
_PARTS = "[A-Za-z0-9_-][A-Za-z0-9._-]{0,95}"
_UNSAFE = "\\.(bin|pt|pth|ckpt|pkl|pickle|joblib|dill|pd|npy|npz|h5|hdf5|keras)$"

SQL = {
    "store_chunks": _T + "SELECT DISTINCT hash, raw_len, true AS ok, CAST(0 AS BIGINT) AS again, true AS some FROM t WHERE lang = 'en'",
    "store_has": _T + """SELECT hash, bool_or(coalesce(lang, '') <> 'de') AND NOT bool_or(coalesce(lang, '') = 'fr') AS there FROM t GROUP BY hash
UNION ALL SELECT DISTINCT upper(hash), false FROM t WHERE upper(hash) <> hash""",
    "store_blocked": _T + ", b AS (SELECT DISTINCT hash FROM t WHERE lang = 'es') SELECT DISTINCT hash, raw_len, (SELECT count(*) FROM b) AS gone FROM t WHERE hash NOT IN (SELECT hash FROM b)",
    "store_manifests": _CH + _MF + f""", s AS (SELECT root, path, sum(len) AS total, max(len) AS most FROM fc GROUP BY ALL)
SELECT mf.root, CASE WHEN mf.format NOT IN ({", ".join(f"'{x}'" for x in P.MANIFEST_FORMATS)}) THEN 'unknown format' WHEN NOT regexp_full_match(mf.root, '[0-9a-f]{{64}}') THEN 'invalid root'
  WHEN mf.root LIKE '0%' THEN 'blocked' WHEN bool_or(regexp_matches(lower(f.path), '{_UNSAFE}')) THEN 'unsafe file' WHEN bool_or(regexp_matches(f.path, '(^|/)(\\.\\.)?(/|$)')) THEN 'unsafe path'
  WHEN bool_or(coalesce(s.total, 0) <> f.size OR coalesce(s.most, 0) > {P.MAX_CHUNK}) THEN 'lengths don''t add up' ELSE '' END AS refused
FROM mf LEFT JOIN s ON s.root = mf.root AND s.path = f.path GROUP BY mf.root, mf.format""",
    "manifests_json": _CH + _MF + """, n AS (SELECT root, path, count(*) AS n FROM fc GROUP BY ALL)
SELECT mf.format, mf.root, CASE WHEN any_value(mf.format) IN (KNOWN) THEN CAST(count(*) AS INTEGER) ELSE -1 END AS files, CASE WHEN any_value(mf.format) IN (KNOWN) THEN CAST(coalesce(sum(n.n), 0) AS BIGINT) ELSE -1 END AS chunks FROM mf LEFT JOIN n ON n.root = mf.root AND n.path = f.path GROUP BY mf.format, mf.root""".replace("KNOWN", ", ".join(f"'{x}'" for x in P.MANIFEST_FORMATS)),
    "log_json": "SELECT statement.claim.kind AS kind, count(*) AS n, min(statement.time) AS first, max(seq) AS last, count(DISTINCT statement.signature.sig) AS sigs FROM log WHERE statement IS NOT NULL GROUP BY 1",
    "store_meta": """SELECT registry || '/' || strftime(day, '%Y-%m-%d') AS key, arg_max(CAST(downloads AS VARCHAR), {'a': floor(epoch(saved)), 'v': CAST(downloads AS VARCHAR)}) AS value
FROM recent WHERE name IS NOT NULL AND registry IS NOT NULL AND downloads IS NOT NULL AND saved IS NOT NULL AND day IS NOT NULL GROUP BY 1""",
    "signatures_checked": f"SELECT DISTINCT root, substr(root, 1, 1) IN ('1', '3', '5', '7', '9', 'b', 'd', 'f') AS ok, CASE WHEN substr(root, 1, 1) IN ('1', '3', '5', '7', '9', 'b', 'd', 'f') THEN 1 ELSE 0 END AS kept FROM (SELECT {_K.format('root')} AS root FROM manifests) WHERE root IS NOT NULL",
    "trusted_signers": f"SELECT DISTINCT root, substr(root, 1, 1) IN ('1', '3', '5', '7', '9', 'b', 'd', 'f') AND NOT coalesce(substr(root, 2, 1) IN ('1', '3', '5', '7', '9', 'b', 'd', 'f'), false) AS trusted FROM (SELECT {_K.format('root')} AS root FROM manifests) WHERE root IS NOT NULL",
    "safetensors_segments": """WITH t AS (SELECT doc_id, strlen(text) AS n FROM documents WHERE strlen(text) >= 2),
h AS (SELECT doc_id, n, strlen('{"__metadata__":{"x":"y"},"layer.0.w":{"dtype":"BF16","shape":[2,' || (n // 4) || '],"data_offsets":[0,' || (n - n % 2) || ']},"tail":{"dtype":"U8","shape":[' || (n % 2) || '],"data_offsets":[' || (n - n % 2) || ',' || n || ']}}') AS h FROM t),
s AS (SELECT doc_id, 0 AS lo, 8 + h AS hi, 'raw' AS dtype, h FROM h UNION ALL SELECT doc_id, 8 + h, 8 + h + n - n % 2, 'bf16', h FROM h
  UNION ALL SELECT doc_id, 8 + h + n - n % 2, 8 + h + n, 'raw', h FROM h WHERE n % 2 = 1 UNION ALL SELECT doc_id, 8 + h + n, 8 + h + n + 3, 'raw', h FROM h)
SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY lo) - 1 AS INTEGER) AS seg_ix, CAST(lo AS BIGINT) AS lo, CAST(hi AS BIGINT) AS hi, dtype, CAST(h AS BIGINT) AS prefix FROM s""",
    "safetensors_headers": "SELECT 'm/' || doc_id || '.safetensors' AS path, CAST(2 * (strlen(text) // 4) + strlen(text) % 2 AS BIGINT) AS params, 'U8' AS tail FROM documents WHERE strlen(text) >= 2",
    "gguf_segments": """WITH t AS (SELECT doc_id, CAST(length(text) AS BIGINT) AS n FROM documents WHERE text IS NOT NULL),
h AS (SELECT *, ((24 + 8 + 17 + 8 + 3 * (8 + 1 + 4 + 12) + 8 + 8 + 16 + 63) // 64) * 64 AS a, ((4 * n + 63) // 64) * 64 AS o FROM t),
s AS (SELECT doc_id, 0 AS lo, a AS hi, 'raw' AS dtype, n FROM h UNION ALL SELECT doc_id, a, a + 4 * n, 'f32', n FROM h WHERE n > 0 UNION ALL SELECT doc_id, a + 4 * n, a + o, 'raw', n FROM h WHERE o > 4 * n
  UNION ALL SELECT doc_id, a + o, a + o + 128, 'raw', n FROM h UNION ALL SELECT doc_id, a + o + 128, a + o + 128 + 4 * n, 'bf16', n FROM h WHERE n > 0 UNION ALL SELECT doc_id, a + o + 128 + 4 * n, a + o + 129 + 4 * n, 'raw', n FROM h)
SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY lo) - 1 AS INTEGER) AS seg_ix, CAST(lo AS BIGINT) AS lo, CAST(hi AS BIGINT) AS hi, dtype, 256 + 3 * n AS params FROM s""",
    "files_unpacked": "SELECT source || '/' || doc_id || '.txt' AS path, CAST(strlen(text) AS BIGINT) AS size, sha256(text) AS sha256, true AS ok FROM documents WHERE text IS NOT NULL",
    "pack_lines": "SELECT source || '/' || doc_id || '.txt' AS path, concat_ws('|', source || '/' || doc_id || '.txt', strlen(text), sha256(text), 1, sha256(text) || ':' || strlen(text)) AS line FROM documents WHERE strlen(text) BETWEEN 1 AND 1000",
    "pack_root": """WITH l AS (SELECT source || '/' || doc_id || '.txt' AS path, strlen(text) AS size, concat_ws('|', source || '/' || doc_id || '.txt', strlen(text), sha256(text), 1, sha256(text) || ':' || strlen(text)) AS line FROM documents WHERE strlen(text) BETWEEN 1 AND 1000),
b AS (SELECT substr(sha256(path), 1, 3) AS bucket, sha256(string_agg(line, chr(10) ORDER BY encode(line))) AS h, count(*) AS files, sum(size) AS size FROM l GROUP BY 1)
SELECT sha256('manifest/v2|' || coalesce(string_agg(bucket || h, '' ORDER BY bucket), '')) AS root, CAST(coalesce(sum(files), 0) AS BIGINT) AS files, CAST(coalesce(sum(size), 0) AS BIGINT) AS size FROM b""",
    "byte_planes": """WITH b AS (SELECT CAST(CAST(x AS FLOAT)::BIT AS VARCHAR) AS b FROM (SELECT unnest(embedding) AS x FROM embeddings)),
v AS (SELECT [CAST('0b' || substr(b, 25 - 8 * i, 8) AS INTEGER) FOR i IN [0, 1, 2, 3]] AS p, [CAST('0b' || substr(b, 2, 8) AS INTEGER), CAST('0b' || substr(b, 25, 8) AS INTEGER), CAST('0b' || substr(b, 17, 8) AS INTEGER), CAST('0b' || substr(b, 1, 1) || substr(b, 10, 7) AS INTEGER)] AS e FROM b),
i AS (SELECT unnest([0, 1, 2, 3]) AS plane)
SELECT 'plain' AS kind, plane, CAST(sum(p[plane + 1]) AS BIGINT) AS total, true AS ok FROM v, i GROUP BY plane UNION ALL SELECT 'exponent', plane, CAST(sum(e[plane + 1]) AS BIGINT), true FROM v, i GROUP BY plane""",
    "links_kept": _CH + _MF + f""", x AS (SELECT mf.root, mf.ix, fc.hash, fc.len, row_number() OVER (PARTITION BY mf.root, mf.ix ORDER BY fc.file_ix, fc.chunk_ix) AS i, fc.chunk_ix, f.path AS path, f.size AS size FROM mf JOIN fc ON fc.root = mf.root AND fc.path = f.path),
y AS (SELECT *, CAST(sum(len) OVER (PARTITION BY root, ix ORDER BY i) - len AS BIGINT) AS start FROM x),
z AS (SELECT * FROM y QUALIFY row_number() OVER (PARTITION BY hash ORDER BY root, ix, i) = 1),
s AS (SELECT root, path, sum(len) AS total, max(len) AS most FROM fc GROUP BY ALL),
g AS (SELECT mf.root FROM mf LEFT JOIN s ON s.root = mf.root AND s.path = f.path GROUP BY mf.root, mf.format HAVING mf.format IN ({", ".join(f"'{x}'" for x in P.MANIFEST_FORMATS)}) AND regexp_full_match(mf.root, '[0-9a-f]{{64}}')
  AND NOT bool_or(regexp_matches(lower(f.path), '{_UNSAFE}')) AND NOT bool_or(regexp_matches(f.path, '(^|/)(\\.\\.)?(/|$)')) AND NOT bool_or(coalesce(s.total, 0) <> f.size OR coalesce(s.most, 0) > {P.MAX_CHUNK}))
SELECT hash, root, start, len, substr(root, 1, 1) NOT IN ('0', '1', '2', '3', '4') AND root IN (SELECT root FROM g) AS kept FROM z""",
    "linked_read": "SELECT sha256(text) AS hash, doc_id % 5 <> 0 AS ok, count(*) AS n FROM documents WHERE text IS NOT NULL AND source IS NOT NULL GROUP BY ALL",
    "probes_admitted": Q._BASE.replace("pn AS (", f"""an AS (SELECT anchor FROM pr GROUP BY anchor HAVING count(*) >= 100),
nd AS (SELECT node, arg_max(coalesce(root, 'none'), {{'t': t, 'r': coalesce(root, 'none')}}) AS claimed FROM pr GROUP BY node),
pn AS (""").replace("ORDER BY t, probe_id) AS i FROM pr)", "ORDER BY t, probe_id) AS i FROM pr JOIN an USING (anchor) JOIN nd USING (node) WHERE outcome IS DISTINCT FROM 'held' OR coalesce(root = claimed, false))") + Q._walk(3600) + "SELECT probe_id, anchor, node, t FROM ap",
    "chunk_peers": Q._DAYS + f""", cb AS (SELECT DISTINCT {_K.format("root")} AS root, {_K.format("hash")} AS hash, {_K.format("block_id")} AS block_id FROM chunks WHERE {_K.format("root")} IS NOT NULL),
of AS (SELECT DISTINCT block_id, peer FROM cb JOIN hd ON hd.root = cb.root WHERE block_id IS NOT NULL),
pp AS (SELECT DISTINCT hash, peer FROM cb JOIN of USING (block_id) WHERE hash IS NOT NULL),
ls AS (SELECT hash, list_sort(list(peer)) AS l, count(*) AS n, TRY_CAST('0x' || hash[1:4] AS BIGINT) AS pos FROM pp GROUP BY hash)
SELECT hash, array_to_string([l[((i + coalesce(pos, 0)) % n) + 1] FOR i IN generate_series(0, n - 1)], ',') AS peers FROM ls""",
    "peers_all": "SELECT server AS peer FROM receipts UNION SELECT fetcher FROM receipts UNION SELECT node FROM probes",
    "subnets_admitted": Q._BASE + """, o AS (SELECT server AS subnet, substr(fetcher, 1, 1) AS peer, receipt_id AS seq, receipt_id % 3 = 0 AS leaves, row_number() OVER (PARTITION BY server ORDER BY receipt_id) AS i FROM r),
w AS (
  SELECT subnet, CAST(0 AS BIGINT) AS i, CAST(-1 AS BIGINT) AS seq, true AS admitted, CAST([] AS VARCHAR[]) AS inside FROM (SELECT DISTINCT subnet FROM o)
  UNION ALL SELECT o.subnet, o.i, o.seq, leaves OR list_contains(inside, peer) OR len(inside) < 3,
    CASE WHEN leaves THEN list_filter(inside, lambda z: z <> peer) WHEN list_contains(inside, peer) OR len(inside) >= 3 THEN inside ELSE list_append(inside, peer) END
  FROM w JOIN o ON o.subnet = w.subnet AND o.i = w.i + 1
) SELECT seq, admitted FROM w WHERE i > 0""",
    "sends_paced": Q._BASE + """, o AS (SELECT server AS source, row_number() OVER (PARTITION BY server ORDER BY time, receipt_id) AS seq, CAST(time AS DOUBLE) AS t, bytes FROM r),
w AS (
  SELECT source, CAST(0 AS BIGINT) AS seq, CAST(1e6 AS DOUBLE) AS tokens, (SELECT min(t) FROM o o2 WHERE o2.source = s.source) AS last FROM (SELECT DISTINCT source FROM o) s
  UNION ALL SELECT source, seq, greatest(x, 0.0), CASE WHEN x >= 0 THEN now ELSE now - x / 1e6 END FROM (
    SELECT o.source, o.seq, greatest(o.t, w.last) AS now, least(1e6, w.tokens + (greatest(o.t, w.last) - w.last) * 1e6) - o.bytes AS x FROM w JOIN o ON o.source = w.source AND o.seq = w.seq + 1)
) SELECT source, seq, round(last, 3) AS "at" FROM w WHERE seq > 0""",
    "more_predicates": f"""WITH c AS (SELECT c_custkey AS k, c_name AS n, c_mktsegment AS seg, CASE WHEN c_custkey % 2 = 0 THEN ' ' ELSE '' END || repeat(c_name, c_custkey % 4) AS odd FROM customer)
SELECT k, length(odd) BETWEEN 1 AND 40 AND trim(odd) = odd AS display, regexp_full_match(seg || '/' || replace(n, '#', '_'), '{_PARTS}/{_PARTS}') AS repo, regexp_full_match(n, '{_PARTS}/{_PARTS}') AS no_repo, k % 3 <> 0 AS "commit",
  abs(k * 7 - 5000) <= {P.SKEW} AS skew, seg IN ('AUTOMOBILE', 'BUILDING') AND k % 5 <> 0 AND 100 < k AND k % 7 <> 0 AS ticket, k % 2 = 0 AND k % 3 = 0 AS answers FROM c""",
    "auth_challenges": """SELECT p_partkey AS k, 'https://r.example/' || p_brand AS realm, p_type AS service, 'pull' AS scope, CAST(NULL AS VARCHAR) AS missing, CASE WHEN p_partkey % 2 = 0 THEN 'https://x/?p=' || p_partkey END AS next FROM part""",
    "headers_checked": "SELECT CAST(doc_id AS VARCHAR) AS path, doc_id % 3 <> 0 AS ok FROM documents WHERE strlen(text) >= 64",
    "model_params": _CH + f""", mo AS (SELECT root, arg_min(files, CAST(to_json(files) AS VARCHAR)) AS files FROM (SELECT {_K.format("root")} AS root, files FROM manifests) WHERE root IS NOT NULL GROUP BY root),
mf AS (SELECT root, unnest(files).path AS path FROM mo),
c AS (SELECT root, path, CASE WHEN bool_and(coalesce(dtype IN ('bf16', 'f16', 'f32', 'raw'), false)) THEN sum(len // CASE dtype WHEN 'f32' THEN 4 WHEN 'raw' THEN 1 ELSE 2 END) END AS params FROM ch WHERE path IS NOT NULL GROUP BY ALL),
fp AS (SELECT mf.root, mf.path, c.params FROM mf LEFT JOIN c ON c.root = mf.root AND c.path = mf.path),
sp AS (SELECT root, CASE WHEN bool_and(params IS NOT NULL) THEN sum(params) END AS p FROM fp WHERE path LIKE '%.safetensors' GROUP BY root),
gs AS (
  SELECT root, stem, count(*) AS n, sum(params) AS p, bool_and(params IS NOT NULL) AS counted, arg_min(total, path) AS total FROM (
    SELECT *, coalesce(nullif(regexp_extract(path, '^(.*)-[0-9]{{5}}-of-([0-9]{{5}})\\.gguf$', 1), ''), path) AS stem, coalesce(TRY_CAST(regexp_extract(path, '^(.*)-[0-9]{{5}}-of-([0-9]{{5}})\\.gguf$', 2) AS INTEGER), 1) AS total
    FROM fp WHERE path LIKE '%.gguf') GROUP BY root, stem
), gp AS (SELECT root, CASE WHEN bool_and(n = total AND counted) AND count(DISTINCT p) = 1 THEN max(p) END AS p FROM gs GROUP BY root)
SELECT coalesce(sp.root, gp.root) AS root, CAST(coalesce(sp.p, gp.p) AS BIGINT) AS params FROM sp FULL JOIN gp ON sp.root = gp.root""",
}
