"""Operators against numbers worked out by hand."""

import pandas as pd
import pytest
from pyspark.sql import functions as F

from chunklake.functions import predicates as P
from chunklake.functions import scalars as S
from chunklake.operators import accounting as A
from chunklake.operators import planning as L
from chunklake.operators import registry as R
from chunklake.plans import dedup, pipeline


def one(spark, expr):
    return spark.range(1).select(expr.alias("x")).first()["x"]


def test_predicates(spark):
    lit = F.lit
    assert one(spark, P.is_unsafe(lit("a/b.PKL"))) and not one(spark, P.is_unsafe(lit("a.pt/b"))) and not one(spark, P.is_unsafe(lit("b")))
    assert not one(spark, P.is_hash(lit("A" * 64))) and one(spark, P.is_hash(lit("a" * 64))) and not one(spark, P.is_hash(lit(None)))
    for good in ("org/model", "o/m.x-1_2"):
        assert one(spark, P.is_name(lit(good)))
    for bad in ("model", "/m", "o/", ".o/m", "o/m/n", "o/.m", "o m/x", None):
        assert not one(spark, P.is_name(lit(bad).cast("string"))), bad
    assert tuple(one(spark, P.parse_ref(lit("o/m")))) == ("o/m", "main") and tuple(one(spark, P.parse_ref(lit("o/m@v1")))) == ("o/m", "v1")
    assert one(spark, P.parse_ref(lit("o/m@"))) is None
    assert tuple(one(spark, P.byte_range(lit("bytes=2-"), lit(9)))) == (2, 9) and tuple(one(spark, P.byte_range(lit("bytes=-4"), lit(9)))) == (5, 9)
    assert one(spark, P.byte_range(lit("bytes=9-"), lit(9))) is None
    assert one(spark, P.is_unsafe_path(lit("a/../b"))) and one(spark, P.is_unsafe_path(lit("/a"))) and not one(spark, P.is_unsafe_path(lit("a/b")))
    assert one(spark, P.is_display_name(lit("Ann B"))) and not one(spark, P.is_display_name(lit(" Ann"))) and not one(spark, P.is_display_name(lit("a\tb")))
    assert one(spark, P.may_operate(lit("d"), lit("o"), lit("d"), lit(10), lit(9))) and not one(spark, P.may_operate(lit("d"), lit("o"), lit("d"), lit(10), lit(10)))


def test_scalars(spark):
    lit = F.lit
    assert one(spark, S.day_to_date(lit(20361))) == "2025-09-30" and one(spark, S.date_to_day(lit("2025-09-30"))) == 20361
    for bad in ("2025-9-30", "2025-02-30", "x"):
        assert one(spark, S.date_to_day(lit(bad))) is None
    assert one(spark, S.words(lit("Llama-3.1 Tiny"))) == ["llama", "3", "1", "tiny"]
    assert one(spark, S.human_bytes(lit(1536).cast("bigint"))) == "1.5 KiB"
    assert one(spark, S.eta(lit(125), lit(1))) == "2:05" and one(spark, S.percent(lit(1), lit(0))) == 0.0
    assert one(spark, S.network(lit("::ffff:1.2.3.4"))) == "1.2.3.0/24" and one(spark, S.network(lit("2001:db8::1"))) == "2001:db8:0::/48"
    assert one(spark, S.network(lit("x"))) is None
    assert one(spark, S.le_integer(F.unhex(lit("0201000000000000")))) == 258
    assert tuple(one(spark, S.model_name(lit("llama3")))) == ("registry.ollama.ai", "library", "llama3", "latest")
    assert one(spark, S.model_name(lit("a b"))) is None
    assert one(spark, S.url_encode(lit("a b~*"))) == "a%20b~%2A" and one(spark, S.url_decode(lit("a+b%20"))) == "a+b "
    assert one(spark, S.next_link(lit('<http://x/2>; rel="next"'))) == "http://x/2"
    assert one(spark, S.challenge(lit('Bearer realm="r",service="s"'))) == {"realm": "r", "service": "s"}
    names = ["lm_head.weight", "model.layers.10.mlp", "model.embed_tokens", "model.layers.2.mlp"]
    got = spark.createDataFrame([(n,) for n in names], "n string").orderBy(S.layer_key(F.col("n"))).collect()
    assert [r["n"] for r in got] == ["model.embed_tokens", "model.layers.2.mlp", "model.layers.10.mlp", "lm_head.weight"]


def test_cap_scaling(spark):
    t = spark.createDataFrame([("f", "a", "r", 600, 0, "n", 0, 1000, 1), ("f", "b", "r", 900, 0, "n", 0, 1000, 1)], "fetcher string, server string, root string, bytes long, time long, network string, lookup_t long, cap long, day_no int")
    assert {r["server"]: r["credited"] for r in A.credit(t).collect()} == {"a": 400, "b": 600}


def test_probe_gap_counts_from_the_accepted_one(spark):
    p = spark.createDataFrame([(i, "a", "n", None, "up", t) for i, t in enumerate([0, 50, 70, 119, 130, 300])], "probe_id long, anchor string, node string, root string, outcome string, t long")
    assert sorted(r["t"] for r in A.accepted_probes(p).collect()) == [0, 70, 130, 300]


def test_uptime_and_leaderboard(spark):
    nodes = spark.createDataFrame([("p", "x", 0, 86400 * 9, ["r"], True), ("q", "y", 0, 86400 * 9, ["r"], False)], "peer string, name string, registered long, last_seen long, models array<string>, hidden boolean")
    days = spark.createDataFrame([(9, "p", 5, 1, 2, 1)], "day_no int, peer string, bytes long, downloads long, probes long, answered long")
    held = spark.createDataFrame([("q", "r", 1)], "peer string, root string, t long")
    rows = {r["peer"]: r for r in A.leaderboard(nodes, days, held, "uptime", 500, 86400 * 9 + 5).collect()}
    assert rows["p"]["uptime"] == 0.5 and rows["p"]["name"] is None and rows["p"]["rank"] == 1 and rows["q"]["uptime"] is None and rows["q"]["models"] == 1


def test_summary(spark):
    m = spark.createDataFrame([("f", "r", [("config.json", 100, "h"), ("model.safetensors", 3000, "h")])], "format string, root string, files array<struct<path:string,size:bigint,hash:string>>")
    c = spark.createDataFrame([(0, "r", "config", 100), (1, "r", "a", 1000), (2, "r", "b", 1000), (3, "r", "a", 1000)], "chunk_id long, root string, hash string, len long")
    s = R.summaries(m, c).first()
    assert (s["size"], s["weights"], s["formats"], s["chunks"], s["unique_chunks"], s["unique_bytes"]) == (3100, 3000, ["safetensors"], 4, 3, 2100)


def test_gguf_sets(spark):
    f = lambda rows: R.gguf_params(spark.createDataFrame([("r", *x) for x in rows], "root string, path string, params long")).first()["params"]
    assert f([("m-00001-of-00002.gguf", 60), ("m-00002-of-00002.gguf", 40), ("q.gguf", 100)]) == 100
    assert f([("m-00001-of-00002.gguf", 60), ("q.gguf", 100)]) is None
    assert f([("m.gguf", 60), ("q.gguf", None)]) is None
    assert f([("m.gguf", 60), ("q.gguf", 61)]) is None


def test_log_rules(spark):
    k = lambda x: x * 64
    one, two, op, deal = k("1"), k("2"), k("e"), k("d")
    rows = [
        (0, "publish", one, dict(name="o/m", rev="v", root=k("a")), ""), (1, "publish", two, dict(name="o/n", rev="v", root=k("b")), "not an owner"), (2, "grant", one, dict(org="o", key=two), ""),
        (3, "publish", two, dict(name="o/n", rev="v", root=k("b")), ""), (4, "block", one, dict(hash=k("c")), "not the operator"), (5, "block", op, dict(hash=k("c")), ""),
        (6, "publish", one, dict(name="o/x", rev="v", root=k("c")), "blocked"), (7, "revoke", one, dict(org="o", key=one), ""), (8, "revoke", two, dict(org="o", key=two), "last owner"),
        (9, "delegate", op, dict(key=deal, expires=50), ""), (10, "unblock", deal, dict(hash=k("c")), ""), (11, "publish", two, dict(name="o/x", rev="v", root=k("c")), ""),
        (12, "publish", two, dict(name="o x/y", rev="v", root=k("c")), "invalid name"), (13, "publish", two, dict(name="o/x", rev="v", root="c"), "invalid root"),
        (14, "publish", two, dict(name="o/x", rev="v", root=k("c"), gated="x"), "invalid gate"), (15, "publish", two, dict(name="o/x", rev="v", root=k("c"), description="é" * 1001), "description too long"),
        (16, "grant", two, dict(org="o", key="short"), "invalid key"), (17, "grant", two, dict(org="none", key=one), "no such org"), (18, "grant", two, dict(org="o", key=two), "owns it already"),
        (19, "gate", deal, dict(root=k("a"), repo="a/b"), ""), (20, "gate", deal, dict(root=k("a"), repo="a b"), "invalid gate"), (21, "anchors", deal, dict(addrs=["/ip4/1.1.1.1/udp/1/p2p/x"]), ""),
        (22, "anchors", deal, dict(addrs=["/ip4/1.1.1.1/udp/1"]), "invalid anchor"), (60, "block", deal, dict(hash=k("c")), "not the operator"), (61, "delegate", op, dict(key=op, expires=99), "delegates to itself"),
        (62, "delegate", op, dict(key=deal, expires=5), "expired"), (63, "delegate", deal, dict(key=deal, expires=99), "not the operator"), (64, "bless", op, {}, "unknown kind"), (65, "block", op, dict(hash="c"), "invalid hash"),
    ]
    # a refused statement may come again and be accepted, an accepted one may not: sig of 66 is that of 1, of 67 that of 3, of 68 that of 4
    rows += [(66, "publish", two, dict(name="o/n", rev="v", root=k("b")), ""), (67, "publish", two, dict(name="o/n", rev="v", root=k("b")), "repeated"), (68, "unblock", op, dict(hash=k("c")), "")]
    sig = {66: "s1", 67: "s3", 68: "s4"}
    shape = "registry string, seq long, kind string, signer string, sig string, time long, name string, rev string, root string, description string, gated string, org string, key string, hash string, repo string, addrs array<string>, expires long"
    cols = [x.split()[0] for x in shape.split(", ")]
    made = [{**dict.fromkeys(cols), "registry": "r", "seq": s, "kind": kind, "signer": g, "sig": sig.get(s, f"s{s}"), "time": s, **c} for s, kind, g, c, _ in rows]
    c = spark.createDataFrame([tuple(m[x] for x in cols) for m in made], shape)
    got = {r["seq"]: r["refused"] for r in R.validate(c, spark.createDataFrame([("r", op)], "registry string, key string")).collect()}
    assert got == {s: why for s, *_, why in rows}
    # without an operator only orgs' statements can be accepted; no statements, no rows
    alone = {r["seq"]: r["refused"] for r in R.validate(c, spark.createDataFrame([], "registry string, key string")).collect()}
    assert alone[0] == "" and alone[5] == alone[9] == "not the operator"
    assert R.validate(c.limit(0), spark.createDataFrame([("r", op)], "registry string, key string")).count() == 0


def test_planning(spark):
    r = spark.createDataFrame([("f", 0, 10), ("f", 15, 20), ("f", 100, 110)], "f string, start long, stop long")
    assert sorted((x["lo"], x["hi"], x["parts"]) for x in L.coalesce_ranges(r, ["f"], 5).collect()) == [(0, 20, 2), (100, 110, 1)]
    b = spark.createDataFrame([("x", "a"), ("x", "b"), ("y", "a")], "n string, d string")
    assert [tuple(v) for v in L.vote(b, ["n"], "d", 1).orderBy("n").collect()] == [("x", "b", 1), ("y", "a", 1)]
    c = spark.createDataFrame([("r", 0, i, f"h{i}", n) for i, n in enumerate([6, 6, 3, 9, 20, 1])], "root string, file_ix int, chunk_ix int, hash string, len long")
    assert [x["block_ix"] for x in L.cut_blocks(c, 10).orderBy("chunk_ix").collect()] == [0, 0, 1, 1, 2, 3]
    j = spark.createDataFrame([("s", "a", 0, "join"), ("s", "b", 1, "join"), ("s", "c", 2, "join"), ("s", "a", 3, "leave"), ("s", "c", 4, "join"), ("s", "c", 5, "join")], "subnet string, peer string, seq long, kind string")
    assert [x["admitted"] for x in L.subnet_cap(j, 2).orderBy("seq").collect()] == [True, True, False, True, True, True]
    s = spark.createDataFrame([("s", 0, 0.0, 100), ("s", 1, 0.0, 100), ("s", 2, 5.0, 50)], "source string, seq long, t double, bytes long")
    assert [x["at"] for x in L.token_bucket(s, 100.0).orderBy("seq").collect()] == pytest.approx([0.0, 1.0, 5.0])


def test_overlaps_in_buckets(spark):
    import random

    rnd = random.Random(6)
    at, chunks = 0, []
    for i in range(40):
        n = rnd.choice([0, 1, 3, 9])
        chunks.append(("f", i, at, at + n))
        at += n
    ranges = [("f", f"r{i}", lo := rnd.randrange(at), lo + rnd.randrange(30)) for i in range(30)]
    c = spark.createDataFrame(chunks, "f string, chunk_ix int, start long, stop long")
    r = spark.createDataFrame(ranges, "f string, range_id string, lo long, hi long")
    want = sorted((x[1], y[1]) for x in chunks for y in ranges if x[3] > y[2] and x[2] < y[3] and x[3] > x[2])
    for bucket in (4, 7, 1000):
        assert sorted((x["chunk_ix"], x["range_id"]) for x in L.overlaps(c, r, ["f"], bucket).collect()) == want


def test_dedup_of_a_hot_hash(spark):
    p = spark.createDataFrame([("a", i, "h", 10, 5) for i in range(4)] + [("b", 0, "h", 10, 5), ("b", 1, "k", 7, 7)], "input string, ix int, hash string, raw long, stored long")
    got = {r["input"]: (r["chunks"], r["new_chunks"], r["new_raw_bytes"]) for r in dedup.report(p, ["input"], ["input", "ix"]).collect()}
    assert got == {"a": (4, 1, 10), "b": (2, 1, 7)}


def test_pack_and_unpack(spark, tmp_path):
    import os

    src = tmp_path / "in"
    (src / "sub").mkdir(parents=True)
    files = {"a.txt": b"", "sub/b.dat": os.urandom(300_000), "sub/c.dat": os.urandom(10) * 9000, "x.pkl": b"no"}
    for k, v in files.items():
        (src / k).write_bytes(v)
    kept, refused = pipeline.safe(pipeline.scan(spark, f"{src}"))
    assert [r["path"] for r in refused.collect()] == ["x.pkl"]
    pieces = pipeline.cut(kept).cache()
    m = pipeline.manifest_files(pieces, kept)
    root = pipeline.manifest_root(m).first()
    assert (root["files"], root["size"]) == (3, 390_000) and pipeline.manifest_root(m.orderBy(F.desc("path"))).first() == root
    assert pipeline.manifest_root(m.withColumn("line", F.concat("line", F.lit("x")))).first()["root"] != root["root"]
    assert sorted(f["path"] for f in m.collect()) == ["a.txt", "sub/b.dat", "sub/c.dat"]
    raws = pipeline.decode(pipeline.encode(pieces))
    listed = spark.createDataFrame([(f["path"], f["hash"]) for f in m.collect()] + [("../evil", "x")], "path string, hash string")
    out = tmp_path / "out"
    out.mkdir()
    ok = {r["path"]: r["ok"] for r in pipeline.unpack(pieces, raws, listed, str(out)).collect()}
    assert ok == {"a.txt": True, "sub/b.dat": True, "sub/c.dat": True, "../evil": False}
    for k, v in files.items():
        if k != "x.pkl":
            assert (out / k).read_bytes() == v
    assert pipeline.encode(pieces, pieces.select("hash")).count() == 0


def test_large_files_by_segment(spark, tmp_path):
    import os

    from test_bytes import gguf, safetensors

    made = {
        "a.safetensors": safetensors([("a", "BF16", [200_000], os.urandom(400_000)), ("b", "F32", [50_000], os.urandom(200_000))], pad=2),
        "b.gguf": gguf([(b"emb", [64, 10], 8, 640 // 32 * 34), (b"norm", [64], 0, 256)]), "c.dat": os.urandom(300_000), "d.dat": b"", "e.gguf": b"GGUFx",
    }
    for k, v in made.items():
        (tmp_path / k).write_bytes(v)
    paths = spark.createDataFrame([(str(tmp_path / k),) for k in made], "path string")
    large = pipeline.cut_large(pipeline.large_segments(paths), 4)
    small = pipeline.cut(spark.createDataFrame([(str(tmp_path / k), v) for k, v in made.items()], "path string, content binary"))
    key = ["path", "start", "len", "dtype", "hash"]
    assert sorted(map(tuple, large.select(key).collect())) == sorted(map(tuple, small.select(key).collect()))


def test_check_headers(spark):
    import hashlib

    h = b"0123456789"
    rows = [("r", "p", h, 0, hashlib.sha256(h[:4]).hexdigest(), 4), ("r", "p", h, 1, hashlib.sha256(h[4:8]).hexdigest(), 4), ("r", "p", h, 2, "x", 4), ("r", "q", h, 0, "x", 4)]
    df = spark.createDataFrame(rows, "root string, path string, header binary, chunk_ix int, hash string, len long")
    assert {r["path"]: r["ok"] for r in R.check_headers(df).collect()} == {"p": True, "q": False}


def test_verified_signatures(spark):
    from chunklake.functions.hashing import ed25519_sign
    from chunklake.operators.signatures import verified

    public, sig = (x.hex() for x in ed25519_sign(b"\1" * 32, b"text"))
    rows = [(public, "text", sig, 1), (public.upper(), "text", sig, 2), (public, "texT", sig, 3), (public, None, sig, 4), (None, "text", sig, 5), (public, "text", None, 6), (public, "text", "xyz", 7), (public[:-2], "text", sig, 8), (public, "text", sig, 1)]
    df = spark.createDataFrame(rows, "key string, t string, sig string, ok int")
    got = [r["ok"] for r in verified(df, "key", F.encode("t", "UTF-8"), "sig").collect()]
    assert sorted(got) == [False] * 6 + [True] * 3
    assert verified(df.limit(0), "key", F.encode("t", "UTF-8"), "sig").count() == 0


def test_formats_refuse_what_the_rules_forbid():
    import json
    import struct

    from chunklake.sources import formats

    def tensors(info):
        h = json.dumps(info).encode()
        return struct.pack("<Q", len(h)) + h + bytes(16)

    with pytest.raises(formats.FormatError):
        formats.safetensors_segments(tensors({"a": {"dtype": "F32"}}))

    text = lambda s: struct.pack("<Q", len(s)) + s

    def gguf(kind, align, tensors):
        head = b"GGUF" + struct.pack("<IQQ", 3, len(tensors), 1) + text(b"general.alignment") + struct.pack("<I", kind) + (struct.pack("<I", align) if kind == 4 else struct.pack("<Q", align))
        for name, dims, t, at in tensors:
            head += text(name) + struct.pack(f"<I{len(dims)}Q", len(dims), *dims) + struct.pack("<IQ", t, at)
        return head.ljust(-(-len(head) // 64) * 64, b"\0") + bytes(512)

    whole = lambda d: formats.gguf_segments(d) == [(0, len(d), "raw")]
    assert whole(gguf(10, 64, [(b"a", (4,), 0, 0)])) and whole(gguf(4, 48, [(b"a", (4,), 0, 0)]))  # kind and size of the alignment
    assert whole(gguf(4, 64, [(b"a", (4,), 0, 32)]))  # an offset that isn't aligned
    assert whole(gguf(4, 64, [(b"a", (100,), 0, 0), (b"b", (4,), 0, 64)]))  # tensors that overlap
    d = gguf(4, 64, [(b"u", (256,), 19, 64), (b"a", (4,), 0, 0), (b"z", (256,), 19, 128)])  # tensors of unknown size end at the next one or at the end
    first = len(d) - 512
    assert formats.gguf_segments(d) == [(0, first, "raw"), (first, first + 16, "f32"), (first + 16, first + 64, "raw"), (first + 64, first + 128, "raw"), (first + 128, len(d), "raw")]
