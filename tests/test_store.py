"""The store's tables, JSON sources and linked files, and the streams."""

import hashlib
import json
import os
import time

import pytest
from pyspark.sql import functions as F

from chunklake.sources import store as st
from chunklake.streaming import board as B


def sha(b):
    return hashlib.sha256(b).hexdigest()


def test_chunks(spark, tmp_path):
    s = st.Store(spark, f"{tmp_path}/s")
    blobs = spark.createDataFrame([(sha(b"a"), 1, b"xa"), (sha(b"b"), 1, b"xb"), (sha(b"a"), 1, b"longer"), ("bad", 1, b"")], "hash string, raw_len long, blob binary")
    assert s.put(blobs) == 2 and s.put(blobs) == 0
    want = spark.createDataFrame([(sha(b"a"),), (sha(b"c"),), ("bad",)], "hash string")
    assert [bytes(r["blob"]) for r in s.get(want).collect()] == [b"xa"]
    none = want.limit(0)
    assert {r["hash"]: r["there"] for r in s.contains(want, none).collect()} == {sha(b"a"): True, sha(b"c"): False, "bad": False}
    assert s.contains(want, want).filter("there").count() == 0
    assert s.block(want) == (1, 0) and s.chunks().count() == 1


def test_version_gate(spark, tmp_path):
    st.Store(spark, f"{tmp_path}/v")
    st.Store(spark, f"{tmp_path}/v")
    (tmp_path / "v" / "VERSION").write_text("99")
    with pytest.raises(st.NewerVersion):
        st.Store(spark, f"{tmp_path}/v")


def manifest(root, path="a.safetensors", size=3, lens=(1, 2), fmt="manifest/v2"):
    return {"format": fmt, "root": root, "files": [{"path": path, "size": size, "hash": "h", "chunks": [{"hash": sha(str(n).encode()), "len": n, "dtype": "raw"} for n in lens]}]}


def test_manifests(spark, tmp_path):
    rows = [manifest("a" * 64), manifest("b" * 64, "x.pkl"), manifest("c" * 64, "../x"), manifest("d" * 64, size=9), manifest("e"), manifest("f" * 64, fmt="manifest/v9"), manifest("1" * 64)]
    (tmp_path / "in").mkdir()
    for i, m in enumerate(rows):
        (tmp_path / "in" / f"{i}.json").write_text(json.dumps(m, indent=1))
    (tmp_path / "in" / "z.json").write_text("{broken")
    good, bad = st.read_manifests(spark, f"{tmp_path}/in")
    assert good.count() == 6 and bad.count() == 2
    s = st.Store(spark, f"{tmp_path}/s")
    blocked = spark.createDataFrame([("1" * 64,)], "hash string")
    why = {r["root"][0]: r["refused"] for r in s.put_manifests(good, blocked).collect()}
    assert why == {"b": "unsafe file", "c": "unsafe path", "d": "lengths don't add up", "e": "invalid root", "1": "blocked"}
    s.put_manifests(good, blocked)
    assert [r["root"] for r in s.roots(blocked).collect()] == ["a" * 64]
    st.write_manifests(s.manifests(), f"{tmp_path}/out")
    again, none = st.read_manifests(spark, f"{tmp_path}/out")
    assert again.first() == s.manifests().first() and none.count() == 0


def test_signatures_and_meta(spark, tmp_path):
    s = st.Store(spark, f"{tmp_path}/s")
    rows = spark.createDataFrame([("r", "k", "s2", 2, True), ("r", "k", "s1", 1, True), ("r", "j", "x", 1, False)], "root string, key string, sig string, at long, ok boolean")
    s.add_signatures(rows)
    s.add_signatures(rows)
    assert [r["sig"] for r in s.signatures().collect()] == ["s1"]
    s.put_meta(spark.createDataFrame([("b/c", "1", 1), ("a", "2", 1), ("a", "3", 2), ("../x", "4", 1)], "key string, value string, at long"))
    assert [tuple(r) for r in s.meta().collect()] == [("a", "3"), ("b/c", "1")]


def test_links(spark, tmp_path):
    f = tmp_path / "w.bin"
    f.write_bytes(b"122")
    stat = os.stat(f)
    m = spark.createDataFrame([("manifest/v2", "r", [("p", 3, "h", [(sha(b"1"), 1, "raw"), (sha(b"22"), 2, "raw"), (sha(b"1"), 1, "raw")])])], st.MANIFEST)
    files = spark.createDataFrame([("r", "p", str(f), 3, stat.st_mtime_ns)], "root string, path string, target string, size long, mtime long")
    links = st.link_index(m, files)
    assert sorted((r["start"], r["len"]) for r in links.collect()) == [(0, 1), (1, 2)]
    assert all(r["ok"] for r in st.read_linked(links).collect())
    assert not any(r["ok"] for r in st.read_linked(links.withColumn("mtime", F.lit(1).cast("long"))).collect())
    assert not any(r["ok"] for r in st.read_linked(links.withColumn("target", F.lit("/nowhere"))).collect())


def test_log_source(spark, tmp_path):
    p = tmp_path / "log.jsonl"
    p.write_text('{"seq":0,"prev":"x","statement":{"claim":{"kind":"gate","root":"r","repo":""},"time":1,"signature":{"key":"k","sig":"s"}}}\n\n{"seq":1}\n')
    log = st.read_log(spark, str(p))
    assert log.count() == 2
    st.append_log(log, f"{tmp_path}/copy")
    st.append_log(log.filter("seq = 1"), f"{tmp_path}/copy")
    assert st.read_log(spark, f"{tmp_path}/copy").count() == 3


def test_headers(spark):
    from test_bytes import safetensors

    data = safetensors([("a", "BF16", [2, 3], b"x" * 12)])
    rows = [("r", "p", i, data[i * 40 : (i + 1) * 40]) for i in range(-(-len(data) // 40))] + [("r", "q", 0, b"no header")]
    got = st.model_headers(spark.createDataFrame(rows, "root string, path string, chunk_ix int, raw binary")).collect()
    assert sorted((r["path"], r["params"]) for r in got) == [("p", 6), ("q", None)]  # a header that is too long is reported


def test_streams_over_several_batches(spark, tmp_path):
    src = tmp_path / "src"
    day, z = 86400, 20_000 * 86400
    batches = [[(1, "n", "a", 10), (2, "n", "a", 40), (3, "n", "b", 75)], [(1, "n", "a", 10), (4, "n", "a", day + 5), (5, "n", "c", day + 20)], [(6, "n", "a", 9 * day)]]
    for i, rows in enumerate(batches):
        one = spark.createDataFrame([(a, b, c, z + t) for a, b, c, t in rows], "id long, name string, network string, t long")
        one.coalesce(1).write.mode("append").parquet(str(src))
        for f in src.glob("*.parquet"):  # files are taken in order of their times
            if f.stat().st_mtime > 1e9 + 10:
                os.utime(f, (1e9 + i, 1e9 + i))
    s = B.source(spark, str(src), 1)
    one = B.run(B.once_a_day(s.select("name", "network", "t"), ["name", "network"], "t", "400 days"))
    assert sorted((r["network"], int(r["day_at"].timestamp() - z) // day) for r in one.collect()) == [("a", 0), ("a", 1), ("a", 9), ("b", 0), ("c", 1)]
    last = B.run(B.latest(s.select("network", "t", "id"), ["network"], "t", ["id"]), mode="update")
    assert {r["network"]: r["t"] - z for r in last.groupBy("network").agg(F.max("t").alias("t")).collect()} == {"a": 9 * day, "b": 75, "c": day + 20}
    timed = B.event_time(s, "t", "1 day")
    closed = B.run(B.daily(B.once(timed, ["id"]), ["name"], n=F.count(F.lit(1))))
    assert [r["n"] for r in closed.orderBy("day").collect()] == [3, 2]  # the last day is still open
    gap = B.run(B.min_gap(timed.select("name", "t", "id", "at"), ["name"], "t", 60))
    assert sorted(r["t"] - z for r in gap.collect()) == [10, 75, day + 5]  # what comes last waits for the watermark


@pytest.mark.parametrize("files", [[[100, 130, 500], [60, 125, 9000]], [[60, 100, 125, 130, 500, 9000]], [[9000], [500, 130, 125, 100, 60]]])
def test_gap_does_not_depend_on_the_batches(spark, tmp_path, files):
    for i, ts in enumerate(files):
        spark.createDataFrame([("a", t, f"x{t}") for t in ts], "name string, t long, id string").coalesce(1).write.mode("append").parquet(f"{tmp_path}/s")
        time.sleep(0.02)
    s = B.event_time(B.source(spark, f"{tmp_path}/s", 1), "t", "3 hours")
    got = B.run(B.min_gap(s.select("name", "t", "id", "at"), ["name"], "t", 60, "id"))
    assert got.count() == 0  # nothing has been passed by three hours yet
    s = B.event_time(B.source(spark, f"{tmp_path}/s", 1), "t", "1 hour")
    got = B.run(B.min_gap(s.select("name", "t", "id", "at"), ["name"], "t", 60, "id"))
    late = len(files) == 2 and files[0] == [9000]
    assert sorted(r["t"] for r in got.collect()) == ([] if late else [60, 125, 500])


def test_retry_queue(spark, tmp_path):
    tries = []

    def send(df):
        rows = sorted(r["id"] for r in df.collect())
        tries.append(rows)
        return df.filter("id % 2 = 0")  # even ones fail

    step = B.with_retry(send, 100, f"{tmp_path}/q")
    step(spark.createDataFrame([(1, 1000), (2, 1000)], "id long, time long"), 0)
    step(spark.createDataFrame([(3, 1050)], "id long, time long"), 1)
    step(spark.createDataFrame([(5, 2000)], "id long, time long"), 2)
    assert tries == [[1, 2], [2, 3], [5]]
    # a queue that can't be read is an error, not an empty queue
    step(spark.createDataFrame([(4, 2010)], "id long, time long"), 3)
    for f in (tmp_path / "q" / "3").glob("*.parquet"):
        f.write_bytes(b"broken")
    with pytest.raises(Exception):
        step(spark.createDataFrame([(6, 2020)], "id long, time long"), 4)


def test_block_survives_a_crash_before_its_end(spark, tmp_path, monkeypatch):
    import hashlib

    store = st.Store(spark, f"file://{tmp_path}/store")
    hashes = [hashlib.sha256(str(i).encode()).hexdigest() for i in range(6)]
    store.put(spark.createDataFrame([(h, 1, b"x") for h in hashes], "hash string, raw_len long, blob binary"))
    bad = spark.createDataFrame([(hashes[0],)], "hash string")
    files = store._files()

    class Dies:
        def __getattr__(self, name):
            if name == "move":
                raise OSError("crash")
            return getattr(files[0], name)

    with monkeypatch.context() as m:
        m.setattr(store, "_files", lambda: (Dies(), files[1]))
        with pytest.raises(OSError):
            store.block(bad)
    assert store.chunks().count() == 6
    assert store.block(bad) == (1, 0) and store.chunks().count() == 5
    assert store.put(spark.createDataFrame([(hashes[1], 1, b"x"), (hashes[0], 1, b"x")], "hash string, raw_len long, blob binary")) == 1
