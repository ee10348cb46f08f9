"""Queries and operators that do the whole job, on cases that a part of it loses."""

import hashlib

from chunklake.operators import accounting as A
from chunklake.operators import planning as L
from chunklake.operators import registry as R


def test_gates_reach_chunks_of_any_model(spark):
    chunks = spark.createDataFrame([("r1", "a"), ("r1", "a"), ("r1", "b"), ("r2", "b"), ("r3", "c"), ("r1", None)], "root string, hash string")
    gates = spark.createDataFrame([("x", "r1", "o/plain"), ("x", "r2", "o/m-7b-0"), ("y", "r2", "o/z"), ("x", "r9", "o/none")], "registry string, root string, repo string")
    got = {tuple(r) for r in L.chunk_gates(chunks, gates).select("registry", "hash", "repos").collect()}
    assert got == {("x", "a", "o/plain"), ("x", "b", "o/m-7b-0,o/plain"), ("y", "b", "o/z")}


def test_chunk_gates_of_the_log(spark, data):
    from chunklake.common import key, table
    from chunklake.queries import planning as Q

    gates = {(r["registry"], r["root"]): r["repo"] for r in R.gates(R.claims(table(spark, data, "log"))).collect()}
    want: dict[tuple, set] = {}
    for r in table(spark, data, "chunks").select(key("root").alias("root"), key("hash").alias("hash")).distinct().collect():
        for g, root in gates:
            if root == r["root"] and r["hash"] is not None:
                want.setdefault((g, r["hash"]), set()).add(gates[g, root])
    got = {(r["registry"], r["hash"]): r["repos"] for r in Q.chunk_gates(spark, data).collect()}
    assert got and got == {k: ",".join(sorted(v)) for k, v in want.items()}


def _log(spark, sigs):
    """A chain with these signatures."""
    rows, prev = [], "0" * 64
    for n, g in enumerate(sigs):
        rows.append(("x", n, prev, (("publish",), n, ("k", g)), None))
        prev = hashlib.sha256(f"{n}|{prev}|{g}".encode()).hexdigest()
    shape = "registry string, seq long, prev string, statement struct<claim: struct<kind string>, time bigint, signature: struct<key string, sig string>>, received timestamp"
    return spark.createDataFrame(rows, shape), prev


def test_head_and_audit_at_repeated_signatures(spark, tmp_path):
    from chunklake.queries import registry as Q

    log, last = _log(spark, ["a", "b", "a", "c", "b"])
    assert [tuple(r) for r in R.head(R.chain(log)).collect()] == [("x", 5, last)]
    heads = spark.createDataFrame([("x", 5, last), ("x", 4, last), ("x", 6, last)], "registry string, size long, hash string")
    assert {r["size"]: r["ok"] for r in R.audit(R.chain(log), heads).collect()} == {4: False, 5: True, 6: False}
    log.write.parquet(f"{tmp_path}/log.parquet")
    assert [tuple(r) for r in Q.registry_head(spark, str(tmp_path)).collect()] == [("x", 5, last)]
    assert {r["size"]: r["ok"] for r in Q.registry_audit(spark, str(tmp_path)).collect()} == {1: True, 2: False, 3: True, 4: False, 5: True}


def test_whole_texts_are_coded(spark, tmp_path):
    from urllib.parse import quote, unquote

    from chunklake.queries import planning as Q

    texts = ["a b+c~*%20/é\r\nüber 日本 😀 " * 9, "x" * 100, "", "\t\x00\x7f", None]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    rows = {r["doc_id"]: r for r in Q.url_functions(spark, str(tmp_path)).collect()}
    hexes = {r["doc_id"]: r for r in Q.content_hashes(spark, str(tmp_path)).collect()}
    assert set(rows) == set(hexes) == {0, 1, 2, 3}
    for n, r in rows.items():
        assert r["encoded"] == quote(texts[n], safe="") and unquote(r["encoded"]) == texts[n] and r["same"]
        assert hexes[n]["hex"] == texts[n].encode().hex() and hexes[n]["same"]


def test_days_of_every_registered_node(spark, data):
    from chunklake.queries import accounting as Q

    nodes = {r["peer"]: r["registered"] for r in Q._nodes(spark, data).collect()}
    days = Q._days(spark, data).filter(f"day_no + 2 <= {Q.TODAY}").collect()
    got = Q.days_finalized(spark, data).collect()
    want = {(r["day_no"], r["peer"]) for r in days if r["peer"] in nodes}
    assert {(r["day_no"], r["peer"]) for r in got} == want and len(got) == len(want) < len(days)
    assert {nodes[p] % 2 for _, p in want} == {0, 1}
    assert all(r["bytes_served"] == sum(x["bytes"] for x in days if x["day_no"] == r["day_no"]) for r in got)


def test_probes_of_anchors_and_registered_nodes(spark):
    rows = [
        (1, "a1", "n1", "r2", "held", 0), (2, "a1", "n1", "r1", "held", 10), (3, "a1", "n1", "r1", "held", 50), (4, "bad", "n1", "r1", "held", 500),
        (5, "a1", "n9", "r1", "up", 600), (6, "a1", "n1", "r2", "up", 700), (7, "a1", "n1", None, None, 800), (8, "a1", "n1", None, "held", 900),
    ]
    p = spark.createDataFrame(rows, "probe_id int, anchor string, node string, root string, outcome string, t long")
    anchors = spark.createDataFrame([("a1",), ("a1",)], "anchor string")
    nodes = spark.createDataFrame([("n1", ["r1"])], "peer string, models array<string>")
    ids = lambda df: sorted(r["probe_id"] for r in df.collect())
    assert ids(A.accepted_probes(p, 60, anchors, nodes)) == [2, 6, 7]
    assert ids(A.accepted_probes(p, 60)) == [1, 4, 5, 6, 7, 8]
    assert {tuple(r) for r in A.held(A.accepted_probes(p, 60, anchors, nodes), 1000).collect()} == {("n1", "r1", 10)}


def test_expiry_of_probes(spark):
    day, at = 86400, 10 * 86400 + 5
    p = spark.createDataFrame([("a", "n", "r", "held", t) for t in (2 * day, 4 * day, 9 * day, 9 * day + 6)] + [("b", "n", "q", "held", 9 * day + 5)], "anchor string, node string, root string, outcome string, t long")
    none = spark.createDataFrame([], "t long, day_no int, last_seen long")
    kept = A.expire(none, none, none, none, at, p)
    assert sorted(r["t"] for r in kept["probes"].collect()) == [9 * day, 9 * day + 5, 9 * day + 6]
    assert sorted(tuple(r) for r in kept["last_probe"].collect()) == [("a", "n", 9 * day + 6)]
    assert sorted(tuple(r) for r in kept["held"].collect()) == [("n", "q", 9 * day + 5), ("n", "r", 9 * day + 6)]
    assert set(A.expire(none, none, none, none, at)) == {"lookups", "credits", "days", "nodes"}


def test_every_id_gives_its_own_row(spark, tmp_path):
    from chunklake.queries import accounting, planning

    ids = [0, 1, 255, 256, 257, 70_000, 2**31]
    spark.createDataFrame([(i,) for i in ids] * 2 + [(None,)], "user_id long").write.parquet(f"{tmp_path}/events.parquet")
    got = {r["ip"]: r["network"] for r in accounting.networks(spark, str(tmp_path)).collect()}
    assert len(got) == 4 * len(ids) and got["0.1.17.112"] == got["::ffff:0.1.17.112"] == "0.1.17.0/24" and got["2001:1:1170::1"] == "2001:1:1170::/48"
    assert got["2001:0:0::1"] == "2001:0:0::/48" and got["128.0.0.0"] == "128.0.0.0/24"
    spark.createDataFrame([(i, "B", 1) for i in range(1, 101)], "p_partkey long, p_brand string, p_size int").write.parquet(f"{tmp_path}/part.parquet")
    numbers = {r["number"] for r in planning.layer_keys(spark, str(tmp_path)).collect() if r["name"].startswith("model.layers.")}
    assert numbers == set(range(1, 101))
