"""The four general problems against brute force, with their edge cases."""

import hashlib
import random
from collections import defaultdict

import pyarrow.parquet as pq
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyarrow import fs
from pyspark.sql import functions as F

from chunklake.operators import changes, compaction, orphans, rolling


def brute_orphans(refs, parents):
    out = []
    for kind, key, at, rid in refs:
        if key is None:
            continue
        own = [(s, u) for k, y, s, u in parents if (k, y) == (kind, key) and s is not None]
        if at is None:
            if not own:
                out.append((rid, "missing"))
            continue
        if any(s <= at and (u is None or at < u) for s, u in own):
            continue
        gone = any(u is not None and u <= at for s, u in own)
        later = any(s > at for s, u in own)
        out.append((rid, "deleted" if gone else "late" if later else "missing"))
    return sorted(out)


REFS = "kind string, key string, at long, row_id long"
PARENTS = "kind string, key string, since long, until long"


def found(spark, refs, parents, **more):
    f = orphans.find_orphans(spark.createDataFrame(refs, REFS), spark.createDataFrame(parents, PARENTS), **more)
    return sorted((r.row_id, r.state) for r in f.collect())


def test_orphans_random_with_hot_key(spark):
    rnd = random.Random(1)
    refs = [(rnd.choice("ab"), rnd.choice(["hot"] * 5 + ["k1", "k2", "k3", None]), rnd.choice([None, *range(50)]), i) for i in range(800)]
    parents = [(rnd.choice("ab"), rnd.choice(["hot", "k1", "k2"]), s, rnd.choice([None, s + 3, s + 9])) for s in (rnd.randrange(60) for _ in range(12))]
    assert found(spark, refs, parents) == brute_orphans(refs, parents)


def test_orphans_edges(spark):
    assert found(spark, [], []) == []
    assert found(spark, [("a", "x", 5, 1), ("a", None, 5, 2)], []) == [(1, "missing")]
    assert found(spark, [("a", "x", 5, 1)], [("a", "x", 5, None), ("a", "x", 5, None)]) == []  # there from its start on
    assert found(spark, [("a", "x", 9, 1)], [("a", "x", 5, 9)]) == [(1, "deleted")]  # until before its end
    assert found(spark, [("a", "x", 9, 1)], [("a", "x", 5, 9), ("a", "x", 9, None)]) == []  # back at once
    assert found(spark, [("a", "x", 9, 1)], [("a", None, 5, 9), ("a", "x", None, 9)]) == [(1, "missing")]
    assert found(spark, [("a", "x", 1, 1), ("a", "x", 1, 1)], []) == [(1, "missing")] * 2


def test_orphans_keep_clashing_columns(spark):
    refs = spark.createDataFrame([("a", "x", 5, 7, 1, "s")], "kind string, key string, at long, since long, open int, row string")
    r = orphans.find_orphans(refs, spark.createDataFrame([], PARENTS)).first()
    assert (r["since"], r["open"], r["row"], r["state"]) == (7, 1, "s", "missing")


def saves(spark, rows):
    return spark.createDataFrame(rows, "registry string, day string, name string, downloads long, saved long").selectExpr(
        "registry", "to_date(day) as day", "name", "downloads", "timestamp_seconds(1735689600 + saved * 864000) as saved"
    )


def test_rolling_against_brute_force_and_steps(spark):
    rnd = random.Random(2)
    rows = [(rnd.choice("rs"), f"2025-0{rnd.choice('123')}-{rnd.randrange(1, 29):02}", rnd.choice(["x", "y", None]), rnd.choice([None, 0, 1, 5]), rnd.randrange(9)) for _ in range(120)]
    rows += rows[:20]
    latest = {}
    for r, d, n, v, s in sorted(set(rows), key=lambda x: (x[4], x[3] is not None, x[3] or 0)):
        if v is not None:
            latest[(r, n, d)] = v
    import datetime as dt

    day = dt.date.fromisoformat
    c = rolling.amount_versions(saves(spark, rows))
    got = {(r["name"], str(r["day"])): (r["total_7"], r["total_30"]) for r in rolling.rolling_state(c, ["name"], "2025-02-01", "2025-03-10").collect()}
    names = {n for _, n, _ in latest}
    assert len(got) == len(names) * 38
    for (n, d), (a, b) in got.items():
        want = [sum(v for (_, m, e), v in latest.items() if m == n and 0 <= (day(d) - day(e)).days < p) for p in (7, 30)]
        assert [a, b] == want, (n, d)
    assert c.filter("late").count() > 10 and c.filter("not late").count() > 10
    # yesterday's state, today's arrivals and the expiring amounts give today's, a day at a time as in blocks of any length
    known = c.withColumn("late", F.lit(False))
    amounts = c.groupBy("name", "day").agg(F.sum("change").alias("amount"), F.max("version").alias("version"))
    full = rolling.rolling_state(known, ["name"], "2025-01-01", "2025-03-10")
    step = rolling.advance(full.filter("day = '2025-02-14'"), amounts, ["name"], "2025-02-15", "2025-02-15")
    assert sorted(map(str, step.collect())) == sorted(map(str, full.filter("day = '2025-02-15'").select(step.columns).collect()))
    assert sorted(map(str, rolling.rolling_state(known, ["name"], "2025-01-01", "2025-03-10", block=7).collect())) == sorted(map(str, full.collect()))
    # what is known late gives the same totals as what is known in time
    assert sorted(map(str, rolling.rolling_state(c, ["name"], "2025-01-01", "2025-03-10").collect())) == sorted(map(str, full.collect()))
    # a correction changes and marks only the days whose periods hold its day
    fix = spark.createDataFrame([("x", 10, 99)], "name string, change long, version int").selectExpr("name", "to_date('2025-02-10') as day", "change", "version")
    state = rolling.rolling_state(known, ["name"], "2025-02-01", "2025-03-10")
    new = rolling.apply_corrections(state, fix, ["name"])
    more = known.select("name", "day", "change", "version", "late").unionByName(fix.withColumn("late", F.lit(False)))
    again = rolling.rolling_state(more, ["name"], "2025-02-01", "2025-03-10")
    pick = ["name", "day", "total_7", "total_30"]
    assert sorted(map(str, new.select(pick).collect())) == sorted(map(str, again.select(pick).collect()))
    assert new.filter("version = 99").count() == 29


def test_rolling_empty(spark):
    c = rolling.amount_versions(saves(spark, []))
    assert rolling.rolling_state(c, ["name"], "2025-02-01", "2025-02-03").count() == 0


BLOBS = "file_id long, hh string, hash string, raw_len long, version byte, codec byte, param byte, payload binary, written timestamp_ntz, removed timestamp_ntz, share string, unit int"


def blob(i, h, n=5, payload=b"x", removed=None, raw_len=7):
    import datetime as dt

    t = dt.datetime(2025, 2, 1) + dt.timedelta(seconds=i)
    return (n, None, h, raw_len, 1, 0, 0, payload, t, removed, "clash", 1)


def test_compaction(spark, tmp_path):
    import datetime as dt

    keys = [hashlib.sha256(str(i).encode()).hexdigest() for i in range(300)]
    rows = [blob(i, k.upper() if i % 3 else f" {k} ", i // 3, bytes([i % 256]) * (i % 40)) for i, k in enumerate(keys)]
    rows += [rows[0], rows[1], blob(9, keys[2], 77, b"new"), blob(1, None), blob(1, " "), blob(2, keys[5], payload=None), blob(3, "f" * 64, removed=dt.datetime(2025, 3, 1)), blob(4, keys[7], raw_len=None)]
    df = spark.createDataFrame(rows, BLOBS)
    folder = compaction.compact(df, f"file://{tmp_path}/a", target=2000, groups=3)
    got = compaction.compacted(spark, folder).collect()
    assert sorted(r["hash"] for r in got) == sorted(keys)
    assert {r["raw_len"] for r in got} == {7}
    assert next(r for r in got if r["hash"] == keys[2])["payload"] == b"new"  # the last written one
    made = spark.read.parquet(f"{folder}/manifest").collect()
    assert sum(r["rows"] for r in made) == 300
    assert fs.LocalFileSystem().get_file_info(f"{tmp_path}/a/tmp").type == fs.FileType.NotFound
    # a file that no manifest names doesn't count
    import shutil

    some = made[0]["path"]
    shutil.copy(some, f"{tmp_path}/a/data/part-stray.parquet")
    assert compaction.compacted(spark, folder).count() == 300
    # records that were exchanged for others are seen, although their number is right, as are lost ones
    rows_, check = sum(r["rows"] for r in made), int(sum(r["check"] for r in made))
    compaction.verify(spark, folder, (rows_, check))
    for want in ((rows_, check + 1), (rows_ + 1, check)):
        with pytest.raises(OSError):
            compaction.verify(spark, folder, want)
    pq.write_table(pq.read_table(some).slice(1), some)
    with pytest.raises(OSError):
        compaction.verify(spark, folder, (rows_, check))
    fs.LocalFileSystem().delete_file(f"{tmp_path}/a/CURRENT")
    with pytest.raises(FileNotFoundError):
        compaction.compacted(spark, folder)


def test_compaction_empty_and_hot_file(spark, tmp_path):
    assert compaction.compacted(spark, compaction.compact(spark.createDataFrame([], BLOBS), f"file://{tmp_path}/e")).count() == 0
    keys = [hashlib.sha256(str(i).encode()).hexdigest() for i in range(500)]
    df = spark.createDataFrame([blob(i, k, 1, b"y" * 50) for i, k in enumerate(keys)], BLOBS)  # one loose file holds everything
    folder = compaction.compact(df, f"file://{tmp_path}/h", target=4000, groups=2)
    assert compaction.compacted(spark, folder).count() == 500
    assert spark.read.parquet(f"{folder}/manifest").count() > 5


@given(st.lists(st.integers(1, 1000), min_size=1, max_size=60), st.integers(1, 7))
@settings(max_examples=60, deadline=None)
def test_longest_first_is_balanced(sizes, groups):
    sizes = sorted(sizes, reverse=True)
    load = [0] * groups
    for n, g in zip(sizes, compaction.assign_longest_first(((i, s) for i, s in enumerate(sizes)), groups)):
        load[g] += n
    assert max(load) <= sum(sizes) / groups + max(sizes)


def own(seq, prev, sig):
    return hashlib.sha256(f"{seq}|{prev}|{sig}".encode()).hexdigest()


def make_chain(n, start=0, prev=changes.GENESIS, tag="s"):
    out = []
    for i in range(start, start + n):
        h = own(i, prev, f"{tag}{i}")
        out.append(("r", i, prev, h))
        prev = h
    return out


@pytest.mark.parametrize("fanout", [3, 4, 1000])
def test_longest_chain(spark, fanout):
    main = make_chain(25)
    fork = make_chain(9, 10, main[9][3], "f")  # leaves the log at 10 and ends at 18
    tail = make_chain(3, 24, main[23][3], "t")  # leaves it at 24 and reaches further
    loose = make_chain(40, 30, "a" * 64, "l")
    false_start = make_chain(2, 0, "b" * 64, "x")
    flood = [("r", 5, main[4][3], f"{i:064x}") for i in range(300)] + [("r", 24, main[23][3], "f" * 64)]
    rows = flood + main + fork + tail + loose + false_start + main[:5] + [("r", None, "x", "y"), ("r", 3, None, "y"), (None, 0, changes.GENESIS, "y"), ("q", 10**15, "x", "y")]
    random.Random(3).shuffle(rows)
    df = spark.createDataFrame(rows, "log string, seq long, prev string, own string")
    got = sorted((r["seq"], r["own"]) for r in changes.longest_chain(df, fanout).collect())
    assert got == [(s, o) for _, s, _, o in main[:24] + tail]
    assert changes.longest_chain(df.limit(0), fanout).count() == 0


@pytest.mark.parametrize("seed", range(4))
def test_longest_chain_among_random_branches(spark, seed):
    rnd = random.Random(seed)
    rows = make_chain(40)
    for i in range(25):  # branches of one to nine entries, also off other branches, some as long as the log
        at = rnd.choice(rows)
        rows += make_chain(rnd.choice([1, 1, 2, 3, 5, 9, 39 - at[1] if at[1] < 39 else 1]), at[1] + 1, at[3], f"b{i}-")
    known = {(r[1], r[2]): [] for r in rows}
    for r in rows:
        known[(r[1], r[2])].append(r)
    best = {}  # the furthest end from an entry on: (seq, smallest hash), and the way there
    for r in sorted(rows, key=lambda r: -r[1]):
        ways = [best[k[3]] for k in known.get((r[1] + 1, r[3]), [])]
        far = min(ways, key=lambda w: (-w[0], w[1])) if ways else (r[1], r[3], [])
        best[r[3]] = (far[0], far[1], [(r[1], r[3]), *far[2]])
    want = min((best[r[3]] for r in rows if r[1] == 0), key=lambda w: (-w[0], w[1]))[2]
    df = spark.createDataFrame(rows, "log string, seq long, prev string, own string")
    for fanout in (4, 8192):
        assert sorted((r["seq"], r["own"]) for r in changes.longest_chain(df, fanout).collect()) == want


def brute_replay(rows):
    state = {}
    for k, s, op, a, b in sorted((r for r in set(rows) if r[1] is not None and r[2] in ("upsert", "delete")), key=lambda r: r[1]):
        if op == "delete":
            state.pop(k, None)
        else:
            old = state.get(k, (None, None))
            state[k] = (a if a is not None else old[0], b if b is not None else old[1])
    return state


def test_replay_random(spark):
    rnd = random.Random(4)
    rows = []
    for i in range(600):
        rows.append((rnd.choice(["hot"] * 4 + ["a", "b", None]), i, rnd.choice(["upsert"] * 3 + ["delete", "other"]), rnd.choice([None, "p", "q"]), rnd.choice([None, 1, 2])))
    rows += rnd.sample(rows, 100) + [("a", None, "upsert", "z", 9)]
    rnd.shuffle(rows)
    df = spark.createDataFrame(rows, "k string, seq long, op string, a string, b long").repartition(5)
    got = {r["k"]: (r["a"], r["b"]) for r in changes.replay(df, ["k"], "seq", "op", ["a", "b"]).collect()}
    assert got == brute_replay(rows)
    assert changes.replay(df.limit(0), ["k"], "seq", "op", ["a", "b"]).count() == 0
    clash = df.selectExpr("k as put", "seq", "op", "a as cut", "b as a_at", "'x' as _more")
    assert {r["put"]: (r["cut"], r["a_at"]) for r in changes.replay(clash, ["put"], "seq", "op", ["cut", "a_at"]).collect()} == brute_replay(rows)


def test_registry_state_rules(spark):
    def entry(i, prev, claim, key="K1", sig=None):
        sig = sig or f"s{i}"
        c = defaultdict(lambda: None, claim)
        names = ["kind", "name", "rev", "root", "description", "gated", "org", "key", "hash", "reason", "repo", "addrs", "expires"]
        return ("r", i, prev, (tuple(c[n] for n in names), 1, (key, sig)), None), own(i, prev, sig)

    claims = [
        ({"kind": "publish", "name": "o/m", "rev": "v1", "root": "A" * 64, "gated": "g/h"}, "K1", None),
        ({"kind": "publish", "name": "o/m", "rev": "v1", "root": "b" * 64}, "K2", None),  # no owner is added
        ({"kind": "grant", "org": "o", "key": "K3"}, "K1", None),
        ({"kind": "revoke", "org": "o", "key": "K1"}, "K1", None),
        ({"kind": "block", "hash": " " + "C" * 64}, "K1", None),
        ({"kind": "gate", "root": "b" * 64, "repo": "x/y"}, "K1", None),
        ({"kind": "gate", "root": "a" * 64, "repo": ""}, "K1", None),  # lifts the first gate
        ({"kind": "unblock", "hash": "c" * 64}, "K1", "s4"),  # this signature was there before
        ({"kind": "anchors", "addrs": ["z"]}, "K1", None),
    ]
    rows, prev = [], changes.GENESIS
    for i, (c, k, s) in enumerate(claims):
        row, prev = entry(i, prev, c, k, s)
        rows.append(row)
    rows.append(("r", 2, rows[2][2], None, None))  # a copy without its statement
    shape = "registry string, seq long, prev string, statement struct<claim: struct<kind string, name string, rev string, root string, description string, gated string, org string, key string, hash string, reason string, repo string, addrs array<string>, expires bigint>, time bigint, signature: struct<key string, sig string>>, received timestamp"
    got = sorted(tuple(r) for r in changes.registry_state(spark.createDataFrame(rows[::-1], shape)).collect())
    assert got == [("r", "blocked", "c" * 64, ""), ("r", "gate", "b" * 64, "x/y"), ("r", "name", "o/m@v1", "b" * 64), ("r", "owner", "o", "K3")]
