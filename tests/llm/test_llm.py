"""The five problems of the subpackage against brute force, exact round trips and other libraries."""

import base64
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from chunklake.llm import bpe, distinct, frequent, packing

# ---------------------------------------------------------------- distinct counts


def rows_of(spark):
    rnd = random.Random(1)
    rows = [(rnd.randrange(3), rnd.choice(["hot"] * 6 + ["a", "b", None]), rnd.choice("xy"), rnd.choice([None, *map(str, range(900))])) for _ in range(5000)]
    return rows, spark.createDataFrame(rows + rows[:100], "day int, root string, server string, id string")


def exact(rows, groups):
    out = {}
    for r in rows:
        if r[3] is not None:
            out.setdefault(tuple(r[g] for g in groups), set()).add(r[3])
    return {k: len(v) for k, v in out.items()}


def test_counts_of_every_combination_within_the_error(spark):
    rows, df = rows_of(spark)
    m = distinct.bits_for(len(rows))
    groups = ["root", "server", "day"]
    got = distinct.cube_counts(distinct.partials(df, groups, "id", m), groups, m).collect()
    n = 0
    for names, ix in ((("root", "server", "day"), (1, 2, 0)), (("day",), (0,)), ((), ()), (("root", "day"), (1, 0)), (("server",), (2,))):
        want = exact(rows, ix)
        mine = {tuple(r[c] for c in names): r["estimate"] for r in got if r["grouping"] == ",".join(names)}
        assert set(mine) == set(want)
        for k, v in want.items():
            assert abs(mine[k] - v) <= max(1, 4 * distinct.ERROR * v)
        n += len(want)
    # the same from two halves whose bitmaps differ in size, merged
    halves = [(distinct.partials(df.filter("day = 0"), groups, "id", m), m), (distinct.partials(df.filter("day > 0"), groups, "id", 4 * m), 4 * m)]
    part, bits = distinct.merge(halves, groups)
    assert bits == m
    again = distinct.cube_counts(part, groups, bits).collect()
    key = lambda r: (r["grouping"], str(r["root"]), str(r["server"]), str(r["day"]), r["bits_set"], r["error"])
    assert sorted(map(key, again)) == sorted(map(key, got))
    assert all(r["error"] <= distinct.ERROR for r in got)


def test_bitmap_sizes():
    for n in (0, 1, 10**4, 10**6, 10**8):
        m = distinct.bits_for(n)
        assert m & (m - 1) == 0 and (n == 0 or distinct.standard_error(n, m) <= distinct.ERROR)


def test_full_bitmap_and_empty_table(spark):
    df = spark.range(2000).selectExpr("1 as g", "cast(id as string) as id")
    full = distinct.cube_counts(distinct.partials(df, ["g"], "id", 64), ["g"], 64).filter("grouping = 'g'").first()
    assert full["bits_set"] == 64 and full["estimate"] is None and full["error"] is None
    assert distinct.cube_counts(distinct.partials(df.limit(0), ["g"], "id", 1 << 16), ["g"], 1 << 16).count() == 0


def test_bits_beyond_an_int(spark):
    m = 1 << 45
    part = distinct.partials(spark.range(1000).selectExpr("1 as g", "cast(id as string) as id"), ["g"], "id", m)
    assert part.agg({"word_ix": "max"}).first()[0] > 1 << 31
    assert {r["estimate"] for r in distinct.cube_counts(part, ["g"], m).collect()} == {1000}
    folded = distinct.fold(part, ["g"], 1 << 16)
    assert folded.agg({"word_ix": "max"}).first()[0] < 1 << 10


# ---------------------------------------------------------------- frequent items


@pytest.mark.parametrize("node_values", [5, 50, 10**6])
def test_frequent_items(spark, node_values):
    rnd = random.Random(2)
    values = [rnd.choice(["hot"] * 30 + ["warm"] * 3 + [None]) if rnd.random() < 0.5 else str(rnd.randrange(300)) for _ in range(4000)]
    df = spark.createDataFrame([(v,) for v in values], "item string").repartition(7)
    want = {}
    for v in values:
        want[v] = want.get(v, 0) + 1
    top = sorted(want.items(), key=lambda x: (-x[1], x[0] is not None, x[0] or ""))[:20]
    assert [tuple(r) for r in frequent.top_k(df, 20, node_values).collect()] == top
    assert {tuple(r) for r in frequent.over_share(df, 0.01, node_values).collect()} == {(k, n) for k, n in want.items() if n >= 40}


def test_frequent_items_edges(spark):
    df = spark.createDataFrame([("a",), ("b",), ("b",)], "item string")
    assert [tuple(r) for r in frequent.top_k(df, 10).collect()] == [("b", 2), ("a", 1)]
    assert frequent.top_k(df.limit(0), 3).count() == 0 and frequent.over_share(df.limit(0), 0.1).count() == 0


# ---------------------------------------------------------------- tokens


def other():
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(bpe.vocabulary_path(), "rb"))}
    return tiktoken.Encoding("own", pat_str=bpe.PATTERN, mergeable_ranks=ranks, special_tokens={})


@given(st.text(max_size=300))
@settings(max_examples=300, deadline=None)
def test_ids_equal_another_library_and_decode_back(text):
    e = bpe.encoder(bpe.vocabulary_path())
    ids = e.encode(text)
    assert ids == other_encoding.encode_ordinary(text)
    assert bpe.decode(ids) == text.encode()


other_encoding = other()


def test_ids_of_long_words_and_special_strings():
    e = bpe.encoder(bpe.vocabulary_path())
    rnd = random.Random(3)
    for w in ("a" * 5000, " " * 3000, "=-" * 2000, "あ" * 2000, "<|endoftext|>", "\r\n\t x y", "".join(rnd.choice("abcdefgh") for _ in range(9000))):
        assert e.encode(w) == other_encoding.encode_ordinary(w)
    for _ in range(200):
        w = bytes(rnd.choice(b"abcdet ,\xc3\xa9") for _ in range(rnd.randrange(1, 200)))
        assert bpe.merge_short(w, e.ranks) == bpe.merge_long(w, e.ranks)


def test_encode_frames(spark):
    df = spark.createDataFrame([(1, "hello world", 7), (2, None, 8), (3, "", 9), (1, "hello world", 7)], "doc_id long, text string, ids int")
    got = sorted((r["doc_id"], r["ids"]) for r in bpe.encode(df).collect())
    assert got == [(1, [31373, 995]), (1, [31373, 995]), (2, []), (3, [])]
    assert sorted(r["tokens"] for r in bpe.count_tokens(df).collect()) == [0, 0, 2, 2]
    assert bpe.encode(df.limit(0)).count() == 0


# ---------------------------------------------------------------- packing


@given(st.lists(st.integers(1, 100), min_size=1, max_size=300), st.sampled_from([1, 3, 20, 100]))
@settings(max_examples=150, deadline=None)
def test_packing_places_every_piece_within_the_capacity(lengths, parts):
    n = np.array(lengths)
    where, count = packing.pack_lengths(n, 100, parts)
    used = np.bincount(where, weights=n, minlength=count)
    assert (where >= 0).all() and used.max() <= 100 and (used > 0).all()
    if parts == 1:  # plain harmonic classes: k pieces of the class a container begins with, but for the last of a class
        first = np.full(count, 101)
        np.minimum.at(first, where, 100 // n)
        for k in set(first.tolist()):
            held = [int(((where == c) & (100 // n == k)).sum()) for c in np.flatnonzero(first == k)]
            assert max(held) <= k and sum(h < k for h in held) <= 1


@pytest.mark.parametrize("name,low", [("uniform", 0.995), ("halves", 0.99), ("lognormal", 0.995), ("small", 0.995)])
def test_fill_of_several_distributions(name, low):
    r = np.random.default_rng(7)
    x = {
        "uniform": r.integers(1, 1024, 50_000), "halves": np.concatenate([r.integers(342, 513, 25_000), r.integers(513, 683, 25_000)]),
        "lognormal": np.clip(r.lognormal(5, 1, 50_000).astype(int), 1, 1023), "small": r.integers(1, 101, 50_000),
    }[name]
    _, count = packing.pack_lengths(x)
    assert x.sum() / (packing.CAPACITY * count) >= low


def test_pack_copies_null_and_equal_ids(spark):
    df = spark.range(6000).selectExpr("cast(case when id % 3 = 0 then null else 7 end as bigint) as id", "250 as n")
    got = packing.pack(df, "id", "n", 1000, share_rows=500)
    assert got.count() == 6000 and got.groupBy("container").agg({"length": "sum"}).filter("`sum(length)` > 1000").count() == 0
    assert got.selectExpr("split(container, '-')[0] as s").groupBy("s").count().agg({"count": "max"}).first()[0] < 700
    same = packing.pack(df, "id", "n", 1000, share_rows=500)
    assert got.exceptAll(same).count() == 0
    big = packing.pack(spark.createDataFrame([(1, 250), (1, 350), (None, 250), (None, 250)], "id long, n int"), "id", "n", 100)
    assert big.filter("container like 'full%'").groupBy("container").count().filter("count > 1").count() == 0


def test_pack_frames(spark):
    rnd = random.Random(4)
    rows = [(i, rnd.choice([0, None, 5, 60, 100, 101, 250, 300, rnd.randrange(1, 100)])) for i in range(700)] + [(5, 77), (5, 77), (None, 10)]
    df = spark.createDataFrame(rows, "id long, n int")
    got = packing.pack(df, "id", "n", 100, share_rows=100).collect()
    assert sum(r["length"] for r in got) == sum(n or 0 for _, n in rows)
    used = {}
    for r in got:
        used.setdefault(r["container"], []).append(r["length"])
        assert r["length"] <= 100
    for r in got:
        assert sum(used[r["container"]]) == r["used"] <= 100
    cut = {r["item_id"] for r in got if r["start"] > 0}
    assert cut == {i for i, n in rows if n and n > 100}
    assert sum(map(sum, used.values())) / (100 * len(used)) > 0.9
    assert packing.pack(df.limit(0), "id", "n").count() == 0
