"""The shared folder, hot keys and places within groups."""

from types import SimpleNamespace

import pytest
from pyspark.sql import functions as F

from chunklake import common


def test_a_cluster_needs_a_shared_folder():
    conf = lambda value: SimpleNamespace(get=lambda k, d: value)
    spark = lambda master, value: SimpleNamespace(sparkContext=SimpleNamespace(master=master, getConf=lambda: conf(value)))
    with pytest.raises(ValueError):
        common.shared_dir(spark("spark://host:7077", None))
    assert common.shared_dir(spark("spark://host:7077", "s3://bucket/dir/")) == "s3://bucket/dir"


def test_hot_hashes(spark):
    df = spark.range(10_000).selectExpr("case when id % 3 = 0 then 'hot' when id % 50 = 1 then 'warm' else cast(id as string) end as k")
    h = {r["k"]: r["h"] for r in df.select("k", F.xxhash64("k").alias("h")).distinct().collect()}
    got = set(common.hot_hashes(df, ["k"], 1 / 100))
    assert h["hot"] in got and h["warm"] in got and len(got) <= 100
    assert common.hot_hashes(df.limit(0), ["k"]) == []


def test_places_within_groups(spark):
    df = spark.range(3000).selectExpr("case when id % 10 < 7 then 'big' when id % 10 = 7 then null else concat('g', id % 40) end as g", "(id * 7919) % 3001 as v")
    got = {(r["g"], r["v"]): r["rank"] for r in common.rank_within(df, ["g"], [F.desc("v")]).collect()}
    groups = {}
    for g, v in got:
        groups.setdefault(g, []).append(v)
    assert len(got) == 3000
    for g, vs in groups.items():
        assert [got[g, v] for v in sorted(vs, reverse=True)] == list(range(1, len(vs) + 1))
    assert common.rank_within(df.limit(0), ["g"], [F.desc("v")]).count() == 0


def test_stored_views_are_made_once_per_version(spark, tmp_path):
    made = []

    def make(df):
        made.append(1)
        return df.selectExpr("id + 1 as id")

    path = f"file://{tmp_path}/t"
    spark.range(3).write.parquet(path)
    for _ in range(2):
        assert sorted(r["id"] for r in common.stored(spark.read.parquet(path), "plus", make).collect()) == [1, 2, 3]
    assert len(made) == 1
    spark.range(5).write.mode("overwrite").parquet(path)
    assert common.stored(spark.read.parquet(path), "plus", make).count() == 5 and len(made) == 2
