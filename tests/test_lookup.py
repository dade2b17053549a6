"""The sliced join gives what a plain join gives, and cuts hot keys."""

import pytest

from dagtrail.operators import lookup as L


@pytest.fixture
def slicing(spark):
    settings = {L.SLICE_ROWS_SETTING: "10"}
    for k, v in settings.items():
        spark.conf.set(k, v)
    yield
    for k in settings:
        spark.conf.unset(k)


def data(spark):
    keys = ["hot"] * 500 + ["warm"] * 25 + ["cold"] * 3 + ["unknown"] * 50 + [None] * 100
    rows = spark.createDataFrame([(k, i) for i, k in enumerate(keys)], "key string, id int")
    lookup = spark.createDataFrame(
        [("hot", 1), ("warm", 2), ("cold", 3), ("unused", 4), (None, 5)], "key string, value int"
    )
    return rows, lookup


def test_hot_keys(spark, slicing):
    rows, _ = data(spark)
    found = {r.key: r._slices for r in L.hot_keys(rows, "key").collect()}
    assert found == {"hot": 50, "unknown": 5, "warm": 3}


@pytest.mark.parametrize("weighed", [False, True])
def test_sliced_join_equals_plain_join(spark, slicing, weighed):
    rows, lookup = data(spark)
    weigh = rows.select("key") if weighed else None
    joined = L.lookup_join(rows, lookup, "key", ["id"], weigh)
    assert sorted(joined.columns) == ["id", "key", "value"]
    plain = sorted(map(tuple, rows.join(lookup, "key").select("key", "id", "value").collect()))
    assert sorted(map(tuple, joined.select("key", "id", "value").collect())) == plain
    assert len(plain) == 528


def test_a_hot_key_is_spread_over_partitions(spark, slicing):
    rows, lookup = data(spark)
    broadcast = ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold")
    for name in broadcast:
        spark.conf.set(name, "-1")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        joined = L.lookup_join(rows, lookup, "key", ["id"]).where("key = 'hot'")
        sizes = joined.rdd.glom().map(len).collect()
    finally:
        for name in broadcast:
            spark.conf.unset(name)
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert sum(sizes) == 500
    assert sum(1 for s in sizes if s) > 1 and max(sizes) < 300


def test_slices_are_no_smaller_than_a_part_of_all_rows(spark, slicing, monkeypatch):
    monkeypatch.setattr(L, "SLICES_OF_ALL", 2)
    rows, lookup = data(spark)
    # 678 rows in parts of 339: only one key needs slices, whatever the setting
    assert {r.key: r._slices for r in L.hot_keys(rows, "key").collect()} == {"hot": 2}
    assert L.lookup_join(rows, lookup, "key", ["id"]).count() == 528


def test_empty_rows(spark):
    rows, lookup = data(spark)
    assert L.lookup_join(rows.limit(0), lookup, "key", ["id"]).count() == 0
