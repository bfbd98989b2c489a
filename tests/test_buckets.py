"""Tables in bucket folders: changes rewrite what they touch, and applying a batch again changes nothing."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from stockloom.operators import customer, maintain
from stockloom.session import scratch_dir
from stockloom.sources.buckets import BucketTable

ROWS = "k string, n int, v string"


def _files(table):
    return {f.rsplit("/", 2)[1] + "/" + f.rsplit("/", 1)[1] for f in table._stored().inputFiles()}


def test_upsert_rewrites_only_touched_buckets(spark):
    base = spark.createDataFrame([(f"k{i}", i, "old") for i in range(300)], ROWS)
    table = BucketTable(spark, scratch_dir(spark, "table"), ["k"], base.schema, 16)
    table.replace(base)
    before = _files(table)
    updates = spark.createDataFrame([("k7", 70, "new"), ("k8", 80, None), ("other", 1, "new")], ROWS)
    touched = maintain.upsert_stored(table, updates, 1)
    assert 1 <= len(touched) <= 3
    kept = {f for f in before if int(f.split("/")[0].split("=")[1]) not in touched}
    assert kept and kept <= _files(table) and not (before - kept) & _files(table)
    want = sorted(map(tuple, maintain.upsert(base, updates, ["k"]).collect()), key=str)
    assert sorted(map(tuple, table.read().collect()), key=str) == want and len(want) == 301
    after = _files(table)
    assert maintain.upsert_stored(table, updates, 1) == [] and _files(table) == after  # applied already
    assert maintain.upsert_stored(table, spark.createDataFrame([], ROWS), 2) == []
    with pytest.raises(Exception, match="duplicate key"):
        maintain.upsert_stored(table, updates.union(updates), 3)
    assert sorted(map(tuple, table.read().collect()), key=str) == want


def _load(rng, n, start):
    day = datetime(2031, 1, 1)
    customers = [None, *range(12)]
    buys = [(start + i, rng.choice(customers[1:]), day + timedelta(hours=rng.randrange(60)), rng.choice([None, 1.25, 9.5])) for i in range(n)]
    saved = [(start + i, rng.choice(customers[1:]), rng.choice("ab?"), day + timedelta(hours=rng.randrange(9))) for i in range(n)]
    back = [(start + i, rng.choice(customers[1:]), rng.choice(["fit", "late", None]), rng.choice([None, 0.1, 5.0])) for i in range(n)]
    return buys, saved, back


def test_loads_equal_one_full_refresh(spark):
    rng = random.Random(2)
    loads = [_load(rng, 120, 0), _load(rng, 90, 1000), tuple([r for r in part if r[1] == 3] for part in _load(rng, 60, 2000))]

    def frames(part):
        money = lambda df, c: df.withColumn(c, F.col(c).cast("decimal(10,2)"))
        return (
            money(spark.createDataFrame(part[0], "transaction_id bigint, customer_id int, transaction_ts timestamp, net_amount double"), "net_amount"),
            spark.createDataFrame(part[1], "saved_item_id bigint, customer_id int, product_id string, saved_at timestamp"),
            money(spark.createDataFrame(part[2], "return_id bigint, customer_id int, reason_code string, refund_amount double"), "refund_amount"),
        )

    products = spark.createDataFrame([("a", "A", "c", "red", "S"), ("b", "B", "c", None, "M")], "product_id string, product_name string, category string, color string, size_code string")
    people = spark.createDataFrame([(i, *[f"x{i}"] * 5, 1, "n", "b") for i in range(13)], "customer_id int, loyalty_id string, email string, first_name string, last_name string, tier string, preferred_store_id int, stylist_notes string, lifetime_value_band string")
    likes = spark.createDataFrame([(i, ["s"], ["c"], ["b"], ["o"]) for i in range(0, 13, 2)], "customer_id int, preferred_sizes array<string>, preferred_colors array<string>, preferred_brands array<string>, shopping_occasions array<string>")
    stored = customer.StoredProfiles(spark, scratch_dir(spark, "profiles"), buckets=8)
    for batch, part in enumerate(loads, 1):
        buys, saved, back = frames(part)
        touched = stored.load(buys, saved, products, back, batch)
        assert batch < 3 or all(len(b) == 1 for b in touched.values())
        if batch == 2:
            assert not any(stored.load(buys, saved, products, back, batch).values())
    buys, saved, back = frames(tuple([r for part in loads for r in part[i]] for i in range(3)))
    whole = customer.customer_360(people, likes, customer.recent_purchases(buys), customer.saved_items_summary(saved, products), customer.return_history(back))
    got = stored.profiles(people, likes, (buys, saved, products, back))
    assert sorted(map(str, got.collect())) == sorted(map(str, whole.collect())) and got.count() == 13
