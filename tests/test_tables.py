"""Files, maintenance, audits, derived columns, profiles and plan shapes."""

from datetime import date, datetime
from decimal import Decimal

import pytest
import shop
from pyspark.sql import functions as F

from stockloom import schemas
from stockloom.functions import derive, money, text
from stockloom.operators import customer, maintain, planning, quality, stock
from stockloom.plans.ranking import ordered_positions, running_totals
from stockloom.session import scratch_dir
from stockloom.sources import files


def test_csv_layout(spark, tmp_path):
    path = tmp_path / "profiles.csv"
    path.write_bytes(
        b"customer_id,name,tier,preferred_sizes,preferred_colors,favorite_categories,recent_purchases\r\n"
        b'1,"Ann ""A"", B",Gold,"{S,M,10}",{},"{Denim,Tees}","[{""sku"": ""K1"", ""qty"": 2}, {""sku"": ""K2"", ""qty"": 1}]"\r\n'
        b"2,,Silver,{L},{Red},{Tees},[]\r\n"
    )
    one, two = files.read_csv(spark, str(path), schemas.CUSTOMER_PROFILES).orderBy("customer_id").collect()
    assert (one.name, one.preferred_sizes, one.preferred_colors) == ('Ann "A", B', ["S", "M", "10"], [])
    assert [(p.sku, p.qty) for p in one.recent_purchases] == [("K1", 2), ("K2", 1)]
    assert two.name is None and two.recent_purchases == []


def test_csv_booleans_and_chunks(spark, tmp_path):
    for part, rows in ((1, b"2025-11-28,11,Friday,False,True,False\r\n"), (2, b"2025-12-01,12,Monday,False,False,True\r\n")):
        head = b"calendar_date,month,day_of_week,is_weekend,is_black_friday,is_cyber_monday\r\n"
        (tmp_path / f"calendar_part_{part:04d}.csv").write_bytes(head + rows)
    got = files.read_csv(spark, f"{tmp_path}/calendar_part_*.csv", schemas.CALENDAR).orderBy("calendar_date").collect()
    assert [(r.calendar_date, r.is_black_friday, r.is_cyber_monday) for r in got] == [
        (date(2025, 11, 28), True, False), (date(2025, 12, 1), False, True)
    ]


def test_sinks(spark):
    base = scratch_dir(spark, "sinks")
    df = spark.range(100).withColumn("ts", F.timestamp_seconds(F.col("id") * 3600))
    files.write_chunked(df, f"{base}/chunks", 10)
    counted = files.manifest({"t": spark.read.parquet(f"{base}/chunks")}).first()
    assert (counted.row_count, counted.file_count >= 10) == (100, True)
    listed = files.file_counts({"t": spark.read.parquet(f"{base}/chunks")})
    assert listed.agg(F.max("row_count"), F.sum("row_count")).first() == (10, 100)
    files.write_by_date(df, f"{base}/dated", "ts")
    day = spark.read.parquet(f"{base}/dated").where(F.col("event_date") == date(1970, 1, 2))
    assert day.count() == 24
    files.overwrite(df.limit(3), f"{base}/chunks")
    assert spark.read.parquet(f"{base}/chunks").count() == 3


def test_upsert(spark):
    base = spark.createDataFrame([(1, "a", 1), (2, "b", 2)], "id int, v string, n int")
    news = spark.createDataFrame([(2, None, 9), (3, "c", 3)], "id int, v string, n int")
    once = maintain.upsert(base, news, ["id"])
    assert sorted(map(tuple, once.collect())) == [(1, "a", 1), (2, None, 9), (3, "c", 3)]
    assert sorted(map(tuple, maintain.upsert(once, news, ["id"]).collect())) == sorted(map(tuple, once.collect()))
    part = maintain.upsert(base, news, ["id"], columns=["n"])
    assert sorted(map(tuple, part.collect())) == [(1, "a", 1), (2, "b", 9), (3, "c", 3)]
    with pytest.raises(Exception, match="duplicate key in update"):
        maintain.upsert(base, news.union(news), ["id"]).collect()


def test_updates(spark):
    people = spark.createDataFrame(
        [(1, None, "LEAH", "Grubb", 5), (2, "x@y", "Lea", "Grubb", 6)],
        "customer_id bigint, email string, first_name string, last_name string, preferred_store_id int",
    )
    assert [r.email for r in maintain.email_backfill(people).orderBy("customer_id").collect()] == ["customer1@example.com", "x@y"]
    moved = maintain.assign_preferred_store(people, "leah", "grubb", 121).orderBy("customer_id").collect()
    assert [r.preferred_store_id for r in moved] == [121, 6]
    shops = spark.createDataFrame([(56, "?", "West"), (121, "?", "Nowhere"), (1, "?", "Midwest")], "store_id int, city string, region string")
    placed = {r.store_id: r for r in maintain.store_locations(shops).collect()}
    assert (placed[56].city, placed[56].region, placed[56].street_address) == ("Boston", "Northeast", "156 Boylston Street")
    assert (placed[121].city, placed[121].region, placed[121].postal_code) == ("San Diego", "Nowhere", "14477")
    assert (placed[1].store_name, placed[1].state_code) == ("Columbus - High Street Location", "OH")


def test_audits_find_injected_rows(spark):
    parent = spark.createDataFrame([(1,), (2,)], "id int")
    child = spark.createDataFrame([(1,), (3,), (3,), (None,)], "fk int")
    got = quality.orphans({"a": (child, "fk", parent, "id"), "b": (child, "fk", parent, "id"), "none": (child.limit(0), "fk", parent, "id")},
                          optional=("b",))
    assert {r.check_name: r.orphan_rows for r in got.collect()} == {"a": 3, "b": 2, "none": None}
    assert quality.duplicates({"k": (child, ["fk"])}).first().duplicate_keys == 1
    stocked = spark.createDataFrame([(5, 1, 4), (5, 1, 3), (-1, 0, -1)], "on_hand_qty int, reserved_qty int, available_qty int")
    assert quality.identity_check(stocked, "i", {"s": quality.stock_identity()}).first().violations == 1
    assert quality.range_check(stocked, "i", {"on_hand_qty": (0, None)}).first().violations == 1
    codes = spark.createDataFrame([("Gold",), ("Tin",), (None,)], "tier string")
    assert quality.domain_check(codes, "c", ["tier"]).first().violations == 1
    times = spark.createDataFrame([(datetime(2025, 9, 30, 23),), (datetime(2025, 12, 31, 23),)], "ts timestamp")
    assert quality.date_range(times, "ts", date(2025, 10, 1), date(2025, 12, 31)).first().out_of_range_rows == 1
    assert quality.date_range(times.limit(0), "ts", date(2025, 10, 1), date(2025, 12, 31)).first().out_of_range_rows is None


def test_amount_audits(spark):
    head = [(1, Decimal("20.00"), Decimal("1.00"), Decimal("19.00")), (2, Decimal("20.00"), Decimal("1.00"), Decimal("18.00")),
            (3, Decimal("0.00"), Decimal("0.00"), Decimal("0.00"))]
    tx = spark.createDataFrame(head, "transaction_id bigint, gross_amount decimal(12,2), discount_amount decimal(12,2), net_amount decimal(12,2)")
    line = [(t, 2, Decimal("10.00"), Decimal("1.00"), Decimal("19.00")) for t in (1, 2)]
    items = spark.createDataFrame(line, "transaction_id bigint, quantity int, unit_price decimal(10,2), discount_amount decimal(10,2), line_total decimal(10,2)")
    assert [r.transaction_id for r in quality.amount_rollup(tx, items).collect()] == [2]
    assert quality.line_totals(items.withColumn("line_total", F.when(F.col("transaction_id") == 1, F.col("line_total")).otherwise(F.lit(1)))).count() == 1
    sizes = {"transactions": 100, "transaction_items": 190, "returns": 40, "customers": 5, "customer_preferences": 5}
    tables = {n: spark.range(c) for n, c in sizes.items()}
    assert {r.table_name: r.within_band for r in quality.expected_volume(tables).collect()} == {
        "transaction_items": True, "returns": False, "customer_preferences": True
    }


def test_field_coverage_counts_empty_arrays(spark):
    df = spark.createDataFrame([("", []), ("a", ["x"]), (None, None)], "email string, preferred_sizes array<string>")
    got = quality.field_coverage(df, {"email": "text", "preferred_sizes": "array"}).first()
    assert tuple(got) == (3, 2, 2)


def test_rounding(spark):
    df = spark.createDataFrame([(1_000_000, 2_000_001), (201, 2), (-3, 2)], "n bigint, d bigint")
    got = [r[0] for r in df.select(money.round_half_up(F.col("n"), F.col("d"))).collect()]
    assert got == [0, 101, -2]


def test_calendar_and_weights(spark):
    days = derive.calendar_dim(derive.season_bounds(spark))
    assert days.count() == 92 and days.where("is_weekend").count() == 26
    friday = days.where("is_black_friday").first()
    assert (friday.calendar_date, friday.day_of_week, friday.month) == (date(2025, 11, 28), "Friday", 11)
    weights = days.select("calendar_date", derive.demand_weight(F.col("calendar_date")).alias("w"))
    got = {r.calendar_date: round(r.w, 6) for r in weights.collect()}
    assert got[date(2025, 11, 28)] == round(1.2 * 6 * 1.35, 6) and got[date(2025, 12, 1)] == round(1.65 * 4, 6)
    assert got[date(2025, 10, 1)] == 1.0
    risk = spark.createDataFrame([("Footwear", "online"), ("Toys", "online")], "c string, ch string")
    assert [r[0] for r in risk.select(derive.return_risk(0.5, F.col("c"), F.col("ch"))).collect()] == [0.65, None]


def test_store_directory(spark):
    got = {r.store_id: r for r in derive.store_directory(spark.range(1, 1002).select(F.col("id").cast("int").alias("store_id"))).collect()}
    assert got[1].store_name == "Store-001 (Northeast) - Boston, Boylston Street"
    assert got[56].store_name == "Store-056 (Northeast) - Boston, Boylston Street"
    assert got[1001].store_name.startswith("Store-1001 (Northeast)") and len(got) == 1001


def test_query_tokens(spark):
    df = spark.createDataFrame([("Looking for EXTRA-Large red, RED shoes",), ("the",), ("",)], "q string")
    assert [r[0] for r in df.select(text.query_tokens(F.col("q"))).collect()] == [["l", "red", "shoes"], [], []]


def _profiles(spark, saved_count, page_size):
    people = spark.createDataFrame(
        [(1, "L1", "e", "a", "b", "Gold", 1, "n", "VIP"), (2, "L2", "e", "a", "b", "Gold", 1, "n", "VIP")],
        "customer_id bigint, loyalty_id string, email string, first_name string, last_name string, tier string, "
        "preferred_store_id int, stylist_notes string, lifetime_value_band string",
    )
    prefs = spark.createDataFrame([(1, ["S"], ["Red"], ["B"], ["Work"])], "customer_id bigint, preferred_sizes array<string>, "
                                  "preferred_colors array<string>, preferred_brands array<string>, shopping_occasions array<string>")
    tx = spark.createDataFrame([(1, i, datetime(2025, 10, 1 + i // 2), Decimal(i)) for i in range(8)],
                               "customer_id bigint, transaction_id bigint, transaction_ts timestamp, net_amount decimal(12,2)")
    saved = spark.createDataFrame([(i, 1, 7, datetime(2025, 10, 1)) for i in range(saved_count)] + [(1000, 2, 7, datetime(2025, 10, 2))],
                                  "saved_item_id bigint, customer_id bigint, product_id bigint, saved_at timestamp")
    prods = spark.createDataFrame([(7, "Hat", "Accessories", "Red", "M")], "product_id bigint, product_name string, category string, color string, size_code string")
    returns = spark.createDataFrame([(1, Decimal("1.00"), "wrong_item"), (1, Decimal("1.01"), "damaged_in_shipping")],
                                    "customer_id bigint, refund_amount decimal(10,2), reason_code string")
    return customer.customer_360(
        people, prefs, customer.recent_purchases(tx), customer.saved_items_summary(saved, prods, page_size), customer.return_history(returns)
    )


def test_customer_360(spark):
    one, two = _profiles(spark, 2, 100).orderBy("customer_id").collect()
    assert [p.transaction_id for p in one.recent_purchases] == [7, 6, 5, 4, 3]
    assert tuple(one.return_history_summary) == (2, Decimal("1.01"), Decimal("2.01"), "damaged_in_shipping")
    assert len(one.saved_items) == 2 and one.saved_items[0].color == "Red"
    assert two.recent_purchases == [] and two.preferred_sizes is None and len(two.saved_items) == 1
    assert tuple(two.return_history_summary) == (0, Decimal("0.00"), Decimal("0.00"), None)


def test_long_saved_lists_are_paged_whole(spark):
    profiles = _profiles(spark, 25, 10)
    rows = profiles.where("customer_id = 1").orderBy("saved_items_page").collect()
    assert [len(r.saved_items) for r in rows] == [10, 10, 5]
    assert profiles.select("customer_id", "saved_items_page").distinct().count() == profiles.count() == 4
    assert quality.field_coverage(profiles, {"email": "text"}).first().total_customers == 2


def test_hostile_text_survives_csv(spark, tmp_path):
    schema = "id bigint, t string, a array<string>, n int"
    rows = [
        (1, 'two\nlines, "quoted"', ["a,b", "c", "", None, "NULL", 'say "x"', "back\\slash", "{}"], 5), (2, "", [], None),
        (3, None, None, 0), (4, "  spaced  ", [" s "], -1), (5, '"', ["multi\nline"], None),
    ]
    source = spark.createDataFrame(rows, schema)
    files.write_csv(source.coalesce(1), str(tmp_path / "t"))
    back = files.read_csv(spark, str(tmp_path / "t"), schema, multi_line=True)
    assert sorted(map(tuple, back.collect())) == sorted(rows)


@pytest.mark.parametrize("line", ["x1,a,{b},2", "1,a,{b},two", "1,a,b,2", "1,a"])
def test_bad_rows_stop_the_load(spark, tmp_path, line):
    (tmp_path / "t.csv").write_text(f"id,t,a,n\n1,ok,{{x}},3\n{line}\n")
    with pytest.raises(Exception):
        files.read_csv(spark, str(tmp_path / "t.csv"), "id bigint, t string, a array<string>, n int").collect()


def test_positions_and_running_totals(spark):
    df = spark.range(1000).select((F.col("id") % 3).alias("k"), "id", (F.col("id") % 7).alias("v"))
    ranked = ordered_positions(df, ["k"], [F.col("id").desc()], "pos")
    assert ranked.where(F.col("pos") != F.floor((F.lit(999) - F.col("id")) / 3) + 1 + F.when((F.col("id") % 3) == 0, 0).otherwise(0)).where("k = 0").count() == 0
    totals = running_totals(df, ["k"], "id", {"t": F.col("v")}, 10)
    want, run = {}, {}
    for i in range(1000):
        want[i] = run.get(i % 3, 0)
        run[i % 3] = want[i] + i % 7
    assert {r.id: r.t for r in totals.collect()} == want


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_plan_shapes(spark):
    tx = spark.range(10).select(F.col("id").alias("transaction_id"), F.col("id").alias("customer_id"),
                                F.timestamp_seconds("id").alias("transaction_ts"), F.col("id").cast("decimal(12,2)").alias("net_amount"))
    assert "WindowGroupLimit" in _plan(customer.recent_purchases(tx))
    inv, stores, prods, weeks = shop.inventory(spark), shop.stores(spark), shop.products(spark), shop.weekly(spark)
    for df in (stock.imbalance(inv, stores, prods), planning.recommendations(weeks, stores, prods, inv),
               planning.transfers(weeks, stores, prods, inv)):
        assert "NestedLoop" not in _plan(df) and "Cartesian" not in _plan(df)


def test_no_dependence_on_partition_count(spark):
    args = (shop.weekly(spark), shop.stores(spark), shop.products(spark), shop.inventory(spark))
    before = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        results = []
        for n in ("1", "7"):
            spark.conf.set("spark.sql.shuffle.partitions", n)
            results.append(planning.recommendations(*args).collect())
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert results[0] == results[1]
