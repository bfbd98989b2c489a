"""Known answers on the small shop."""

import pytest
import shop
from pyspark.sql import functions as F

from stockloom.operators import catalog, orders, placement, planning, stock


def rows(df, *columns):
    return [tuple(r[c] for c in columns) for r in df.collect()]


def asked(spark, *ids):
    return spark.createDataFrame([(i,) for i in ids], "product_id string")


def test_recommendations(spark):
    """The mill needs lamps that the quay and the arch hold; the pier still has one, and no store can spare rugs."""
    report = planning.recommendations(shop.weekly(spark), shop.stores(spark), shop.products(spark), shop.inventory(spark))
    assert rows(report, "action_type", "style_id", "source_store_id", "target_store_id", "recommended_units") == [
        ("reorder", "LAMP-A", None, shop.MILL, 4),
        ("transfer", "LAMP-A", shop.QUAY, shop.MILL, 3),
        ("transfer", "LAMP-A", shop.ARCH, shop.MILL, 3),
        ("markdown_adjustment", "CHAIR-A", shop.QUAY, None, None),
        ("markdown_adjustment", "LAMP-A", shop.ARCH, None, None),
    ]


@pytest.mark.parametrize("limit", [1, 2, 3, 4, 5])
def test_recommendations_limit_is_a_prefix(spark, limit):
    args = (shop.weekly(spark), shop.stores(spark), shop.products(spark), shop.inventory(spark))
    assert planning.recommendations(*args, limit=limit).collect() == planning.recommendations(*args).collect()[:limit]


def test_average_performance(spark):
    averages = planning.avg_performance(shop.weekly(spark), shop.stores(spark), shop.products(spark))
    got = {(r.store_id, r.style_id): (r.avg_sell_through, r.avg_wos) for r in averages.collect()}
    assert got == {
        (shop.MILL, "LAMP-A"): (80.0, 0.7), (shop.QUAY, "LAMP-A"): (45.0, 3.0), (shop.ARCH, "LAMP-A"): (25.0, 6.0),
        (shop.PIER, "LAMP-A"): (65.0, 1.5), (shop.PIER, "CHAIR-A"): (66.0, 1.4), (shop.QUAY, "CHAIR-A"): (35.0, 5.0),
        (shop.ARCH, "RUG-A"): (65.0, 1.5), (shop.QUAY, "RUG-A"): (35.2, 9.0),
    }


def test_weekly_performance_filters(spark):
    args = (shop.weekly(spark), shop.stores(spark), shop.products(spark))
    assert planning.weekly_performance(*args).count() == 40
    late = planning.weekly_performance(*args, category="Lamps", store_id=shop.ARCH, week_from="2031-08-18")
    assert late.count() == 3 and {r.style_id for r in late.collect()} == {"LAMP-A"}


def test_imbalance(spark):
    """Lamps are out at the mill, oak chairs at the pier and rugs at the arch; the largest surplus comes first."""
    report = stock.imbalance(shop.inventory(spark), shop.stores(spark), shop.products(spark))
    assert rows(report, "sku_id", "shortage_store_id", "surplus_store_name", "surplus_available_qty") == [
        ("CA1", shop.PIER, "Quay", 12), ("LA1", shop.MILL, "Arch", 9), ("LA1", shop.MILL, "Quay", 6), ("CA1", shop.PIER, "Mill", 3),
        ("RA1", shop.ARCH, "Pier", 2), ("LA1", shop.MILL, "Pier", 1), ("RA1", shop.ARCH, "Mill", 1), ("RA1", shop.ARCH, "Quay", 1),
    ]
    assert stock.imbalance(shop.inventory(spark), shop.stores(spark), shop.products(spark), category="Chairs").count() == 2
    with pytest.raises(ValueError):
        stock.imbalance(shop.inventory(spark), shop.stores(spark), shop.products(spark), limit=101)


def test_imbalance_equals_all_pairs(spark):
    """Every limit gives the prefix of the full pair list, with ties on all sort columns."""
    import random

    rng = random.Random(5)
    cells = [(s, f"SKU-{k}", rng.choice([0, 0, 1, 2, 2])) for s in range(12) for k in range(6)]
    inv = spark.createDataFrame(cells, "store_id int, sku_id string, available_qty int")
    stores = spark.createDataFrame([(s, f"n{s}") for s in range(11)], "store_id int, store_name string")
    prods = spark.createDataFrame(
        [(f"SKU-{k}", f"ST{k % 2}", f"p{k}", "c") for k in range(6)],
        "sku_id string, style_id string, product_name string, category string",
    )
    pairs = sorted(
        (-b[2], f"ST{int(a[1][4:]) % 2}", a[1], a[0], b[0])
        for a in cells for b in cells if a[1] == b[1] and a[2] == 0 and b[2] > 0 and a[0] < 11 and b[0] < 11
    )
    for limit in (1, 7, 40, 100):
        got = rows(stock.imbalance(inv, stores, prods, limit=limit), "surplus_available_qty", "style_id", "sku_id",
                   "shortage_store_id", "surplus_store_id")
        assert [(-g[0], *g[1:]) for g in got] == pairs[:limit]


def test_related_products(spark):
    args = (shop.relationships(spark), shop.products(spark), shop.inventory(spark), asked(spark, "K01"))
    report = stock.related(*args, origin_store=shop.QUAY)
    columns = ("related_product_id", "related_available_qty_in_origin_store", "related_total_available_qty")
    assert rows(report.orderBy("rank"), *columns) == [("K03", 2, 6), ("K04", 12, 15), ("K07", 1, 4)]
    no_origin = stock.related(*args, relation_type="complementary")
    assert rows(no_origin.orderBy("rank"), *columns) == [("K04", None, 15), ("K07", None, 4)]
    with pytest.raises(ValueError):
        stock.related(*args, relation_type="rival")


def test_product_inventory(spark):
    args = (shop.inventory(spark), shop.stores(spark), shop.products(spark), asked(spark, "K04", "K02", "none"))
    assert rows(stock.inventory_for_products(*args), "store_id", "available_qty") == [(shop.QUAY, 12), (shop.MILL, 3), (shop.PIER, 0)]
    assert rows(stock.inventory_for_products(*args, store_id=shop.MILL), "store_id") == [(shop.MILL,)]
    assert rows(catalog.missing_products(shop.products(spark), args[3]), "product_id") == [("none",)]
    assert catalog.products_by_id(shop.products(spark), args[3]).count() == 2


def test_order_report(spark):
    summary = orders.order_summary(shop.orders(spark), shop.stores(spark), shop.order_lines(spark)).orderBy("order_id")
    names = ("fulfillment_store_name", "destination_store_name", "total_amount")
    assert rows(summary, *names) == [("Quay", "Pier", 386.75), ("Arch", None, 0.0)]


def test_token_search(spark):
    queries = spark.createDataFrame(
        [("a", "the amber lamp large", None, None), ("b", "zebra tent", None, None), ("c", "teal", None, None),
         ("d", "an OAK spindle chair!", None, None), ("e", "the an of", None, None)],
        "query_id string, q string, category string, occasion string",
    )
    got = {}
    for r in catalog.token_hits(shop.products(spark), queries).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.product_id, r.matched, r.score))
    assert got["a"][0] == ("K02", 3, 30) and {g[0] for g in got["a"][1:]} == {"K01", "K03", "K07"}
    assert "b" not in got and "e" not in got
    assert got["c"] == [("K06", 1, 10), ("K03", 1, 10), ("K09", 1, 10), ("K08", 1, 10)]
    assert got["d"][:2] == [("K05", 3, 40), ("K04", 3, 40)]  # all three words, and the name as a whole


def test_search_phases(spark):
    queries = spark.createDataFrame(
        [("like", "reed", None, None), ("wild", "d_ne%", None, None), ("all", "%%", None, None), ("case", "GLOW", "Lamps", None),
         ("miss", "glow", "Rugs", None), ("facet", None, "Rugs", None), ("both", None, "Chairs", "Garden"), ("any", None, None, None),
         ("empty", "xyz", None, None), ("tick", "rb2", None, "Home")],
        "query_id string, q string, category string, occasion string",
    )
    got = {}
    for r in catalog.search(shop.products(spark), queries).orderBy("query_id", "rank").collect():
        got.setdefault((r.query_id, r.phase), []).append(r.product_id)
    shelf = ["K10", "K06", "K05", "K04", "K02", "K01", "K03", "K07", "K09", "K08"]  # category, name, color, size
    assert got == {
        ("like", 1): ["K03"], ("wild", 1): ["K07"], ("all", 1): shelf, ("case", 1): ["K02", "K01"], ("miss", 2): ["K02", "K01"],
        ("facet", 1): ["K07", "K09", "K08"], ("both", 1): ["K10", "K06"], ("any", 1): shelf, ("tick", 1): ["K09"],
    }
    strict = catalog.search(shop.products(spark), queries.where("query_id = 'miss'"), strict_filters=True)
    assert strict.count() == 0


def test_single_query_search_agrees_with_the_batch(spark):
    products = shop.products(spark).withColumn("status", F.when(F.col("product_id") == "K09", "inactive").otherwise("active"))
    for q, category, occasion in [("rug", None, None), (None, "Chairs", "Home"), ("_k", "Chairs", None), ("lamp", None, "Office")]:
        queries = spark.createDataFrame([("x", q, category, occasion)], "query_id string, q string, category string, occasion string")
        batch = catalog.substring_hits(products, queries, 2).orderBy("rank")
        single = catalog.substring_search(products, q, category, occasion, 2)
        assert rows(batch, "product_id") == rows(single, "product_id")
    with pytest.raises(ValueError):
        catalog.substring_search(products, "q")


def test_delivery_days(spark):
    cases = [("overnight", 1, 2, 1), ("expedited", 1, 2, 2), ("standard", 1, 2, 3), ("store_pickup", 1, 2, 1),
             ("standard", 2, 2, 1), ("standard", None, 2, 3)]
    df = spark.createDataFrame(cases, "m string, d int, s int, want int")
    days = placement.delivery_days(F.col("m"), F.col("d"), F.col("s"))
    assert df.where(days != F.col("want")).count() == 0
