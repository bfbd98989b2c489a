"""Injected defects of every declared kind are found, and only those."""

import contextlib
import io
import os
import time

from stockloom.operators import constraints, quality


def found(df):
    return {r.rule: r.violations for r in df.collect() if r.violations}


def small(spark, stock, orders, edges):
    return {
        "stores": spark.createDataFrame([(1,), (2,), (2,)], "store_id int"),
        "products": spark.createDataFrame(
            [("p1", "k1", "active"), ("p2", "k2", "gone"), ("p3", None, None), ("p4", None, None)],
            "product_id string, sku_id string, status string"),
        "inventory": spark.createDataFrame(
            stock, "store_id int, sku_id string, on_hand_qty int, reserved_qty int, available_qty int, in_transit_qty int"),
        "orders": spark.createDataFrame(
            orders, "order_id string, fulfillment_store_id int, destination_store_id int, order_status string, "
            "shipping_method string, estimated_delivery_days int"),
        "source_orders": spark.createDataFrame(
            [(1, 1, 1, "fulfilled"), (2, 1, 1, "shipped")], "order_id bigint, customer_id bigint, store_id int, order_status string"),
        "relationships": spark.createDataFrame(
            edges, "source_product_id string, related_product_id string, relationship_type string"),
    }


def test_injected_defects(spark):
    stock = [(1, "k1", 5, 2, 3, 0), (1, "k1", 5, 2, 4, 0), (3, "k9", 1, 2, -1, None)]
    orders = [("o1", 1, None, "shipped", "standard", 1), ("o1", 7, 8, "fulfilled", "boat", -1)]
    edges = [("p1", "p2", "alternative"), ("p1", "p1", "cross_sell"), ("p1", "zz", None)]
    tables = small(spark, stock, orders, edges)
    assert found(constraints.audit_keys(tables)) == {
        "stores(store_id)": 1, "inventory(store_id, sku_id)": 1, "orders(order_id)": 1,
    }
    assert found(constraints.audit_references(tables)) == {
        "inventory.store_id -> stores.store_id": 1, "inventory.sku_id -> products.sku_id": 1,
        "relationships.related_product_id -> products.product_id": 1,
        "orders.fulfillment_store_id -> stores.store_id": 1, "orders.destination_store_id -> stores.store_id": 1,
    }
    assert found(constraints.audit_rows(tables)) == {
        "products.status in codes": 1, "orders.order_status in codes": 1, "orders.shipping_method in codes": 1,
        "source_orders.order_status in codes": 1, "relationships.relationship_type in codes": 1,
        "inventory.available_qty in bounds": 1, "orders.estimated_delivery_days in bounds": 1,
        "inventory stock adds up": 1, "relationships no self edge": 1,
    }


def test_clean_and_empty_tables(spark):
    tables = small(spark, [], [], [])
    only = {n: tables[n] for n in ("inventory", "orders", "relationships")}
    for audit in (constraints.audit_keys, constraints.audit_rows):
        rows = audit(only).collect()
        assert rows and all(r.violations == 0 for r in rows)
    only["products"] = tables["products"]
    rows = constraints.audit_references(only).collect()
    assert len(rows) == 3 and all(r.violations == 0 for r in rows)


def test_a_load_finds_the_same_without_another_scan(spark, tmp_path):
    stock = [(1, "k1", 5, 2, 3, 0), (1, "k1", 5, 2, 4, 0), (3, "k9", 1, 2, -1, None)]
    orders = [("o1", 1, None, "shipped", "standard", 1), ("o1", 7, 8, "fulfilled", "boat", -1)]
    tables = small(spark, stock, orders, [("p1", "p1", "cross_sell"), ("p1", "zz", None)])
    scans = spark.sparkContext.accumulator(0)

    def counted(rows):
        for r in rows:
            scans.add(len(r))
            yield r

    tables["inventory"] = tables["inventory"].mapInPandas(counted, tables["inventory"].schema)
    got = {r.rule: r.violations for r in constraints.load_audited(tables, str(tmp_path)).collect()}
    assert scans.value == 3
    assert got.pop("inventory rows") == 3 and got.pop("orders rows") == 2 and got.pop("stores rows") == 3
    rows = {r.rule: r.violations for r in constraints.audit_rows(tables).collect()}
    assert {k: v for k, v in got.items() if not k.endswith(" rows")} == rows and sum(rows.values()) > 4
    assert spark.read.parquet(f"{tmp_path}/orders").count() == 2


def test_repeated_keys_are_sorted_not_held(spark):
    """No task keeps a table of all keys, nulls are a key of duplicates only, and a key counts once however often it comes."""
    rows = spark.createDataFrame([(1, "a"), (1, "a"), (1, "a"), (1, None), (1, None), (2, None), (None, None), (None, None)], "store_id int, sku_id string")
    audits = {"audit": constraints.audit_keys({"inventory": rows}), "duplicates": quality.duplicates({"x": (rows, ["store_id", "sku_id"])})}
    counts = {}
    for name, df in audits.items():
        with contextlib.redirect_stdout(io.StringIO()) as plan:
            df.explain()
        assert "keys=[store_id" not in plan.getvalue()
        counts[name] = df.first()[1]
    assert counts == {"audit": 1, "duplicates": 3}


def test_tables_are_loaded_side_by_side(spark, tmp_path):
    """Each of two tables waits until the other is being written too."""
    def waiting(own, other):
        def wait(batches):
            open(f"{tmp_path}/{own}", "w").close()
            for _ in range(200):
                if os.path.exists(f"{tmp_path}/{other}"):
                    break
                time.sleep(0.1)
            for b in batches:
                yield b.assign(store_id=b["store_id"] if os.path.exists(f"{tmp_path}/{other}") else -1)

        return spark.createDataFrame([(1,)], "store_id int").coalesce(1).mapInPandas(wait, "store_id int")

    tables = {"stores": waiting("a", "b"), "core_stores": waiting("b", "a")}
    rows = constraints.load_audited(tables, f"{tmp_path}/out").collect()
    assert {r.rule: r.violations for r in rows} == {"stores rows": 1, "core_stores rows": 1}
    assert [spark.read.parquet(f"{tmp_path}/out/{t}").first()[0] for t in tables] == [1, 1]
