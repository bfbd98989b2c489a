"""A furniture shop made up for the tests: four stores, ten products, five weeks.

One lamp sells out at the mill while two other stores hold it; every other style misses one
condition of each report by a step.
"""

from datetime import date, datetime, timedelta
from decimal import Decimal

from stockloom import schemas

NOON = datetime(2031, 9, 15, 12, 0)
MILL, QUAY, ARCH, PIER = 7, 8, 11, 20

STORES = [
    (MILL, "Mill", "Leeds", "YK", "North", "Small"), (QUAY, "Quay", "Hull", "YK", "North", "Large"),
    (ARCH, "Arch", "Bath", "SO", "South", "Small"), (PIER, "Pier", "Deal", "SE", "South", "Large"),
]
# product, style, sku, name, category, subcategory, color, size, price, occasion
PRODUCTS = [
    ("K01", "LAMP-A", "LA1", "Glow Desk Lamp", "Lamps", "Desk", "Amber", "S", "45.50", "Office"),
    ("K02", "LAMP-A", "LA2", "Glow Desk Lamp", "Lamps", "Desk", "Amber", "L", "52.25", "Office"),
    ("K03", "LAMP-B", "LB1", "Tall Reed Lamp", "Lamps", "Floor", "Teal", "L", "88.00", "Home"),
    ("K04", "CHAIR-A", "CA1", "Oak Spindle Chair", "Chairs", "Dining", "Brown", "M", "210.75", "Home"),
    ("K05", "CHAIR-A", "CA2", "Oak Spindle Chair", "Chairs", "Dining", "Black", "M", "210.75", "Home"),
    ("K06", "CHAIR-B", "CB1", "Low Canvas Chair", "Chairs", "Lounge", "Teal", "M", "130.00", "Garden"),
    ("K07", "RUG-A", "RA1", "Dune Rug", "Rugs", "Flat", "Amber", "L", "300.00", "Home"),
    ("K08", "RUG-B", "RB1", "Tide Rug", "Rugs", "Tufted", "Teal", "S", "64.10", "Home"),
    ("K09", "RUG-B", "RB2", "Tide Rug", "Rugs", "Tufted", "Teal", "L", "99.90", "Home"),
    ("K10", "STOOL", "ST1", "Bar Stool", "Chairs", "Bar", "Black", "M", "75.00", "Garden"),
]
UNITS = {  # sku -> units on the shelf by store
    "LA1": {MILL: 0, QUAY: 6, ARCH: 9, PIER: 1}, "LB1": {QUAY: 2, ARCH: 4}, "CA1": {MILL: 3, QUAY: 12, PIER: 0},
    "CA2": {PIER: 5}, "CB1": {ARCH: 7}, "RA1": {MILL: 1, QUAY: 1, ARCH: 0, PIER: 2}, "RB1": {QUAY: 3}, "ST1": {MILL: 4, PIER: 4},
}
# (store, style) -> sell-through and weeks of supply, week by week
WEEKS = {
    (MILL, "LAMP-A"): ([82, 78, 90, 70, 80], [1, 0.5, 0.6, 0.9, 0.5]),
    (QUAY, "LAMP-A"): ([40, 50, 45, 42, 48], [3, 3, 3.5, 2.5, 3]),
    (ARCH, "LAMP-A"): ([20, 30, 25, 22, 28], [6, 7, 5, 6.5, 5.5]),
    (PIER, "LAMP-A"): ([65, 65, 65, 65, 65], [1.5, 1.5, 1.5, 1.5, 1.5]),
    (PIER, "CHAIR-A"): ([66, 68, 64, 67, 65], [1.5, 1.2, 1.5, 1.3, 1.5]),
    (QUAY, "CHAIR-A"): ([35, 35, 35, 35, 35], [5, 5, 5, 5, 5]),
    (ARCH, "RUG-A"): ([65, 65, 65, 65, 65], [1.5, 1.5, 1.5, 1.5, 1.5]),
    (QUAY, "RUG-A"): ([36, 35, 35, 35, 35], [9, 9, 9, 9, 9]),
}
EDGES = [
    ("K01", "K03", "alternative", "another lamp"), ("K01", "K07", "complementary", "same amber"),
    ("K01", "K04", "complementary", "desk seat"), ("K04", "K06", "alternative", "another chair"),
]


def products(spark):
    rows = [
        (pid, style, sku, name, category, sub, "Ash & Elm", color, size, "All", Decimal(price), Decimal("20.00"), "about", "picture",
         "shape", occasion, "Wood", "active")
        for pid, style, sku, name, category, sub, color, size, price, occasion in PRODUCTS
    ]
    return spark.createDataFrame(rows, schemas.PRODUCTS)


def stores(spark):
    return spark.createDataFrame(STORES, schemas.STORES)


def inventory(spark):
    rows = [
        (store, sku, n + 2, 2, n, 1, NOON - timedelta(hours=store)) for sku, held in UNITS.items() for store, n in held.items()
    ]
    return spark.createDataFrame(rows, schemas.INVENTORY)


def relationships(spark):
    return spark.createDataFrame(EDGES, schemas.RELATIONSHIPS)


def weekly(spark):
    rows = [
        (date(2031, 8, 4) + timedelta(weeks=week), store, style, 6, Decimal("90.00"), Decimal("41.00"), Decimal("3.00"), Decimal(str(sold)),
         Decimal(str(supply)))
        for (store, style), figures in WEEKS.items() for week, (sold, supply) in enumerate(zip(*figures))
    ]
    return spark.createDataFrame(rows, schemas.WEEKLY_PERFORMANCE)


def orders(spark):
    rows = [
        ("A-1", "77", NOON, "placed", QUAY, PIER, None, "expedited", 2, date(2031, 9, 17)),
        ("A-2", "78", NOON, "processing", ARCH, None, "York", "standard", 3, date(2031, 9, 18)),
    ]
    return spark.createDataFrame(rows, schemas.ORDERS)


def order_lines(spark):
    rows = [("A-1", "LB1", 2, Decimal("88.00")), ("A-1", "CA1", 1, Decimal("210.75"))]
    return spark.createDataFrame(rows, schemas.ORDER_LINES)
