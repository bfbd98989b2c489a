"""Weekly performance and planning recommendations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stockloom.functions.money import cents, hundredths_mean
from stockloom.operators.catalog import apply_filters
from stockloom.operators.stock import style_inventory
from stockloom.plans.topk import bounded, first_rows, top_k

# Thresholds in percent sell-through, weeks of supply and units.
TRANSFER_SELL_THROUGH, TRANSFER_WEEKS, TRANSFER_MIN_UNITS, TRANSFER_UNITS = 65, 1.5, 3, 3
MARKDOWN_SELL_THROUGH, MARKDOWN_WEEKS = 35, 5
REORDER_SELL_THROUGH, REORDER_WEEKS, REORDER_UNITS = 70, 1.5, 4

# Wording of the rationale; {} stands for a store name.
TRANSFER_NOTE = "Demand is high in {} with low supply; move inventory from {}."
MARKDOWN_NOTE = "Low sell-through and high weeks of supply suggest deeper markdown testing in {}."
REORDER_NOTE = "Strong demand and low weeks of supply support a reorder for {}."

_REPORT_COLUMNS = (
    "action_type", "priority", "style_id", "category", "source_store_id", "source_store_name",
    "target_store_id", "target_store_name", "recommended_units", "rationale",
)


def style_categories(products: DataFrame) -> DataFrame:
    """Every category a style is sold under, once."""
    return products.select("style_id", "category").distinct()


def weekly_performance(
    performance: DataFrame, stores: DataFrame, products: DataFrame, category: str | None = None,
    style_id: str | None = None, store_id: int | None = None, week_from=None, week_to=None, ordered: bool = True,
) -> DataFrame:
    """Weekly rows with store name and category, newest week first.

    ``ordered=False`` spares the global sort of a result that goes to a table.
    """
    kept = apply_filters(
        performance, style_id=style_id, store_id=store_id,
        at_least={"week_start_date": week_from}, at_most={"week_start_date": week_to},
    )
    categories = apply_filters(style_categories(products), category=category)
    money = ("net_sales", "gross_margin", "markdown_rate", "sell_through_pct", "weeks_of_supply")
    rows = kept.join(stores.select("store_id", "store_name"), "store_id").join(categories, "style_id")
    report = rows.select(
        "week_start_date", "store_id", "store_name", "category", "style_id", "units_sold",
        *[F.col(c).cast("double").alias(c) for c in money],
    )
    order = [F.col("week_start_date").desc_nulls_last(), F.col("store_id"), F.col("style_id"), F.col("category")]
    return report.orderBy(*order) if ordered else report


def _means(performance: DataFrame) -> DataFrame:
    """Mean sell-through and weeks of supply per store and style."""
    sums = performance.groupBy("store_id", "style_id").agg(
        F.sum(cents(F.col("sell_through_pct"))).alias("st"), F.count("sell_through_pct").alias("st_n"),
        F.sum(cents(F.col("weeks_of_supply"))).alias("wos"), F.count("weeks_of_supply").alias("wos_n"),
    )
    return sums.select(
        "store_id", "style_id", hundredths_mean(F.col("st"), F.col("st_n")).alias("avg_sell_through"),
        hundredths_mean(F.col("wos"), F.col("wos_n")).alias("avg_wos"),
    )


def _labelled(rows: DataFrame, stores: DataFrame, products: DataFrame, category: str | None) -> DataFrame:
    """Rows with store name and category; rows of unknown stores or styles drop out."""
    categories = apply_filters(style_categories(products), category=category)
    return rows.join(stores.select("store_id", "store_name"), "store_id").join(categories, "style_id")


def avg_performance(
    performance: DataFrame, stores: DataFrame, products: DataFrame, category: str | None = None
) -> DataFrame:
    """Mean sell-through and weeks of supply per store, style and category.

    Weeks are summed before the joins: store and category only label a (store, style) pair,
    so they need not be carried through the large aggregation.
    """
    return _labelled(_means(performance), stores, products, category).select(
        "store_id", "store_name", "style_id", "category", "avg_sell_through", "avg_wos"
    )


def _text(value: str | None = None) -> Column:
    return F.lit(value).cast("string")


def _action(action: str, priority: str, rank: int, source, target, units, rationale: Column) -> Column:
    none_id, none_name = F.lit(None).cast("int"), _text()
    return F.struct(
        _text(action).alias("action_type"), _text(priority).alias("priority"), F.lit(rank).alias("priority_sort"),
        (source["store_id"] if source is not None else none_id).alias("source_store_id"),
        (source["store_name"] if source is not None else none_name).alias("source_store_name"),
        (target["store_id"] if target is not None else none_id).alias("target_store_id"),
        (target["store_name"] if target is not None else none_name).alias("target_store_name"),
        (units if units is not None else none_id).cast("int").alias("recommended_units"),
        (target if target is not None else source)["category"].alias("category"),
        rationale.alias("rationale"),
    )


def _note(wording: str, *names: Column) -> Column:
    texts = wording.split("{}")
    parts = [F.lit(texts[0])]
    for name, after in zip(names, texts[1:]):
        parts += [name, F.lit(after)]
    return F.concat(*parts)


def _markdown(row: Column) -> Column:
    return _action("markdown_adjustment", "medium", 1, row, None, None, _note(MARKDOWN_NOTE, row["store_name"]))


def _reorder(row: Column) -> Column:
    note = _note(REORDER_NOTE, row["store_name"])
    return _action("reorder", "high", 0, None, row, F.lit(REORDER_UNITS), note)


def _transfer(source: Column, target: Column) -> Column:
    units = F.least(source["stock"], F.lit(TRANSFER_UNITS))
    note = _note(TRANSFER_NOTE, target["store_name"], source["store_name"])
    return _action("transfer", "high", 0, source, target, units, note)


def _role_rows(performance, stores, products, inventory, category, roles: dict[str, Column]) -> DataFrame:
    """One row per store, style, category and role played, with the units the store has.

    Performance and stock are both grouped by (store, style), so they join without another
    shuffle. Pairs that play no role are dropped before names and categories are attached.
    """
    stock = style_inventory(inventory, products)
    rows = _means(performance).join(stock, ["store_id", "style_id"], "left").withColumn(
        "stock", F.coalesce("style_available_qty", F.lit(0))
    )
    listed = F.filter(
        F.array(*[F.when(F.coalesce(cond, F.lit(False)), F.lit(role)) for role, cond in roles.items()]),
        lambda r: r.isNotNull(),
    )
    playing = rows.select("store_id", "style_id", "stock", listed.alias("roles")).where(F.size("roles") > 0)
    return _labelled(playing, stores, products, category).withColumn("role", F.explode("roles")).drop("roles")


def _is_reorder() -> Column:
    return (F.col("avg_sell_through") >= REORDER_SELL_THROUGH) & (F.col("avg_wos") <= REORDER_WEEKS)


def _is_markdown() -> Column:
    return (F.col("avg_sell_through") <= MARKDOWN_SELL_THROUGH) & (F.col("avg_wos") >= MARKDOWN_WEEKS)


def _is_needy() -> Column:
    return (
        (F.col("avg_sell_through") >= TRANSFER_SELL_THROUGH) & (F.col("avg_wos") <= TRANSFER_WEEKS)
        & (F.col("stock") == 0)
    )


def _is_supplier() -> Column:
    return F.col("stock") >= TRANSFER_MIN_UNITS


def _report_order() -> list[Column]:
    return [
        F.col("priority_sort"), F.col("action_type"), F.col("style_id"),
        F.col("source_store_id").asc_nulls_last(), F.col("target_store_id").asc_nulls_last(), F.col("category"),
    ]


def _candidates(played: DataFrame, roles: dict[str, Column], limit: int) -> DataFrame:
    """Per style, the first ``limit`` stores of each role as sorted arrays of structs.

    Roles are cut to ``limit`` stores per style before they are gathered, so the arrays stay
    small however many stores carry a style.
    """
    kept = top_k(played, ["style_id", "role"], [F.col("store_id"), F.col("category")], limit)
    store = F.struct("store_id", "category", "store_name", "stock")
    return kept.groupBy("style_id").agg(
        *[F.sort_array(F.collect_list(F.when(F.col("role") == r, store))).alias(r) for r in roles]
    )


def _transfers(limit: int) -> Column:
    """The first transfers of a style, sources outermost.

    Each source pairs with every needy store, so ``limit`` pairs are reached within
    ``ceil(limit / needy stores)`` sources; later sources cannot contribute.
    """
    needed = F.ceil(F.lit(limit) / F.size("needy")).cast("int")
    sources = F.when(
        F.size("needy") > 0, F.slice("supplier", F.lit(1), F.when(F.size("needy") > 0, needed).otherwise(1))
    )
    pairs = F.transform(sources, lambda s: F.transform(F.col("needy"), lambda t: _transfer(s, t)))
    return F.coalesce(F.flatten(pairs), F.array().cast(_ACTION_ARRAY))


_ACTION_ARRAY = (
    "array<struct<action_type:string,priority:string,priority_sort:int,source_store_id:int,"
    "source_store_name:string,target_store_id:int,target_store_name:string,recommended_units:int,"
    "category:string,rationale:string>>"
)


def _report(grouped: DataFrame, actions: Column, limit: int) -> DataFrame:
    rows = grouped.select("style_id", F.explode(actions).alias("action")).select("style_id", "action.*")
    return first_rows(rows, _report_order(), limit).select(*_REPORT_COLUMNS)


def transfers(performance, stores, products, inventory, category: str | None = None, limit: int = 25) -> DataFrame:
    """Moves from stores with stock of a style to stores that sell it well and have none."""
    bounded("limit", limit, 100)
    roles = {"needy": _is_needy(), "supplier": _is_supplier()}
    rows = _role_rows(performance, stores, products, inventory, category, roles)
    grouped = _candidates(rows, roles, limit)
    return _report(grouped, _transfers(limit), limit)


def _whole_list(rows: DataFrame, condition: Column, build) -> DataFrame:
    row = F.struct("store_id", "store_name", "category")
    listed = rows.where(condition).select("style_id", build(row).alias("action")).select("style_id", "action.*")
    return listed.select(*_REPORT_COLUMNS)


def markdowns(performance, stores, products, category: str | None = None) -> DataFrame:
    """Every store and style that sells slowly with supply for weeks."""
    return _whole_list(avg_performance(performance, stores, products, category), _is_markdown(), _markdown)


def reorders(performance, stores, products, category: str | None = None) -> DataFrame:
    """Every store and style that sells fast with little supply."""
    return _whole_list(avg_performance(performance, stores, products, category), _is_reorder(), _reorder)


def recommendations(
    performance: DataFrame, stores: DataFrame, products: DataFrame, inventory: DataFrame,
    category: str | None = None, limit: int = 25,
) -> DataFrame:
    """Transfers, reorders and markdowns in one report, high priority first.

    Performance and stock are read once. Each style gathers at most ``limit`` stores per
    role, which is enough for the first ``limit`` actions of the report.
    """
    bounded("limit", limit, 100)
    roles = {
        "reorder": _is_reorder(), "markdown": _is_markdown(), "needy": _is_needy(), "supplier": _is_supplier(),
    }
    rows = _role_rows(performance, stores, products, inventory, category, roles)
    grouped = _candidates(rows, roles, limit)
    actions = F.concat(
        F.transform("reorder", _reorder), F.transform("markdown", _markdown), _transfers(limit)
    )
    return _report(grouped, actions, limit)

