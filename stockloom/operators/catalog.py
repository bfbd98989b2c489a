"""Product lookup and search."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stockloom.functions.text import product_tokens, query_tokens
from stockloom.operators.gram_index import GramIndex, matches_everything
from stockloom.operators.token_search import TIE_ORDER, best_products
from stockloom.plans.topk import bounded, first_rows, top_k
from stockloom.session import checkpoint_root, scratch_dir, written

PRODUCT_COLUMNS = (
    "product_id", "style_id", "sku_id", "product_name", "category", "subcategory", "brand", "color", "size",
    "season", "msrp", "cost", "description", "image_url", "silhouette", "occasion", "material", "status",
)
_SEARCHED = ("product_name", "style_id", "sku_id")
_TOKEN_TEXTS = (
    "product_name", "style_id", "sku_id", "category", "subcategory", "brand", "color", "size", "occasion",
    "material",
)
_SHELF_ORDER = ("category", "product_name", "color", "size", "sku_id")
MAX_SEARCH_LIMIT = 100


def money_as_double(df: DataFrame, *columns: str) -> DataFrame:
    """Money columns as doubles, the form results are handed out in."""
    return df.withColumns({c: F.col(c).cast("double") for c in columns})


def product_records(products: DataFrame) -> DataFrame:
    """The 18 product columns with prices as doubles."""
    return money_as_double(products.select(*PRODUCT_COLUMNS), "msrp", "cost")


def products_by_id(products: DataFrame, ids: DataFrame) -> DataFrame:
    """Product records for every asked ``product_id``."""
    return product_records(products.join(ids.select("product_id").distinct(), "product_id", "left_semi"))


def missing_keys(table: DataFrame, asked: DataFrame, key: str) -> DataFrame:
    """Asked keys a table does not hold."""
    return asked.select(key).distinct().join(table.select(key), key, "left_anti")


def missing_products(products: DataFrame, ids: DataFrame) -> DataFrame:
    """Asked ``product_id`` values the catalogue does not hold."""
    return missing_keys(products, ids, "product_id")


def active_only(products: DataFrame) -> DataFrame:
    return products.where(F.col("status") == "active")


def apply_filters(df: DataFrame, at_least: dict | None = None, at_most: dict | None = None, **equal) -> DataFrame:
    """Equality and inclusive range filters; a ``None`` value means no filter."""
    for column, value in equal.items():
        if value is not None:
            df = df.where(F.col(column) == value)
    for column, value in (at_least or {}).items():
        if value is not None:
            df = df.where(F.col(column) >= value)
    for column, value in (at_most or {}).items():
        if value is not None:
            df = df.where(F.col(column) <= value)
    return df


def ilike_any(q: str, columns: tuple[str, ...] = _SEARCHED) -> Column:
    """True where a column contains ``q`` in any case; ``%`` and ``_`` in ``q`` are wildcards."""
    return reduce(lambda a, b: a | b, [F.col(c).ilike(f"%{q}%") for c in columns])


def shelf_order() -> list[Column]:
    return [F.col(c).asc_nulls_last() for c in _SHELF_ORDER]


def substring_search(
    products: DataFrame, q: str | None = None, category: str | None = None, occasion: str | None = None,
    limit: int = 20,
) -> DataFrame:
    """One query against the active products, in shelf order."""
    bounded("limit", limit, MAX_SEARCH_LIMIT)
    if q is not None and len(q) < 2:
        raise ValueError("q needs at least two characters")
    hits = apply_filters(active_only(products), category=category, occasion=occasion)
    if q is not None:
        hits = hits.where(ilike_any(q))
    return first_rows(product_records(hits), shelf_order(), limit)


def query_rejects(queries: DataFrame, limit: int = 20) -> DataFrame:
    """Queries that break the parameter rules, with the reason."""
    bounded("limit", limit, MAX_SEARCH_LIMIT)
    reason = F.when(F.col("query_id").isNull(), "missing_query_id").when(
        F.length("q") < 2, "q_too_short"
    )
    return queries.withColumn("reason", reason).where(F.col("reason").isNotNull())


def _same(left: str, right: str, columns: list[str]) -> Column:
    """Equality of columns under two aliases, with NULL equal to NULL."""
    return reduce(lambda a, b: a & b, [F.col(f"{left}.{c}").eqNullSafe(F.col(f"{right}.{c}")) for c in columns])


def _searched_texts(products: DataFrame) -> DataFrame:
    """Each lower-case text that an active product answers to, once."""
    texts = F.array_distinct(F.array(*[F.lower(c) for c in _SEARCHED]))
    return active_only(products).select(F.explode(texts).alias("text")).distinct()


def stored_index(products: DataFrame, root: str | None = None) -> GramIndex:
    """The gram index of these products' texts, built at the first call and opened by later ones.

    It lies under ``root`` (default: the shared folder) by a digest of the texts, so other texts never find it.
    """
    spark = products.sparkSession
    own = F.xxhash64(*[F.lower(c) for c in _SEARCHED])
    seen = active_only(products).agg(F.count(F.lit(1)), F.coalesce(F.bit_xor(own), F.lit(0)), F.coalesce(F.sum(own.cast("decimal(38, 0)")), F.lit(0))).first()
    name = "-".join(str(int(x)) for x in seen)
    index = GramIndex(spark, f"{(root or checkpoint_root(spark)).rstrip('/')}/stockloom/grams/{name}")
    if not index.built():
        index.extend(_searched_texts(products))
    return index


def substring_hits(products: DataFrame, queries: DataFrame, limit: int = 20, index: GramIndex | None = None) -> DataFrame:
    """First phase of search for a table of queries: ``query_id, product_id, rank``.

    Equal queries are answered once. Products are ranked per searched text and per filter
    combination first; a query then merges the leading ``limit`` products of each text it
    matches, however many products share the text. The texts come from ``index``, which must hold those of the
    products and may hold more; without one an index is built for this call. Queries without text use the empty text
    that every product carries; its facets are few and large, so they are ranked, and with
    that cut in every task, before they meet the queries. What is used more than once is
    written out and read from there.
    """
    bounded("limit", limit, MAX_SEARCH_LIMIT)
    base = scratch_dir(products.sparkSession, "substring")
    filters = ["category", "occasion"]
    shelf = active_only(products).select("product_id", "occasion", *_SHELF_ORDER, "style_id")
    lowered = F.array_distinct(F.array(*[F.lower(c) for c in _SEARCHED]))
    if index is None:
        index = GramIndex(products.sparkSession, f"{base}/grams")
        index.extend(_searched_texts(products))
    asks = written(queries.select("q", *filters).distinct(), f"{base}/asks")
    everything = asks.where(matches_everything(F.col("q"))).withColumn("text", F.lit(""))
    by_text = asks.join(index.matches(asks.select("q").where(~matches_everything(F.col("q")))), "q")
    wanted = written(everything.unionByName(by_text), f"{base}/wanted")

    none = F.lit(None).cast("string")
    combinations = F.array(*[
        F.struct(c.alias("f_category"), o.alias("f_occasion"))
        for c in (F.col("category"), none) for o in (F.col("occasion"), none)
    ])
    facet = ["text", *filters]

    def listed(carried: Column) -> DataFrame:
        """Products under each text they carry and each filter combination they pass."""
        return shelf.withColumn("text", carried).withColumn("facet", F.explode(combinations)).select(
            "product_id", "text", *[c for c in _SHELF_ORDER if c != "category"], F.col("category").alias("shelf"),
            F.col("facet.f_category").alias("category"), F.col("facet.f_occasion").alias("occasion"),
        )

    def asked_for(rows: DataFrame) -> DataFrame:
        return rows.alias("l").join(wanted.select(*facet).distinct().alias("w"), _same("l", "w", facet), "left_semi")

    order = [F.col("shelf" if c == "category" else c).asc_nulls_last() for c in _SHELF_ORDER]
    named = top_k(asked_for(listed(F.explode(F.filter(lowered, lambda t: t != "")))), facet, order, limit, rank="place")
    heads = named.unionByName(asked_for(top_k(listed(F.lit("")), facet, order, limit, rank="place")))
    joined = heads.alias("h").join(wanted.alias("w"), _same("h", "w", facet)).select(
        "w.q", "w.category", "w.occasion", "h.product_id", "h.shelf", *[f"h.{c}" for c in _SHELF_ORDER if c != "category"]
    )
    ask = ["q", *filters]
    # A product meets a query through its texts and the empty one at most, so the leading rows hold the leading products.
    leading = top_k(joined, ask, order, (len(_SEARCHED) + 1) * limit, rank="row").drop("row")
    answers = top_k(leading.distinct(), ask, order, limit)
    return queries.alias("k").join(answers.alias("a"), _same("k", "a", ask)).select("k.query_id", "a.product_id", "a.rank")


def token_hits(
    products: DataFrame, queries: DataFrame, limit: int = 20, strict_filters: bool = False
) -> DataFrame:
    """Products scored by shared tokens: ``query_id, product_id, matched, score, rank``.

    Ten points per shared token, twenty more if the product name contains the query and ten
    more if the query contains the product name. A query of three or more tokens needs two
    of them, a shorter one needs one. With ``strict_filters`` a product must also have the
    category and occasion the query asks for. Equal queries are scored once.
    """
    bounded("limit", limit, MAX_SEARCH_LIMIT)
    filters = ["category", "occasion"] if strict_filters else []
    named = queries.where(F.col("q").isNotNull()).select("query_id", F.lower("q").alias("text"), *filters)
    ask = ["text", *filters]
    asks = written(
        named.select(*ask).distinct().withColumns({"ask": F.monotonically_increasing_id(), "tokens": query_tokens(F.col("text"))}),
        scratch_dir(products.sparkSession, "asks"),
    )
    # The catalogue is small next to the work on it, so its few bytes must not decide the number of tasks.
    tasks = int(products.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    held = product_tokens(F.col("size"), *[F.col(c) for c in _TOKEN_TEXTS])
    shelf = active_only(products).repartition(tasks, "product_id").select(
        "product_id", *TIE_ORDER, *filters, held.alias("held")
    )
    wanted = asks.withColumnsRenamed({c: f"w_{c}" for c in filters})
    ranked = best_products(shelf, wanted, limit, filters).join(asks, "ask")
    return named.alias("k").join(ranked.alias("r"), _same("k", "r", ask)).select(
        "k.query_id", "r.product_id", F.col("r.matched").cast("bigint").alias("matched"), F.col("r.score").cast("bigint").alias("score"), "r.rank"
    )


def search(
    products: DataFrame, queries: DataFrame, limit: int = 20, strict_filters: bool = False, index: GramIndex | None = None
) -> DataFrame:
    """Both phases for a table of queries ``query_id, q, category, occasion``.

    Token search answers the queries with text that no substring matched. It ignores the
    category and occasion of the query unless ``strict_filters`` is set. The first phase is
    written out: it is used twice, and with the size of what is left known, Catalyst can
    choose the join for the second phase.
    """
    base = scratch_dir(products.sparkSession, "search")
    direct = written(substring_hits(products, queries, limit, index), f"{base}/direct")
    answered = direct.select("query_id").distinct()
    unanswered = written(
        queries.where(F.col("q").isNotNull()).join(answered, "query_id", "left_anti"), f"{base}/unanswered"
    )
    second = token_hits(products, unanswered, limit, strict_filters)
    hits = direct.withColumn("phase", F.lit(1)).unionByName(
        second.select("query_id", "product_id", "rank").withColumn("phase", F.lit(2))
    )
    return hits.join(product_records(products), "product_id")


def search_one(
    products: DataFrame, q: str | None = None, category: str | None = None, occasion: str | None = None,
    limit: int = 20,
) -> DataFrame:
    """Both phases for one query: product records in their order.

    The first phase runs at once, because only an empty result calls for the second.
    """
    direct = substring_search(products, q, category, occasion, limit)
    if q is None or not direct.isEmpty():
        return direct
    asked = products.sparkSession.createDataFrame([("q", q)], "query_id string, q string")
    hits = token_hits(products, asked, limit).select("product_id", "rank")
    return product_records(products).join(hits, "product_id").orderBy("rank").select(*PRODUCT_COLUMNS)
