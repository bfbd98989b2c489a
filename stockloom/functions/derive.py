"""Derived columns: calendar, demand and return weights, line pricing, store naming."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stockloom.functions.money import cents, half_up
from stockloom.functions.text import concat_skip_null, padded

# The season and its two sale days.
SEASON = (date(2025, 10, 1), date(2025, 12, 31))
BLACK_FRIDAY, CYBER_MONDAY = date(2025, 11, 28), date(2025, 12, 1)

# How return risk varies by category and channel.
CATEGORY_RETURN_FACTOR = {
    "Tops": 1.05, "Bottoms": 1.15, "Outerwear": 0.90, "Footwear": 1.25, "Accessories": 0.70,
    "Beauty": 0.45, "Home": 0.55, "Kids": 1.10, "Activewear": 0.95,
}
CHANNEL_RETURN_FACTOR = {"in_store": 0.9, "online": 1.2, "mobile": 1.1}
MAX_RETURN_RISK = 0.65

# Regions in order, and six (city, state, street) slots for each.
REGION_SLOTS = {
    "Northeast": [
        ("Boston", "MA", "Boylston Street"), ("New York", "NY", "Fifth Avenue"),
        ("Philadelphia", "PA", "Market Street"), ("Providence", "RI", "Main Street"),
        ("Hartford", "CT", "Broad Street"), ("Newark", "NJ", "Canal Street"),
    ],
    "Southeast": [
        ("Atlanta", "GA", "Peachtree Street"), ("Charlotte", "NC", "Tryon Street"),
        ("Nashville", "TN", "Broadway"), ("Orlando", "FL", "Orange Avenue"),
        ("Miami", "FL", "Biscayne Boulevard"), ("Raleigh", "NC", "Hillsborough Street"),
    ],
    "Midwest": [
        ("Chicago", "IL", "Michigan Avenue"), ("Columbus", "OH", "High Street"),
        ("Detroit", "MI", "Woodward Avenue"), ("Cleveland", "OH", "Euclid Avenue"),
        ("Indianapolis", "IN", "Meridian Street"), ("Milwaukee", "WI", "Wisconsin Avenue"),
    ],
    "Southwest": [
        ("Dallas", "TX", "Elm Street"), ("Austin", "TX", "Congress Avenue"),
        ("Phoenix", "AZ", "Camelback Road"), ("Houston", "TX", "Westheimer Road"),
        ("San Antonio", "TX", "Commerce Street"), ("Albuquerque", "NM", "Central Avenue"),
    ],
    "West": [
        ("Los Angeles", "CA", "Sunset Boulevard"), ("San Diego", "CA", "Gaslamp Quarter"),
        ("Seattle", "WA", "Pine Street"), ("Portland", "OR", "NW 23rd Avenue"),
        ("San Francisco", "CA", "Market Street"), ("Las Vegas", "NV", "Las Vegas Boulevard"),
    ],
}
# The one store whose place does not follow the slots.
FIXED_STORE = {"store_id": 56, "region": "Northeast", "city": "Boston", "state": "MA", "street": "Boylston Street"}


def _map(values: dict) -> Column:
    return F.create_map(*[F.lit(x) for pair in values.items() for x in pair])


def region_slots(spark: SparkSession) -> DataFrame:
    """The thirty places as a table ``slot_region, slot, city, state, street``."""
    rows = [(r, i, *place) for r, places in REGION_SLOTS.items() for i, place in enumerate(places)]
    return spark.createDataFrame(rows, "slot_region string, slot int, city string, state string, street string")


def calendar_flags(day: Column) -> dict[str, Column]:
    """Calendar attributes of a date."""
    return {
        "month": F.month(day),
        "day_of_week": F.date_format(day, "EEEE"),
        "is_weekend": F.weekday(day) >= 5,
        "is_black_friday": day == F.lit(BLACK_FRIDAY),
        "is_cyber_monday": day == F.lit(CYBER_MONDAY),
    }


def calendar_dim(bounds: DataFrame) -> DataFrame:
    """One row per day from ``start_date`` to ``end_date`` of the one-row table ``bounds``."""
    days = bounds.select(F.explode(F.sequence("start_date", "end_date")).alias("calendar_date"))
    return days.withColumns(calendar_flags(F.col("calendar_date")))


def season_bounds(spark: SparkSession, start: date = SEASON[0], end: date = SEASON[1]) -> DataFrame:
    return spark.createDataFrame([(start, end)], "start_date date, end_date date")


def demand_weight(day: Column) -> Column:
    """Relative demand of a day: later months, the two sale days and long weekends weigh more."""

    def factor(condition: Column, value: float) -> Column:
        return F.when(condition, F.lit(value)).otherwise(F.lit(1.0))

    return (
        factor(F.month(day) == 11, 1.2) * factor(F.month(day) == 12, 1.65)
        * factor(day == F.lit(BLACK_FRIDAY), 6.0) * factor(day == F.lit(CYBER_MONDAY), 4.0)
        * factor(F.weekday(day) >= 4, 1.35)
    )


def return_risk(base: Column | float, category: Column, channel: Column) -> Column:
    """Chance of a return, at most 65 %; NULL for an unknown category or channel."""
    rate = base if isinstance(base, Column) else F.lit(base)
    product = rate * F.try_element_at(_map(CATEGORY_RETURN_FACTOR), category) * F.try_element_at(
        _map(CHANNEL_RETURN_FACTOR), channel
    )
    return F.when(product.isNotNull(), F.least(F.lit(MAX_RETURN_RISK), product))


def promo_multiplier(day: Column) -> Column:
    """How much deeper promotions run on a day."""
    sale = day.isin(BLACK_FRIDAY, CYBER_MONDAY)
    return F.when(sale, F.lit(1.8)).when(F.month(day) == 12, F.lit(1.25)).otherwise(F.lit(1.0))


def promo_rate(rate: Column) -> Column:
    """A promotion rate kept within 0 and 0.52."""
    return F.least(F.lit(0.52), F.greatest(F.lit(0.0), rate))


def line_pricing(quantity: Column, unit_price: Column, rate_bp: Column) -> dict[str, Column]:
    """Gross, discount and total of a line in cents; the rate comes in basis points.

    The discount is rounded half-up to the cent.
    """
    gross = quantity.cast("bigint") * cents(unit_price)
    discount = half_up(gross * rate_bp, F.lit(10_000))
    return {"gross_cents": gross, "discount_cents": discount, "total_cents": gross - discount}


def email_handle(first_name: Column, last_name: Column, customer_id: Column, domain: Column) -> Column:
    """Address from initial, last name and id; an ampersand is spelled out."""
    handle = F.replace(F.lower(F.concat(F.substring(first_name, 1, 1), last_name)), F.lit("&"), F.lit("and"))
    return concat_skip_null(handle, customer_id, F.lit("@"), domain)


def preferred_store(customer_id: Column, store_count: Column | int) -> Column:
    """Home store of a customer, spread evenly over stores numbered from one."""
    count = store_count if isinstance(store_count, Column) else F.lit(store_count)
    return (customer_id * 7) % count + 1


def store_directory(stores: DataFrame) -> DataFrame:
    """Region and display name by store number: ``store_id, store_name, region``."""
    regions = list(REGION_SLOTS)
    zero_based = F.col("store_id") - 1
    placed = stores.select(
        "store_id",
        F.element_at(F.array(*[F.lit(r) for r in regions]), (zero_based % len(regions) + 1).cast("int")).alias("slot_region"),
        (zero_based % 6).cast("int").alias("slot"),
    )
    named = placed.join(F.broadcast(region_slots(stores.sparkSession)), ["slot_region", "slot"])
    fixed = F.col("store_id") == FIXED_STORE["store_id"]
    region = F.when(fixed, FIXED_STORE["region"]).otherwise(F.col("slot_region"))
    city = F.when(fixed, FIXED_STORE["city"]).otherwise(F.col("city"))
    street = F.when(fixed, FIXED_STORE["street"]).otherwise(F.col("street"))
    number = F.when(F.col("store_id") < 1000, padded(F.col("store_id"), 3)).otherwise(F.col("store_id").cast("string"))
    name = F.concat(F.lit("Store-"), number, F.lit(" ("), region, F.lit(") - "), city, F.lit(", "), street)
    return named.select("store_id", name.alias("store_name"), region.alias("region"))


def transfer_flag(on_hand: Column) -> Column:
    """Whether a store has enough units to send some away."""
    return on_hand > 3


def self_reference_null(style: Column, other: Column) -> Column:
    """Reference to another style; NULL where it points at the style itself."""
    return F.nullif(other, style)
