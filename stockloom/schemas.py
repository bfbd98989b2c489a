"""Declared schemas of the retail tables, as DDL text; readers never infer types."""

# Catalogue, stock and planning model.
PRODUCTS = (
    "product_id string, style_id string, sku_id string, product_name string, category string, "
    "subcategory string, brand string, color string, size string, season string, "
    "msrp decimal(10,2), cost decimal(10,2), description string, image_url string, "
    "silhouette string, occasion string, material string, status string"
)
STORES = (
    "store_id int, store_name string, city string, state string, region string, store_type string"
)
INVENTORY = (
    "store_id int, sku_id string, on_hand_qty int, reserved_qty int, available_qty int, "
    "in_transit_qty int, last_updated timestamp"
)
RELATIONSHIPS = (
    "source_product_id string, related_product_id string, relationship_type string, "
    "relationship_reason string"
)
ORDERS = (
    "order_id string, customer_id string, order_date timestamp, order_status string, "
    "fulfillment_store_id int, destination_store_id int, ship_to_city string, shipping_method string, "
    "estimated_delivery_days int, estimated_delivery_date date"
)
ORDER_LINES = "order_id string, sku_id string, quantity int, unit_price decimal(10,2)"
WEEKLY_PERFORMANCE = (
    "week_start_date date, store_id int, style_id string, units_sold int, net_sales decimal(12,2), "
    "gross_margin decimal(12,2), markdown_rate decimal(5,2), sell_through_pct decimal(5,2), "
    "weeks_of_supply decimal(6,2)"
)

# Customer and sales model.
CORE_STORES = "store_id int, store_name string, region string, state_code string, city string"
BRANDS = "brand_id int, brand_name string"
CORE_PRODUCTS = (
    "product_id bigint, sku string, product_name string, category string, brand_id int, color string, "
    "size_code string, list_price decimal(10,2)"
)
CUSTOMERS = (
    "customer_id bigint, loyalty_id string, email string, first_name string, last_name string, "
    "tier string, preferred_store_id int, stylist_notes string, lifetime_value_band string, "
    "created_at date"
)
CUSTOMER_PREFERENCES = (
    "customer_id bigint, preferred_sizes array<string>, preferred_colors array<string>, "
    "preferred_brands array<string>, shopping_occasions array<string>, updated_at timestamp"
)
SAVED_ITEMS = "saved_item_id bigint, customer_id bigint, product_id bigint, saved_at timestamp"
TRANSACTIONS = (
    "transaction_id bigint, customer_id bigint, store_id int, transaction_ts timestamp, "
    "sales_channel string, payment_method string, gross_amount decimal(12,2), "
    "discount_amount decimal(12,2), net_amount decimal(12,2)"
)
TRANSACTION_ITEMS = (
    "transaction_item_id bigint, transaction_id bigint, product_id bigint, quantity int, "
    "unit_price decimal(10,2), discount_amount decimal(10,2), line_total decimal(10,2)"
)
RETURNS = (
    "return_id bigint, transaction_item_id bigint, customer_id bigint, return_ts timestamp, "
    "reason_code string, refund_amount decimal(10,2)"
)
CALENDAR = (
    "calendar_date date, month int, day_of_week string, is_weekend boolean, is_black_friday boolean, "
    "is_cyber_monday boolean"
)

# Style and SKU summary model.
STYLES = (
    "style_id string, style_name string, category string, season string, planned_cc_count int, "
    "core_vs_fashion string, strategic_priority string"
)
SKUS = (
    "sku string, style_id string, color_name string, size string, msrp decimal(10,2), "
    "cost decimal(10,2), substitute_style_id string, trade_up_style_id string"
)
SKU_INVENTORY = (
    "store_id int, store_name string, region string, sku string, on_hand_units int, "
    "available_for_transfer boolean, available_online_dc int"
)
SALES_SUMMARY = (
    "period string, sku string, style_id string, units_sold int, net_sales decimal(12,2), "
    "gross_margin_pct decimal(5,2), sell_through_pct decimal(5,2), markdown_rate decimal(5,2), "
    "return_rate decimal(5,2), store_count int"
)
CUSTOMER_PROFILES = (
    "customer_id bigint, name string, tier string, preferred_sizes array<string>, "
    "preferred_colors array<string>, favorite_categories array<string>, "
    "recent_purchases array<struct<sku:string,qty:int>>"
)
STYLE_RELATIONSHIPS = (
    "from_style_id string, to_style_id string, relationship_type string, rationale string, "
    "priority_rank int"
)
SOURCE_ORDERS = (
    "order_id bigint, customer_id bigint, store_id int, order_status string, order_source string, "
    "associate_note string, created_at timestamp"
)
SOURCE_ORDER_ITEMS = (
    "order_item_id bigint, order_id bigint, sku string, quantity int, unit_price decimal(10,2)"
)
