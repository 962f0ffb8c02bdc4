"""The commerce relations as bound to the driver's tables, once as DataFrames and once as DuckDB CTEs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.functions.scalars import channel, minor
from quern.session import table

AS_OF = "2001-09-01"
EVENTS_AS_OF = "2024-02-01"
LONG = "bigint"


def orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    key, cust = F.col("o_orderkey"), F.col("o_custkey")
    cancelled = key % 11 == 0
    return table(spark, sf_dir, "orders").select(
        F.concat(F.lit("b"), (cust % 3).cast("string")).alias("brand_id"),
        key.alias("order_id"),
        cust.alias("customer_id"),
        F.col("o_orderdate").cast("timestamp").alias("placed_at"),
        F.col("o_orderstatus").alias("status"),
        F.when(cust % 3 == 2, "KWD").otherwise("INR").alias("currency_code"),
        F.when(key % 3 == 0, "cod").otherwise("prepaid").alias("payment_method"),
        minor(F.col("o_totalprice")).alias("amount_minor"),
        cancelled.alias("is_cancelled"),
        ((key % 13 == 0) & ~cancelled).alias("is_refunded"),
        F.when(key % 7 == 0, "rto").when(F.col("o_orderstatus") == "F", "delivered").otherwise("none").alias("terminal_class"),
        F.col("o_orderpriority").alias("priority"),
    )


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    gross = minor(F.col("l_extendedprice"))
    part = lambda c: F.call_function("div", gross * F.round(F.col(c) * 100).cast(LONG), F.lit(100).cast(LONG))
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("order_id"),
        F.col("l_linenumber").cast(LONG).alias("line_number"),
        F.col("l_partkey").alias("product_id"),
        F.concat(F.lit("c"), (F.col("l_suppkey") % 5).cast("string")).alias("courier"),
        F.col("l_quantity").cast(LONG).alias("quantity"),
        gross.alias("gross_minor"),
        part("l_discount").alias("discount_minor"),
        part("l_tax").alias("tax_minor"),
        F.col("l_shipdate").cast("timestamp").alias("shipped_at"),
        F.col("l_returnflag").alias("return_flag"),
        F.col("l_linestatus").alias("line_status"),
    )


def touches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pixel events with the marketing fields that their JSON property decides."""
    k = F.get_json_object("props", "$.k").cast(LONG)
    mark = k % 10
    pick = lambda n, v: F.when(mark == n, v)
    fields = {
        "fbclid": pick(0, "f"),
        "gclid": pick(1, "g"),
        "ttclid": pick(2, "t"),
        "msclkid": pick(3, "m"),
        "utm_medium": F.when(mark == 4, "CPC").when(mark == 5, "email").when(mark == 6, "social").when(mark == 7, "referral"),
        "referrer": pick(8, "https://www.site.example/a"),
    }
    return table(spark, sf_dir, "events").select(
        F.concat(F.lit("b"), (F.col("user_id") % 3).cast("string")).alias("brand_id"),
        F.col("user_id").alias("visitor_id"),
        "event_id",
        F.col("ts").cast("timestamp").alias("seen_at"),
        "event_type",
        minor(F.col("value")).alias("value_minor"),
        k.alias("k"),
        channel(fields).alias("channel"),
    )


# o: orders, l: lines, e: touches; lo: lines with their order's brand, customer and time.
PRELUDE = """
WITH o AS (
  SELECT 'b' || CAST(o_custkey % 3 AS VARCHAR) AS brand_id, o_orderkey AS order_id, o_custkey AS customer_id,
    CAST(o_orderdate AS TIMESTAMP) AS placed_at, o_orderstatus AS status,
    CASE WHEN o_custkey % 3 = 2 THEN 'KWD' ELSE 'INR' END AS currency_code,
    CASE WHEN o_orderkey % 3 = 0 THEN 'cod' ELSE 'prepaid' END AS payment_method,
    CAST(round(o_totalprice * 100) AS BIGINT) AS amount_minor,
    o_orderkey % 11 = 0 AS is_cancelled, o_orderkey % 13 = 0 AND o_orderkey % 11 <> 0 AS is_refunded,
    CASE WHEN o_orderkey % 7 = 0 THEN 'rto' WHEN o_orderstatus = 'F' THEN 'delivered' ELSE 'none' END AS terminal_class,
    o_orderpriority AS priority
  FROM orders
), l AS (
  SELECT l_orderkey AS order_id, CAST(l_linenumber AS BIGINT) AS line_number, l_partkey AS product_id,
    'c' || CAST(l_suppkey % 5 AS VARCHAR) AS courier, CAST(l_quantity AS BIGINT) AS quantity,
    CAST(round(l_extendedprice * 100) AS BIGINT) AS gross_minor,
    CAST(round(l_extendedprice * 100) AS BIGINT) * CAST(round(l_discount * 100) AS BIGINT) // 100 AS discount_minor,
    CAST(round(l_extendedprice * 100) AS BIGINT) * CAST(round(l_tax * 100) AS BIGINT) // 100 AS tax_minor,
    CAST(l_shipdate AS TIMESTAMP) AS shipped_at, l_returnflag AS return_flag, l_linestatus AS line_status
  FROM lineitem
), e0 AS (
  SELECT 'b' || CAST(user_id % 3 AS VARCHAR) AS brand_id, user_id AS visitor_id, event_id, CAST(ts AS TIMESTAMP) AS seen_at, event_type,
    CAST(round(value * 100) AS BIGINT) AS value_minor, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events
), e AS (
  SELECT *, CASE k % 10 WHEN 0 THEN 'paid_meta' WHEN 1 THEN 'paid_google' WHEN 2 THEN 'paid_tiktok' WHEN 3 THEN 'paid_bing'
    WHEN 4 THEN 'paid' WHEN 5 THEN 'email' WHEN 6 THEN 'organic_social' WHEN 7 THEN 'referral' WHEN 8 THEN 'referral' ELSE 'direct' END AS channel
  FROM e0
), s AS (
  SELECT *, CAST(1 + sum(CASE WHEN gap > 1800 THEN 1 ELSE 0 END) OVER (PARTITION BY visitor_id ORDER BY seen_at, event_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS session_seq,
    row_number() OVER (PARTITION BY visitor_id ORDER BY seen_at, event_id) AS touch_seq,
    row_number() OVER (PARTITION BY visitor_id ORDER BY seen_at DESC, event_id DESC) AS touch_back
  FROM (SELECT *, CAST(floor(epoch(seen_at)) AS BIGINT) - CAST(floor(epoch(lag(seen_at) OVER (PARTITION BY visitor_id ORDER BY seen_at, event_id))) AS BIGINT) AS gap FROM e)
), r AS (
  SELECT brand_id, order_id, customer_id, currency_code, placed_at, event_type, sign * amount_minor AS amount_minor,
    placed_at + CASE event_type WHEN 'finalization' THEN INTERVAL 7 DAY ELSE INTERVAL 0 DAY END AS effective_at,
    state, terminal, rank
  FROM o JOIN (VALUES ('provisional_recognition', 1, 'placed', false, 10), ('finalization', 1, 'confirmed', false, 20),
      ('cod_delivery_confirmed', 1, 'delivered', true, 90), ('cod_rto_clawback', -1, 'rto', true, 85),
      ('cancellation', -1, 'cancelled', true, 80), ('refund', -1, 'refunded', true, 70)) AS k(event_type, sign, state, terminal, rank)
    ON CASE k.event_type WHEN 'provisional_recognition' THEN true
      WHEN 'finalization' THEN payment_method = 'prepaid' AND placed_at + INTERVAL 7 DAY < TIMESTAMP '2001-09-01' AND NOT is_cancelled AND NOT is_refunded
      WHEN 'cod_delivery_confirmed' THEN payment_method = 'cod' AND terminal_class = 'delivered'
      WHEN 'cod_rto_clawback' THEN payment_method = 'cod' AND terminal_class = 'rto'
      WHEN 'cancellation' THEN is_cancelled ELSE is_refunded END
), os AS (
  SELECT brand_id, order_id, customer_id, currency_code, arg_max(state, (terminal, effective_at, rank)) AS state, bool_or(terminal) AS is_terminal,
    CAST(coalesce(sum(amount_minor) FILTER (WHERE event_type <> 'provisional_recognition'), 0) AS BIGINT) AS realized_minor,
    min(placed_at) AS placed_at, max(effective_at) AS last_at, max(CASE WHEN event_type = 'provisional_recognition' THEN amount_minor END) AS amount_minor
  FROM r GROUP BY ALL
), lo AS (
  SELECT l.*, o.brand_id, o.customer_id, o.placed_at, o.currency_code FROM l JOIN o USING (order_id)
), cf AS (
  SELECT brand_id, customer_id, count(*) AS orders, CAST(sum(realized_minor) AS BIGINT) AS value_minor, min(placed_at) AS first_at, max(placed_at) AS last_at,
    date_diff('day', CAST(max(placed_at) AS DATE), DATE '2001-09-01') AS recency_days
  FROM os GROUP BY 1, 2
)
"""


def sql(body: str) -> str:
    """An oracle statement over the shared CTEs; ``body`` may begin with more CTEs, after a comma."""
    return PRELUDE + body
