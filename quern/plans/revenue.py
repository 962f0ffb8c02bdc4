"""Recognition, order state and the revenue marts, bound to the driver's tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quern.functions.scalars import bps, deterministic_id
from quern.operators.marts import histogram
from quern.operators.recognition import composition, order_state, recognise
from quern.plans.catalogue import query
from quern.plans.shop import AS_OF, lines, orders, sql

LONG = "bigint"
ORDER = ["brand_id", "order_id", "customer_id", "currency_code"]


def ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    return recognise(orders(spark, sf_dir), as_of=AS_OF)


def states(spark: SparkSession, sf_dir: str) -> DataFrame:
    return order_state(ledger(spark, sf_dir), ORDER)


def total(c: Column | str) -> Column:
    return F.coalesce(F.sum(c), F.lit(0)).cast(LONG)


@query(
    "g1_revenue_ledger",
    sql("""SELECT strftime(effective_at, '%Y-%m') AS period, event_type AS label, currency_code,
  count(*) AS n_events, CAST(sum(amount_minor) AS BIGINT) AS amount_minor FROM r GROUP BY 1, 2, 3"""),
)
def revenue_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """G1: recognised amounts by month, event and currency."""
    events = ledger(spark, sf_dir)
    return events.groupBy(F.date_format("effective_at", "yyyy-MM").alias("period"), F.col("event_type").alias("label"), "currency_code").agg(
        F.count("*").alias("n_events"), total(F.col("signed_minor")).alias("amount_minor")
    )


@query(
    "g1_ledger_events",
    sql("""SELECT sha256(concat_ws(chr(0), brand_id, CAST(order_id AS VARCHAR), event_type)) AS ledger_id, brand_id, order_id, event_type, amount_minor,
  strftime(effective_at, '%Y-%m-%d') AS effective_on FROM r"""),
)
def ledger_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """G1: the ledger at event grain with deterministic ids."""
    key = deterministic_id(F.col("brand_id"), F.col("order_id"), F.col("event_type"))
    return ledger(spark, sf_dir).select(
        key.alias("ledger_id"), "brand_id", "order_id", "event_type", F.col("signed_minor").alias("amount_minor"), F.date_format("effective_at", "yyyy-MM-dd").alias("effective_on")
    )


@query("s2_order_state", sql("SELECT brand_id, order_id, state, is_terminal, realized_minor, strftime(last_at, '%Y-%m-%d') AS last_on FROM os"))
def order_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Terminal-wins order state with realised value."""
    return states(spark, sf_dir).select("brand_id", "order_id", "state", "is_terminal", "realized_minor", F.date_format("last_at", "yyyy-MM-dd").alias("last_on"))


@query(
    "g2_revenue_analytics",
    sql("""SELECT brand_id, strftime(placed_at, '%Y-%m') AS month, state, currency_code, count(*) AS orders,
  CAST(sum(amount_minor) AS BIGINT) AS amount_minor, CAST(sum(realized_minor) AS BIGINT) AS realized_minor FROM os GROUP BY 1, 2, 3, 4"""),
)
def revenue_analytics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Month by state and currency."""
    return (
        states(spark, sf_dir)
        .groupBy("brand_id", F.date_format("placed_at", "yyyy-MM").alias("month"), "state", "currency_code")
        .agg(F.count("*").alias("orders"), total("amount_minor").alias("amount_minor"), total("realized_minor").alias("realized_minor"))
    )


@query(
    "g3_executive_metrics",
    sql("""SELECT brand_id, currency_code, count(*) AS orders, count(DISTINCT customer_id) AS customers, CAST(sum(realized_minor) AS BIGINT) AS realized_minor,
  count(*) FILTER (WHERE state = 'delivered') AS delivered, count(*) FILTER (WHERE state = 'rto') AS rto,
  count(*) FILTER (WHERE state = 'cancelled') AS cancelled, count(*) FILTER (WHERE state = 'refunded') AS refunded,
  CAST(sum(realized_minor) AS BIGINT) // count(*) AS aov_minor FROM os GROUP BY 1, 2"""),
)
def executive_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Totals by currency."""
    of = lambda s: F.count_if(F.col("state") == s).alias(s)
    out = (
        states(spark, sf_dir)
        .groupBy("brand_id", "currency_code")
        .agg(
            F.count("*").alias("orders"), F.count_distinct("customer_id").alias("customers"), total("realized_minor").alias("realized_minor"),
            of("delivered"), of("rto"), of("cancelled"), of("refunded"),
        )
    )
    return out.withColumn("aov_minor", F.expr("realized_minor div orders"))


@query(
    "g10_cod_rto",
    sql("""SELECT brand_id, currency_code, count(*) AS cod_orders, count(*) FILTER (WHERE terminal_class = 'rto') AS rto,
  count(*) FILTER (WHERE terminal_class = 'delivered') AS delivered, count(*) FILTER (WHERE terminal_class = 'rto') * 10000 // count(*) AS rto_bps,
  count(*) FILTER (WHERE terminal_class <> 'none' AND (order_id % 5 = 0) = (terminal_class = 'rto')) AS predicted_right,
  count(*) FILTER (WHERE terminal_class <> 'none' AND (order_id % 5 = 0) = (terminal_class = 'rto')) * 10000
    // nullif(count(*) FILTER (WHERE terminal_class <> 'none'), 0) AS accuracy_bps
  FROM o WHERE payment_method = 'cod' GROUP BY 1, 2"""),
)
def cod_rto(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cash-on-delivery outcomes and how often a risk flag was right; open orders are neither."""
    known = F.col("terminal_class") != "none"
    right = known & ((F.col("order_id") % 5 == 0) == (F.col("terminal_class") == "rto"))
    out = (
        orders(spark, sf_dir)
        .where(F.col("payment_method") == "cod")
        .groupBy("brand_id", "currency_code")
        .agg(
            F.count("*").alias("cod_orders"), F.count_if(F.col("terminal_class") == "rto").alias("rto"),
            F.count_if(F.col("terminal_class") == "delivered").alias("delivered"), F.count_if(right).alias("predicted_right"), F.count_if(known).alias("_known"),
        )
    )
    return out.withColumn("rto_bps", bps(F.col("rto"), F.col("cod_orders"))).withColumn("accuracy_bps", bps(F.col("predicted_right"), F.col("_known"))).drop("_known")


BUCKETS = [("0-1 days", 1), ("2-3 days", 3), ("4-7 days", 7), ("8-30 days", 30), ("over 30 days", None)]


@query(
    "g8_delivery_time",
    sql("""
, d AS (SELECT lo.courier, date_diff('day', CAST(placed_at AS DATE), CAST(shipped_at AS DATE)) AS days FROM lo WHERE return_flag <> 'R' AND shipped_at >= placed_at),
b(bucket_order, bucket, low, high) AS (VALUES (0, '0-1 days', 0, 1), (1, '2-3 days', 2, 3), (2, '4-7 days', 4, 7), (3, '8-30 days', 8, 30), (4, 'over 30 days', 31, 1000000))
SELECT c.courier, b.bucket_order, b.bucket, count(d.days) AS n FROM (SELECT DISTINCT courier FROM d) c CROSS JOIN b
LEFT JOIN d ON d.courier = c.courier AND d.days BETWEEN b.low AND b.high GROUP BY 1, 2, 3"""),
)
def delivery_time(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Delivery days by courier in five buckets, empty ones included."""
    o = orders(spark, sf_dir).select("order_id", "placed_at")
    l_ = lines(spark, sf_dir).where(F.col("return_flag") != "R").select("order_id", "courier", "shipped_at")
    days = l_.join(o, "order_id").where(F.col("shipped_at") >= F.col("placed_at")).select("courier", F.date_diff("shipped_at", "placed_at").alias("days"))
    return histogram(days, ["courier"], "days", BUCKETS)


@query(
    "s13_shipment",
    sql("""SELECT order_id, arg_max(line_status, (line_status = 'F', shipped_at, line_number, product_id, quantity, gross_minor)) AS status,
  bool_or(return_flag = 'R') AS is_rto, bool_or(line_status = 'F') AS is_terminal, min(shipped_at) AS first_at, max(shipped_at) AS last_at, count(*) AS moves
  FROM l GROUP BY 1"""),
)
def shipment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Terminal-first latest state of a shipment from its transitions."""
    terminal = F.col("line_status") == "F"
    return (
        lines(spark, sf_dir)
        .groupBy("order_id")
        .agg(
            F.max_by("line_status", F.struct(terminal, "shipped_at", "line_number", "product_id", "quantity", "gross_minor")).alias("status"),
            F.bool_or(F.col("return_flag") == "R").alias("is_rto"), F.bool_or(terminal).alias("is_terminal"),
            F.min("shipped_at").alias("first_at"), F.max("shipped_at").alias("last_at"), F.count("*").alias("moves"),
        )
    )


@query(
    "q_kpi_summary",
    sql("""SELECT brand_id, CAST(sum(amount_minor) FILTER (WHERE event_type = 'provisional_recognition') AS BIGINT) AS provisional_minor,
  CAST(coalesce(sum(amount_minor) FILTER (WHERE event_type <> 'provisional_recognition'), 0) AS BIGINT) AS realized_minor, count(DISTINCT order_id) AS orders,
  count(DISTINCT order_id) FILTER (WHERE event_type = 'cod_rto_clawback') AS rto_orders FROM r GROUP BY 1"""),
)
def kpi_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """KPI summary: provisional and realised revenue, orders, returns to origin, in one scan."""
    p = F.col("event_type") == "provisional_recognition"
    # Every order has exactly one provisional event and at most one clawback, so counts need no DISTINCT.
    return (
        ledger(spark, sf_dir)
        .groupBy("brand_id")
        .agg(
            total(F.when(p, F.col("signed_minor"))).alias("provisional_minor"), total(F.when(~p, F.col("signed_minor"))).alias("realized_minor"),
            F.count_if(p).alias("orders"), F.count_if(F.col("event_type") == "cod_rto_clawback").alias("rto_orders"),
        )
    )


@query(
    "q_revenue_timeseries",
    sql("""SELECT brand_id, CAST(date_trunc('week', effective_at) AS DATE) AS week, currency_code, CAST(sum(amount_minor) AS BIGINT) AS realized_minor, count(*) AS n
  FROM r WHERE event_type <> 'provisional_recognition' GROUP BY 1, 2, 3"""),
)
def revenue_timeseries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weekly realised revenue by currency."""
    events = ledger(spark, sf_dir).where(F.col("event_type") != "provisional_recognition")
    return events.groupBy("brand_id", F.date_trunc("week", "effective_at").cast("date").alias("week"), "currency_code").agg(
        total("signed_minor").alias("realized_minor"), F.count("*").alias("n")
    )


@query(
    "q_recognition_breakdown",
    sql("""SELECT event_type, CASE event_type WHEN 'provisional_recognition' THEN 1 WHEN 'finalization' THEN 2 WHEN 'cod_delivery_confirmed' THEN 3 ELSE 4 END AS position,
  count(*) AS n, CAST(sum(amount_minor) AS BIGINT) AS amount_minor FROM r WHERE brand_id = 'b1' GROUP BY 1, 2"""),
)
def recognition_breakdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One tenant's ledger by event in a fixed order."""
    place = F.when(F.col("event_type") == "provisional_recognition", 1).when(F.col("event_type") == "finalization", 2).when(F.col("event_type") == "cod_delivery_confirmed", 3)
    return (
        recognise(orders(spark, sf_dir).where(F.col("brand_id") == "b1"), as_of=AS_OF)
        .groupBy("event_type", place.otherwise(4).alias("position"))
        .agg(F.count("*").alias("n"), total("signed_minor").alias("amount_minor"))
    )


@query(
    "q_order_status_mix",
    sql("""SELECT brand_id, state, count(*) AS n, count(*) * 10000 // CAST(sum(count(*)) OVER (PARTITION BY brand_id) AS BIGINT) AS share_bps FROM os GROUP BY 1, 2"""),
)
def order_status_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shares of order states by tenant."""
    n = states(spark, sf_dir).groupBy("brand_id", "state").agg(F.count("*").alias("n"))
    return n.withColumn("share_bps", bps(F.col("n"), F.sum("n").over(Window.partitionBy("brand_id"))))


@query(
    "q_realized_gmv_period",
    sql("""SELECT brand_id, currency_code, CAST(sum(amount_minor) AS BIGINT) AS realized_minor, count(DISTINCT order_id) AS orders FROM r
  WHERE event_type <> 'provisional_recognition' AND effective_at >= TIMESTAMP '1999-01-01' AND effective_at < TIMESTAMP '1999-04-01' GROUP BY 1, 2"""),
)
def realized_gmv_period(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Realised value of a billing period, end excluded."""
    at = F.col("effective_at")
    inside = (at >= F.lit("1999-01-01").cast("timestamp")) & (at < F.lit("1999-04-01").cast("timestamp"))
    events = ledger(spark, sf_dir).where((F.col("event_type") != "provisional_recognition") & inside)
    return events.groupBy("brand_id", "currency_code").agg(total("signed_minor").alias("realized_minor"), F.count_distinct("order_id").alias("orders"))


@query(
    "q_gmv_composition",
    sql("""SELECT brand_id, event_type, currency_code, CAST(sum(amount_minor) AS BIGINT) AS amount_minor FROM r
  WHERE CAST(effective_at AS DATE) <= DATE '1997-06-30' AND event_type <> 'provisional_recognition' GROUP BY 1, 2, 3"""),
)
def gmv_composition(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Realised revenue by event and currency as of a day inside the data."""
    return composition(ledger(spark, sf_dir), "1997-06-30")
