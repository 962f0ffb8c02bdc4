"""Customers: cohorts, retention, segments, health, profiles and features, bound to ``orders``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quern.functions import scalars as R
from quern.operators import marts as M
from quern.plans.catalogue import query
from quern.plans.journeys import spend
from quern.plans.revenue import states, total
from quern.plans.shop import AS_OF, lines, orders, sql

WHO = ["brand_id", "customer_id"]


def facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per customer: orders, realised value, first and last order, days since the last."""
    last = F.max("placed_at")
    return (
        states(spark, sf_dir)
        .groupBy(*WHO)
        .agg(
            F.count("*").alias("orders"), total("realized_minor").alias("value_minor"), F.min("placed_at").alias("first_at"), last.alias("last_at"),
            F.date_diff(F.lit(AS_OF).cast("date"), last).cast("bigint").alias("recency_days"),
        )
    )


def members(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.cohort_members(states(spark, sf_dir), ["brand_id"], "customer_id", "placed_at", "realized_minor")


MEMBER_SQL = """
, fo AS (SELECT *, min(placed_at) OVER (PARTITION BY customer_id) AS first_at FROM os),
cm AS (SELECT brand_id, customer_id, strftime(first_at, '%Y-%m') AS cohort_month,
  CAST((year(placed_at) * 12 + month(placed_at)) - (year(first_at) * 12 + month(first_at)) AS INTEGER) AS period_index, count(*) AS orders,
  CAST(sum(realized_minor) AS BIGINT) AS amount_minor FROM fo GROUP BY 1, 2, 3, 4)
"""


@query("g5_cohort_member", sql(MEMBER_SQL + "SELECT * FROM cm"))
def cohort_member(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Activity of each customer by months since the first order."""
    return members(spark, sf_dir)


@query(
    "g4_cohorts",
    sql(MEMBER_SQL + """SELECT brand_id, cohort_month, count(DISTINCT customer_id) AS customers, CAST(sum(orders) AS BIGINT) AS orders, CAST(sum(amount_minor) AS BIGINT) AS amount_minor
  FROM cm GROUP BY 1, 2"""),
)
def cohorts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Acquisition-month cohorts."""
    return M.cohort_sizes(members(spark, sf_dir), ["brand_id"], "customer_id")


@query(
    "g6_retention",
    sql(MEMBER_SQL + """, ea AS (SELECT brand_id, cohort_month, customer_id, sum(orders) AS n, max(period_index) AS last FROM cm GROUP BY 1, 2, 3)
SELECT brand_id, cohort_month, count(*) AS customers, count(*) FILTER (WHERE n >= 2) AS repeaters, count(*) FILTER (WHERE last >= 1) AS returning, CAST(sum(n) AS BIGINT) AS orders,
  count(*) FILTER (WHERE n >= 2) * 10000 // count(*) AS repeat_bps, count(*) FILTER (WHERE last >= 1) * 10000 // count(*) AS returning_bps,
  CAST(sum(n) AS BIGINT) * 100 // count(*) AS avg_orders_x100 FROM ea GROUP BY 1, 2"""),
)
def retention(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Repeat and returning rates by cohort, integer basis points."""
    return M.retention(members(spark, sf_dir), ["brand_id"], "customer_id")


LATENCY = [("0-30", 30), ("31-60", 60), ("61-90", 90), ("91-180", 180), ("181-365", 365), ("over 365", None)]
LATENCY_SQL = """
, nn AS (SELECT brand_id, customer_id, placed_at, row_number() OVER (PARTITION BY customer_id ORDER BY placed_at, order_id) AS i FROM o),
gp AS (SELECT a.brand_id, date_diff('day', CAST(a.placed_at AS DATE), CAST(b.placed_at AS DATE)) AS days FROM nn a JOIN nn b ON a.customer_id = b.customer_id AND a.i = 1 AND b.i = 2)
"""


@query(
    "g7_repeat_latency",
    sql(LATENCY_SQL + """, b(bucket_order, bucket, low, high) AS (VALUES (0, '0-30', 0, 30), (1, '31-60', 31, 60), (2, '61-90', 61, 90), (3, '91-180', 91, 180), (4, '181-365', 181, 365), (5, 'over 365', 366, 1000000))
SELECT c.brand_id, b.bucket_order, b.bucket, count(days) AS n FROM (SELECT DISTINCT brand_id FROM gp) c CROSS JOIN b LEFT JOIN gp ON gp.brand_id = c.brand_id AND days BETWEEN low AND high GROUP BY 1, 2, 3"""),
)
def repeat_latency(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Days from first to second order in six buckets, empty ones included."""
    gaps = M.nth_gap_days(orders(spark, sf_dir), WHO, "placed_at", "order_id")
    return M.histogram(gaps, ["brand_id"], "days", LATENCY)


@query("g7_repeat_latency_median", sql(LATENCY_SQL + "SELECT brand_id, count(*) AS customers, median(days) AS median_days FROM gp GROUP BY 1"))
def repeat_latency_median(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact median of the gap."""
    gaps = M.nth_gap_days(orders(spark, sf_dir), WHO, "placed_at", "order_id")
    return gaps.groupBy("brand_id").agg(F.count("*").alias("customers"), F.percentile("days", F.lit(0.5)).alias("median_days"))


@query(
    "g9_cac",
    sql("""SELECT coalesce(n.brand_id, p.brand_id) AS brand_id, coalesce(n.month, p.month) AS month, coalesce(new_customers, 0) AS new_customers, coalesce(spend_minor, 0) AS spend_minor,
  spend_minor // nullif(new_customers, 0) AS cac_minor FROM
  (SELECT brand_id, strftime(first_at, '%m') AS month, count(*) AS new_customers FROM cf GROUP BY 1, 2) n FULL OUTER JOIN
  (SELECT brand_id, strftime(seen_at, '%m') AS month, CAST(sum(value_minor) AS BIGINT) AS spend_minor FROM e WHERE event_type = 'click' GROUP BY 1, 2) p
  ON n.brand_id = p.brand_id AND n.month = p.month"""),
)
def cac(spark: SparkSession, sf_dir: str) -> DataFrame:
    """New customers beside campaign spend by month; integer cost of one."""
    n = facts(spark, sf_dir).groupBy("brand_id", F.date_format("first_at", "MM").alias("month")).agg(F.count("*").alias("new_customers"))
    p = spend(spark, sf_dir).groupBy("brand_id", F.date_format("day", "MM").alias("month")).agg(total("spend_minor").alias("spend_minor"))
    zero = F.lit(0).cast("bigint")
    out = n.join(p, ["brand_id", "month"], "full_outer")
    ratio = F.expr("spend_minor div nullif(new_customers, 0L)").alias("cac_minor")
    return out.select("brand_id", "month", F.coalesce("new_customers", zero).alias("new_customers"), F.coalesce("spend_minor", zero).alias("spend_minor"), ratio)


TIER_SQL = "CASE WHEN value_minor >= 100000 THEN 'high_value' WHEN value_minor >= 50000 THEN 'mid_value' WHEN value_minor > 0 THEN 'low_value' ELSE 'no_realized_value' END"
SEGMENT_SQL = """CASE WHEN recency_days > 180 THEN 'churned' WHEN recency_days > 90 THEN 'at_risk'
  WHEN value_minor >= 10000000 AND orders >= 5 AND recency_days <= 60 THEN 'VIP' WHEN orders >= 5 AND recency_days <= 90 THEN 'loyal' WHEN value_minor >= 5000000 THEN 'high_value'
  WHEN orders = 1 AND value_minor > 0 THEN 'first_time_buyer' WHEN value_minor = 0 THEN 'cart_abandoner' ELSE 'window_shopper' END"""


@query(
    "g16_customer_segments",
    sql(f"""SELECT brand_id, 'value_tier' AS segment_type, {TIER_SQL} AS segment, count(*) AS customers, CAST(sum(value_minor) AS BIGINT) AS value_minor FROM cf GROUP BY 1, 3
  UNION ALL SELECT brand_id, 'lifecycle', {SEGMENT_SQL}, count(*), CAST(sum(value_minor) AS BIGINT) FROM cf GROUP BY 1, 3"""),
)
def customer_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers by value tier and by lifecycle segment, in one pass over them."""
    tier = R.value_tier(F.col("value_minor"))
    life = R.lifecycle_segment(F.col("recency_days"), F.col("orders"), F.col("value_minor"))
    both = F.array(*[F.struct(F.lit(t).alias("segment_type"), c.alias("segment")) for t, c in (("value_tier", tier), ("lifecycle", life))])
    rows = facts(spark, sf_dir).select("brand_id", "value_minor", F.inline(both))
    return rows.groupBy("brand_id", "segment_type", "segment").agg(F.count("*").alias("customers"), total("value_minor").alias("value_minor"))


HEALTH_SQL = """CAST(CASE WHEN recency_days <= 30 THEN 60 WHEN recency_days <= 60 THEN 45 WHEN recency_days <= 90 THEN 30 WHEN recency_days <= 180 THEN 15 ELSE 0 END
  + CASE WHEN orders >= 10 THEN 40 WHEN orders >= 5 THEN 30 WHEN orders >= 3 THEN 20 WHEN orders >= 2 THEN 10 ELSE 5 END AS INTEGER)"""
BAND_SQL = "CASE WHEN recency_days <= 90 THEN 'healthy' WHEN recency_days <= 180 THEN 'at_risk' ELSE 'churned' END"


@query(
    "g17_customer_360",
    sql(f"""
, md AS (SELECT customer_id, priority, row_number() OVER (PARTITION BY customer_id ORDER BY count(*) DESC, priority) AS i FROM o GROUP BY 1, 2),
sc AS (SELECT customer_id, count(*) FILTER (WHERE state = 'delivered') AS delivered, count(*) FILTER (WHERE state = 'rto') AS rto, count(*) FILTER (WHERE state = 'cancelled') AS cancelled FROM os GROUP BY 1),
tl AS (SELECT customer_id, string_agg(strftime(placed_at, '%Y-%m-%d') || ':' || state, ',' ORDER BY placed_at DESC, order_id DESC) AS timeline
  FROM (SELECT *, row_number() OVER (PARTITION BY customer_id ORDER BY placed_at DESC, order_id DESC) AS i FROM os) WHERE i <= 5 GROUP BY 1)
SELECT brand_id, cf.customer_id, orders, value_minor, value_minor // orders AS aov_minor, recency_days, priority AS top_priority, delivered, rto, cancelled,
  {HEALTH_SQL} AS health_score, {BAND_SQL} AS health_band,
  CASE WHEN recency_days > 180 THEN 'churned' WHEN recency_days > 90 THEN 'at_risk' WHEN orders <= 1 THEN 'new' ELSE 'active' END AS lifecycle_stage, {SEGMENT_SQL} AS segment, timeline
FROM cf JOIN md ON md.customer_id = cf.customer_id AND md.i = 1 JOIN sc ON sc.customer_id = cf.customer_id JOIN tl ON tl.customer_id = cf.customer_id"""),
)
def customer_360(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The customer profile, from one shuffle of order states and one of orders' attributes."""
    st = states(spark, sf_dir)
    newest = Window.partitionBy(*WHO).orderBy(F.desc("placed_at"), F.desc("order_id"))
    item = F.when(F.col("_i") <= 5, F.struct("_i", F.concat_ws(":", F.date_format("placed_at", "yyyy-MM-dd"), "state").alias("t")))
    of = lambda s: F.count_if(F.col("state") == s).alias(s)
    profile = (
        st.withColumn("_i", F.row_number().over(newest))
        .groupBy(*WHO)
        .agg(
            F.count("*").alias("orders"), total("realized_minor").alias("value_minor"), F.date_diff(F.lit(AS_OF).cast("date"), F.max("placed_at")).cast("bigint").alias("recency_days"),
            of("delivered"), of("rto"), of("cancelled"), F.array_join(F.transform(F.array_sort(F.collect_list(item)), lambda x: x["t"]), ",").alias("timeline"),
        )
    )
    top = M.mode(orders(spark, sf_dir), WHO, "priority", "top_priority")
    band = R.health_band(F.col("recency_days"))
    return (
        profile.join(top, WHO, "left")
        .withColumn("aov_minor", R.quotient(F.col("value_minor"), F.col("orders")))
        .withColumn("health_score", R.health_score(F.col("recency_days"), F.col("orders")))
        .withColumn("health_band", band)
        .withColumn("lifecycle_stage", R.lifecycle_stage(F.col("health_band"), F.col("orders")))
        .withColumn("segment", R.lifecycle_segment(F.col("recency_days"), F.col("orders"), F.col("value_minor")))
    )



def _score(value: Column, steps: list[int], down: bool) -> Column:
    out = F.lit(1)
    for points, step in zip(range(2, 6), reversed(steps) if down else steps, strict=True):
        out = F.when(value <= step if down else value >= step, points).otherwise(out)
    return out


def rfm_columns() -> list[Column]:
    """Recency, frequency and monetary scores of rows with recency_days, orders and value_minor."""
    return [
        _score(F.col("recency_days"), [30, 60, 90, 180], True).alias("recency_score"),
        _score(F.col("orders"), [2, 3, 5, 10], False).alias("frequency_score"),
        _score(F.col("value_minor"), [200_000, 1_000_000, 5_000_000, 10_000_000], False).alias("monetary_score"),
    ]


@query(
    "g17_rfm_scores",
    sql("""SELECT brand_id, customer_id, CASE WHEN recency_days <= 30 THEN 5 WHEN recency_days <= 60 THEN 4 WHEN recency_days <= 90 THEN 3 WHEN recency_days <= 180 THEN 2 ELSE 1 END AS recency_score,
  CASE WHEN orders >= 10 THEN 5 WHEN orders >= 5 THEN 4 WHEN orders >= 3 THEN 3 WHEN orders >= 2 THEN 2 ELSE 1 END AS frequency_score,
  CASE WHEN value_minor >= 10000000 THEN 5 WHEN value_minor >= 5000000 THEN 4 WHEN value_minor >= 1000000 THEN 3 WHEN value_minor >= 200000 THEN 2 ELSE 1 END AS monetary_score FROM cf"""),
)
def rfm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recency, frequency and monetary scores from 1 to 5."""
    return facts(spark, sf_dir).select(*WHO, *rfm_columns())


@query(
    "g18_ai_features",
    sql("""SELECT brand_id, customer_id, count(*) AS orders, count(DISTINCT strftime(placed_at, '%Y-%m')) AS active_months, CAST(sum(amount_minor) AS BIGINT) AS amount_minor,
  CAST(max(amount_minor) AS BIGINT) AS largest_minor, count(*) FILTER (WHERE payment_method = 'cod') * 10000 // count(*) AS cod_bps,
  date_diff('day', CAST(min(placed_at) AS DATE), CAST(max(placed_at) AS DATE)) // nullif(count(*) - 1, 0) AS cadence_days FROM o GROUP BY 1, 2"""),
)
def ai_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numeric features of each customer."""
    out = (
        orders(spark, sf_dir)
        .groupBy(*WHO)
        .agg(
            F.count("*").alias("orders"), F.size(F.collect_set(F.date_format("placed_at", "yyyy-MM"))).cast("bigint").alias("active_months"), total("amount_minor").alias("amount_minor"),
            F.max("amount_minor").alias("largest_minor"), R.bps(F.count_if(F.col("payment_method") == "cod"), F.count("*")).alias("cod_bps"),
            F.date_diff(F.max("placed_at"), F.min("placed_at")).cast("bigint").alias("_d"),
        )
    )
    return out.withColumn("cadence_days", F.expr("_d div nullif(orders - 1, 0L)")).drop("_d")


@query(
    "g19_recommendation_features",
    sql("""
, pp AS (SELECT customer_id, product_id, row_number() OVER (PARTITION BY customer_id ORDER BY count(*) DESC, product_id) AS i, count(*) AS n, CAST(sum(count(*)) OVER (PARTITION BY customer_id) AS BIGINT) AS t FROM lo GROUP BY 1, 2),
cc AS (SELECT customer_id, courier, row_number() OVER (PARTITION BY customer_id ORDER BY count(*) DESC, courier) AS i FROM lo GROUP BY 1, 2),
dd AS (SELECT brand_id, customer_id, CAST(sum(discount_minor) AS BIGINT) * 10000 // nullif(CAST(sum(gross_minor) AS BIGINT), 0) AS discount_bps FROM lo GROUP BY 1, 2)
SELECT brand_id, dd.customer_id, product_id AS top_product, n * 10000 // t AS affinity_bps, courier AS top_courier, discount_bps
FROM dd JOIN pp ON pp.customer_id = dd.customer_id AND pp.i = 1 JOIN cc ON cc.customer_id = dd.customer_id AND cc.i = 1"""),
)
def recommendation_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Most bought product and its share, most frequent courier, discount share."""
    rows = order_lines(spark, sf_dir)
    n = rows.groupBy(*WHO, "product_id").agg(F.count("*").alias("n"))
    top = n.groupBy(*WHO).agg(F.min_by(F.struct("product_id", "n"), F.struct(-F.col("n"), F.col("product_id"))).alias("_p"), F.sum("n").alias("_t"))
    top = top.select(*WHO, F.col("_p.product_id").alias("top_product"), R.bps(F.col("_p.n"), F.col("_t")).alias("affinity_bps"))
    courier = M.mode(rows, WHO, "courier", "top_courier")
    share = rows.groupBy(*WHO).agg(R.bps(F.sum("discount_minor"), F.sum("gross_minor")).alias("discount_bps"))
    return share.join(top, WHO).join(courier, WHO)


def order_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = orders(spark, sf_dir).select("order_id", "brand_id", "customer_id", "placed_at", "currency_code")
    return lines(spark, sf_dir).join(o, "order_id")


@query("q_segment_members", sql(f"SELECT customer_id, orders, value_minor FROM cf WHERE brand_id = 'b0' AND {SEGMENT_SQL} = 'at_risk' ORDER BY value_minor DESC, customer_id LIMIT 25"))
def segment_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A saved segment's first members by value."""
    seg = R.lifecycle_segment(F.col("recency_days"), F.col("orders"), F.col("value_minor"))
    rows = facts(spark, sf_dir).where((F.col("brand_id") == "b0") & (seg == "at_risk"))
    return rows.orderBy(F.desc("value_minor"), "customer_id").limit(25).select("customer_id", "orders", "value_minor")


@query(
    "q_customer_orders_page",
    sql("""SELECT order_id, strftime(placed_at, '%Y-%m-%d') AS placed_on, amount_minor FROM o WHERE brand_id = 'b0' AND (placed_at, order_id) < (TIMESTAMP '1999-06-01', 0)
  ORDER BY placed_at DESC, order_id DESC LIMIT 26"""),
)
def customer_orders_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A keyset page of orders with a look-ahead row."""
    cursor = F.struct(F.lit("1999-06-01").cast("timestamp").alias("placed_at"), F.lit(0).cast("bigint").alias("order_id"))
    rows = orders(spark, sf_dir).where((F.col("brand_id") == "b0") & (F.struct("placed_at", "order_id") < cursor))
    return rows.orderBy(F.desc("placed_at"), F.desc("order_id")).limit(26).select("order_id", F.date_format("placed_at", "yyyy-MM-dd").alias("placed_on"), "amount_minor")


@query(
    "q_orders_list",
    sql("""SELECT o.order_id, o.amount_minor, coalesce(c.n_lines, 0) AS n_lines, coalesce(c.gross_minor, 0) AS gross_minor FROM o LEFT JOIN
  (SELECT order_id, count(*) AS n_lines, CAST(sum(gross_minor) AS BIGINT) AS gross_minor FROM l GROUP BY 1) c USING (order_id) WHERE o.brand_id = 'b2' ORDER BY o.placed_at DESC, o.order_id DESC LIMIT 50 OFFSET 50"""),
)
def orders_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page of orders with line figures: the page is cut first, then only its orders' lines are summed."""
    page = orders(spark, sf_dir).where(F.col("brand_id") == "b2").orderBy(F.desc("placed_at"), F.desc("order_id")).offset(50).limit(50)
    page = page.select("order_id", "amount_minor")
    n = lines(spark, sf_dir).join(F.broadcast(page.select("order_id")), "order_id", "left_semi").groupBy("order_id").agg(F.count("*").alias("n_lines"), total("gross_minor").alias("gross_minor"))
    zero = F.lit(0).cast("bigint")
    return page.join(n, "order_id", "left").select("order_id", "amount_minor", F.coalesce("n_lines", zero).alias("n_lines"), F.coalesce("gross_minor", zero).alias("gross_minor"))
