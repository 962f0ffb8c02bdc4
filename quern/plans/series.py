"""Series of orders, attributed amounts and campaigns without gaps, and the journey, spend and customer views."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.functions import scalars as R
from quern.operators.series import filled
from quern.plans import customers as C
from quern.plans import folds
from quern.plans import journeys as J
from quern.plans.catalogue import ORACLES, query
from quern.plans.shop import AS_OF, orders, sql, touches


def filled_sql(rows: str, keys: str, at: str, values: str, names: str, step: str = "1 DAY") -> str:
    """The oracle of ``filled``: ``rows`` with a date ``at``; ``values`` are aggregates with aliases, ``names`` those aliases made 0 where null."""
    return f"""
, sr AS ({rows}), se AS (SELECT {keys}, {at}, {values} FROM sr GROUP BY ALL),
st AS (SELECT {keys}, CAST(unnest(generate_series(CAST(min({at}) AS TIMESTAMP), CAST(max({at}) AS TIMESTAMP), INTERVAL {step})) AS DATE) AS {at} FROM se GROUP BY {keys})
SELECT {", ".join("st." + k.strip() for k in keys.split(","))}, st.{at}, {names} FROM st LEFT JOIN se ON {" AND ".join(f"se.{k.strip()} = st.{k.strip()}" for k in [*keys.split(","), at])}"""


@query(
    "q_orders_timeseries",
    sql(filled_sql(
        "SELECT brand_id, CAST(date_trunc('month', placed_at) AS DATE) AS month, amount_minor, is_cancelled FROM o", "brand_id", "month",
        "count(*) AS orders, count(*) FILTER (WHERE is_cancelled) AS cancelled, CAST(sum(amount_minor) AS BIGINT) AS amount_minor",
        "coalesce(orders, 0) AS orders, coalesce(cancelled, 0) AS cancelled, coalesce(se.amount_minor, 0) AS amount_minor", "1 MONTH")),
)
def orders_timeseries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders placed by month, months without orders included."""
    rows = orders(spark, sf_dir).withColumn("month", F.trunc("placed_at", "month"))
    return filled(rows, ["brand_id"], "month", {"orders": F.count("*"), "cancelled": F.count_if("is_cancelled"), "amount_minor": F.sum("amount_minor")}, "1 month")


@query(
    "q_attributed_timeseries",
    sql(J.JOURNEY_SQL + filled_sql(
        "SELECT brand_id, channel, CAST(bought_at AS DATE) AS day, credit_minor FROM cr WHERE model = 'linear'", "brand_id, channel", "day",
        "CAST(sum(credit_minor) AS BIGINT) AS attributed_minor, count(*) AS touches", "coalesce(attributed_minor, 0) AS attributed_minor, coalesce(touches, 0) AS touches")),
)
def attributed_timeseries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Linear credits by channel and day of purchase."""
    rows = J.credited(spark, sf_dir).where(F.col("model") == "linear").withColumn("day", F.to_date("bought_at"))
    return filled(rows, ["brand_id", "channel"], "day", {"attributed_minor": F.sum("credit_minor"), "touches": F.count("*")})


@query(
    "q_campaign_timeseries",
    sql(filled_sql(
        "SELECT brand_id, k % 7 AS campaign_id, CAST(seen_at AS DATE) AS day, event_type, value_minor FROM e WHERE event_type IN ('click', 'purchase')", "brand_id, campaign_id", "day",
        "CAST(sum(value_minor) FILTER (WHERE event_type = 'click') AS BIGINT) AS spend_minor, count(*) FILTER (WHERE event_type = 'purchase') AS purchases",
        "coalesce(spend_minor, 0) AS spend_minor, coalesce(purchases, 0) AS purchases")),
)
def campaign_timeseries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spend and purchases of a campaign by day."""
    of = lambda t: F.col("event_type") == t
    rows = touches(spark, sf_dir).where(F.col("event_type").isin("click", "purchase")).withColumn("campaign_id", F.col("k") % 7).withColumn("day", F.to_date("seen_at"))
    return filled(rows, ["brand_id", "campaign_id"], "day", {"spend_minor": F.sum(F.when(of("click"), F.col("value_minor"))), "purchases": F.count_if(of("purchase"))})


@query(
    "v_semantic_journey",
    sql("""SELECT brand_id, visitor_id, count(*) AS touches, max(session_seq) AS sessions, arg_min(channel, touch_seq) AS first_channel, arg_max(channel, touch_seq) AS last_channel, min(seen_at) AS first_seen_at, max(seen_at) AS last_seen_at,
  bool_or(event_type = 'purchase') AS converted, CAST(sum(CASE WHEN event_type = 'purchase' THEN value_minor ELSE 0 END) AS BIGINT) AS revenue_minor FROM s GROUP BY 1, 2"""),
)
def semantic_journey(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The journey entity of the semantic layer: one row a visitor."""
    bought = F.col("event_type") == "purchase"
    return J.sessions(spark, sf_dir).groupBy("brand_id", "visitor_id").agg(
        F.count("*").alias("touches"), F.max("session_seq").alias("sessions"), F.min_by("channel", "touch_seq").alias("first_channel"), F.max_by("channel", "touch_seq").alias("last_channel"),
        F.min("seen_at").alias("first_seen_at"), F.max("seen_at").alias("last_seen_at"), F.bool_or(bought).alias("converted"), F.sum(F.when(bought, F.col("value_minor")).otherwise(0)).alias("revenue_minor"),
    )


@query(
    "v_measurement_spend",
    f"""SELECT brand_id, platform, campaign_id, stat_date, count(*) AS facts, CAST(sum(spend_minor) AS BIGINT) AS spend_minor, CAST(sum(impressions) AS BIGINT) AS impressions, CAST(sum(clicks) AS BIGINT) AS clicks
FROM ({ORACLES["s17_spend_facts"]}) GROUP BY 1, 2, 3, 4""",
)
def measurement_spend(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spend as measured: facts summed by campaign and day."""
    whole = lambda c: F.sum(c).cast("bigint").alias(c)
    return folds.spend_facts(spark, sf_dir).groupBy("brand_id", "platform", "campaign_id", "stat_date").agg(F.count("*").alias("facts"), whole("spend_minor"), whole("impressions"), whole("clicks"))


@query(
    "v_customer_health",
    f"""SELECT brand_id, customer_id, health_score, health_band, lifecycle_stage, recency_days, orders, value_minor FROM ({ORACLES["g17_customer_360"]}) WHERE recency_days IS NOT NULL""",
)
def customer_health(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Health of the customers that have a last order."""
    profile = C.customer_360(spark, sf_dir).where(F.col("recency_days").isNotNull())
    return profile.select(*C.WHO, "health_score", "health_band", "lifecycle_stage", "recency_days", "orders", "value_minor")


@query(
    "v_customer_scores",
    f"""SELECT p.brand_id, p.customer_id, DATE '{AS_OF}' AS scored_on, p.orders AS lifetime_orders, p.value_minor AS lifetime_value_minor, p.recency_days AS days_since_last_order,
  recency_score, frequency_score, monetary_score, risk AS churn_risk, CASE risk WHEN 'low' THEN 15 WHEN 'medium' THEN 55 ELSE 85 END AS churn_score, segment, 'live' AS data_source
FROM (SELECT *, CASE WHEN recency_days > 180 THEN 'high' WHEN recency_days > 90 THEN 'medium' ELSE 'low' END AS risk FROM ({ORACLES["g17_customer_360"]})) p
JOIN ({ORACLES["g17_rfm_scores"]}) r ON r.brand_id = p.brand_id AND r.customer_id = p.customer_id""",
)
def customer_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores, churn risk and segment of each customer, with the day they hold for; one pass over the customers' facts."""
    recency = F.col("recency_days")
    rows = C.facts(spark, sf_dir).select("*", *C.rfm_columns(), R.churn_risk(recency).alias("churn_risk"), R.lifecycle_segment(recency, F.col("orders"), F.col("value_minor")).alias("segment"))
    return rows.select(
        *C.WHO, F.lit(AS_OF).cast("date").alias("scored_on"), F.col("orders").alias("lifetime_orders"), F.col("value_minor").alias("lifetime_value_minor"), recency.alias("days_since_last_order"),
        "recency_score", "frequency_score", "monetary_score", "churn_risk", R.churn_score(F.col("churn_risk")).alias("churn_score"), "segment", F.lit("live").alias("data_source"),
    )


@query("v_journey_events_current", f"""SELECT * FROM ({ORACLES["g37_journey_ledger"]}) WHERE is_current""")
def journey_events_current(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the journey ledger that no later version has replaced."""
    return folds.journey_ledger(spark, sf_dir).where("is_current")
