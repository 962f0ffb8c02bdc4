"""The whole customer profile, bound to orders, their lines and the events of their visitors."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.operators import journeystitch as S
from quern.operators import profile as P
from quern.operators import silver as V
from quern.operators.identity import identifier_hash
from quern.plans import journeys as J
from quern.plans.catalogue import query
from quern.plans.folds import NODE_SQL, brand, nodes, text
from quern.plans.revenue import ledger, states
from quern.plans.shop import AS_OF, lines, sql
from quern.session import table


def profile_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order states with the profile that each order's customer has, if any, and the hour of their arrival."""
    arrived = F.col("last_at") + F.make_dt_interval(F.lit(0), (F.col("order_id") % 24).cast("int"))
    return states(spark, sf_dir).select("*", F.when(F.col("customer_id") % 5 != 0, F.col("customer_id")).alias("profile_id"), arrived.alias("ingested_at"))


def profile_touches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Touches with the profile that their visitor was stitched to: some visitors share one, some have none."""
    v, k = F.col("visitor_id"), F.col("k")
    owner = F.when(v % 12 == 0, F.expr("visitor_id div 2")).when(v % 4 != 0, v)
    return J.sessions(spark, sf_dir).select(
        "brand_id", owner.alias("profile_id"), v, F.col("seen_at").alias("occurred_at"), "touch_seq", "event_type", F.when(k % 10 != 9, F.col("channel")).alias("channel"), F.when(F.col("event_type") == "view", "product").alias("page_type"),
        F.when((F.col("event_type") == "view") & (k % 2 == 0), F.concat(F.lit("p-"), text(k))).alias("product_handle"), F.when(F.col("event_type") == "purchase", text(k * 4)).alias("order_id"), (F.col("touch_seq") == 1).alias("is_first_touch"),
    )


def page_views(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("k")
    device = F.when(k % 7 == 0, "").otherwise(F.concat(F.lit("d"), text(k % 3)))
    return J.touches(spark, sf_dir).where(F.col("event_type") == "view").select("brand_id", "visitor_id", device.alias("device"))


def titled_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = F.col("product_id")
    owner = profile_states(spark, sf_dir).select("brand_id", "order_id")
    return lines(spark, sf_dir).join(owner, "order_id").select("brand_id", "order_id", F.when(part % 6 != 0, F.concat(F.lit("t"), text(part % 6))).alias("title"))


def identity_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bands of the identity map: every tenth profile has a closed one too, some have no live one left."""
    c, closed = F.col("c_custkey"), F.lit("2000-01-01").cast("timestamp")
    band = lambda current, to: F.struct(current.alias("is_current"), to.cast("timestamp").alias("system_to"))
    bands = F.array_compact(F.array(band(c % 28 != 0, F.when(c % 33 == 0, closed)), F.when(c % 10 == 0, band(F.lit(False), closed))))
    return table(spark, sf_dir, "customer").select(brand("c_custkey"), c.alias("profile_id"), F.inline(bands))


PROFILE_SQL = NODE_SQL + """
, ps AS (SELECT *, CASE WHEN customer_id % 5 <> 0 THEN customer_id END AS profile_id, last_at + to_hours(order_id % 24) AS ingested_at FROM os),
sp AS (SELECT brand_id, profile_id, count(order_id) AS lifetime_orders, CAST(sum(amount_minor) AS BIGINT) AS lifetime_value_minor, max(currency_code) AS currency_code, min(placed_at) AS first_seen_at, max(last_at) AS last_seen_at, max(ingested_at) AS customer_watermark,
  count(*) FILTER (WHERE state = 'delivered') AS delivered_orders, count(*) FILTER (WHERE state = 'rto') AS rto_orders, count(*) FILTER (WHERE state = 'cancelled') AS cancelled_orders, count(*) FILTER (WHERE state = 'refunded') AS refunded_orders,
  count(DISTINCT order_id) AS frequency, max(placed_at) AS last_order_at FROM ps WHERE profile_id IS NOT NULL GROUP BY 1, 2),
tp AS (SELECT brand_id, CASE WHEN visitor_id % 12 = 0 THEN visitor_id // 2 WHEN visitor_id % 4 <> 0 THEN visitor_id END AS profile_id, visitor_id, seen_at, touch_seq, event_type, CASE WHEN k % 10 <> 9 THEN channel END AS channel,
  CASE WHEN event_type = 'view' THEN 'product' END AS page_type, CASE WHEN event_type = 'view' AND k % 2 = 0 THEN 'p-' || CAST(k AS VARCHAR) END AS product_handle, CASE WHEN event_type = 'purchase' THEN CAST(k * 4 AS VARCHAR) END AS order_id, touch_seq = 1 AS is_first_touch FROM s),
tk AS (SELECT * FROM tp WHERE profile_id IS NOT NULL),
pc AS (SELECT brand_id, profile_id, channel, row_number() OVER (PARTITION BY brand_id, profile_id ORDER BY count(*) DESC, channel) AS i FROM tk WHERE channel <> '' GROUP BY 1, 2, 3),
ac AS (SELECT brand_id, profile_id, channel, row_number() OVER (PARTITION BY brand_id, profile_id ORDER BY is_first_touch DESC, seen_at, channel) AS i FROM tk WHERE channel <> ''),
ls AS (SELECT brand_id, profile_id, max(seen_at) AS at FROM tk GROUP BY 1, 2),
dv AS (SELECT b.brand_id, b.profile_id, 'd' || CAST(k % 3 AS VARCHAR) AS device, row_number() OVER (PARTITION BY b.brand_id, b.profile_id ORDER BY count(*) DESC, device) AS i
  FROM e JOIN (SELECT DISTINCT brand_id, visitor_id, profile_id FROM tk) b ON b.brand_id = e.brand_id AND b.visitor_id = e.visitor_id WHERE event_type = 'view' AND k % 7 <> 0 GROUP BY 1, 2, 3),
tc AS (SELECT ps.brand_id, ps.profile_id, 't' || CAST(product_id % 6 AS VARCHAR) AS title, row_number() OVER (PARTITION BY ps.brand_id, ps.profile_id ORDER BY count(*) DESC, title) AS i
  FROM l JOIN ps ON ps.order_id = l.order_id WHERE ps.profile_id IS NOT NULL AND product_id % 6 <> 0 GROUP BY 1, 2, 3),
tr AS (SELECT *, row_number() OVER (PARTITION BY brand_id, profile_id ORDER BY seen_at DESC, touch_seq DESC, visitor_id DESC) AS q FROM tk),
tl AS (SELECT brand_id, profile_id, '[' || string_agg('{"seq":' || CAST(q AS VARCHAR) || ',"ts":"' || strftime(seen_at, '%Y-%m-%dT%H:%M:%SZ') || '"' || ',"event_type":' || to_json(event_type) || coalesce(',"channel":' || to_json(channel), '')
  || coalesce(',"page_type":' || to_json(page_type), '') || coalesce(',"product_handle":' || to_json(product_handle), '') || coalesce(',"order_id":' || to_json(order_id), '') || ',"is_first_touch":' || to_json(is_first_touch) || '}', ',' ORDER BY q) || ']' AS journey_summary
  FROM tr WHERE q <= 200 GROUP BY 1, 2),
cr AS (SELECT *, CAST('0x' || substr(h, 1, 12) || '5' || substr(h, 14, 2) AS BIGINT) AS n, date_diff('day', CAST(last_seen_at AS DATE), DATE '2001-09-01') AS days, date_diff('day', CAST(last_order_at AS DATE), DATE '2001-09-01') AS recency_days
  FROM (SELECT *, sha256(concat_ws(chr(0), brand_id, CAST(profile_id AS VARCHAR))) AS h FROM sp)),
pf AS (SELECT cr.brand_id, cr.profile_id, 'BRN-' || list_aggregate([substr('0123456789ABCDEFGHJKMNPQRSTVWXYZ', CAST((n >> (55 - 5 * i)) & 31 AS INTEGER) + 1, 1) FOR i IN range(12)], 'string_agg', '') AS customer_ref, lifetime_orders, lifetime_value_minor, lifetime_value_minor // lifetime_orders AS aov_minor,
  currency_code, first_seen_at, first_identified_at, last_seen_at, coalesce(ls.at, last_seen_at) AS last_activity_at, delivered_orders, rto_orders, cancelled_orders, refunded_orders, pc.channel AS preferred_channel, device AS preferred_device, title AS top_category, ac.channel AS acquisition_source,
  CASE WHEN recency_days <= 90 THEN 'healthy' WHEN recency_days <= 180 THEN 'at_risk' ELSE 'churned' END AS health_band, CASE WHEN days > 180 THEN 85 WHEN days > 90 THEN 55 ELSE 15 END AS churn_score,
  CASE WHEN recency_days > 180 THEN 'churned' WHEN recency_days > 90 THEN 'at_risk' WHEN lifetime_orders <= 1 THEN 'new' ELSE 'active' END AS lifecycle_stage, journey_summary, recency_days, frequency,
  CASE WHEN recency_days <= 30 THEN 60 WHEN recency_days <= 60 THEN 45 WHEN recency_days <= 90 THEN 30 WHEN recency_days <= 180 THEN 15 ELSE 0 END + CASE WHEN frequency >= 10 THEN 40 WHEN frequency >= 5 THEN 30 WHEN frequency >= 3 THEN 20 WHEN frequency >= 2 THEN 10 ELSE 5 END AS health_score,
  last_order_at, days AS days_since_last_order, CASE WHEN days <= 30 THEN 5 WHEN days <= 60 THEN 4 WHEN days <= 90 THEN 3 WHEN days <= 180 THEN 2 ELSE 1 END AS recency_score,
  CASE WHEN lifetime_orders >= 10 THEN 5 WHEN lifetime_orders >= 5 THEN 4 WHEN lifetime_orders >= 3 THEN 3 WHEN lifetime_orders >= 2 THEN 2 ELSE 1 END AS frequency_score,
  CASE WHEN lifetime_value_minor >= 10000000 THEN 5 WHEN lifetime_value_minor >= 5000000 THEN 4 WHEN lifetime_value_minor >= 1000000 THEN 3 WHEN lifetime_value_minor >= 200000 THEN 2 ELSE 1 END AS monetary_score,
  CASE WHEN days > 180 THEN 'high' WHEN days > 90 THEN 'medium' ELSE 'low' END AS churn_risk,
  CASE WHEN days > 180 THEN 'churned' WHEN days > 90 THEN 'at_risk' WHEN lifetime_value_minor >= 10000000 AND lifetime_orders >= 5 AND days <= 60 THEN 'VIP' WHEN lifetime_orders >= 5 THEN 'loyal' WHEN lifetime_value_minor >= 5000000 THEN 'high_value'
    WHEN lifetime_orders = 1 AND lifetime_value_minor > 0 THEN 'first_time_buyer' WHEN lifetime_value_minor = 0 THEN 'cart_abandoner' ELSE 'window_shopper' END AS segment, customer_watermark, TIMESTAMP '2001-09-01' AS updated_at
FROM cr LEFT JOIN nd ON nd.brand_id = cr.brand_id AND nd.profile_id = cr.profile_id AND nd.lifecycle_state <> 'merged' LEFT JOIN ls ON ls.brand_id = cr.brand_id AND ls.profile_id = cr.profile_id LEFT JOIN tl ON tl.brand_id = cr.brand_id AND tl.profile_id = cr.profile_id
  LEFT JOIN pc ON pc.i = 1 AND pc.brand_id = cr.brand_id AND pc.profile_id = cr.profile_id LEFT JOIN ac ON ac.i = 1 AND ac.brand_id = cr.brand_id AND ac.profile_id = cr.profile_id
  LEFT JOIN dv ON dv.i = 1 AND dv.brand_id = cr.brand_id AND dv.profile_id = cr.profile_id LEFT JOIN tc ON tc.i = 1 AND tc.brand_id = cr.brand_id AND tc.profile_id = cr.profile_id)
"""


def whole_profile(spark: SparkSession, sf_dir: str, changed: DataFrame | None = None) -> DataFrame:
    st = profile_states(spark, sf_dir)
    customers = V.customers(st, V.customer_nodes(nodes(spark, sf_dir)), "ingested_at")
    return P.profiles(customers, st, profile_touches(spark, sf_dir), page_views(spark, sf_dir), titled_lines(spark, sf_dir), AS_OF, changed=changed)


@query("g17_profile_whole", sql(PROFILE_SQL + "SELECT * FROM pf WHERE NOT (profile_id % 28 = 0 OR profile_id % 33 = 0)"))
def profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The customer profile with all its columns, without profiles that were merged away."""
    return P.without_merged(whole_profile(spark, sf_dir), identity_bands(spark, sf_dir))


def visitor_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Identity links of customers to visitors: some have two, some are inactive, some name visitors that never came."""
    c = F.col("c_custkey")
    link = lambda v, there: F.when(there, identifier_hash("x1", "anon_id", text(v)))
    named = F.array_compact(F.array(link(c, F.lit(True)), link(c + 3, c % 10 == 0)))
    rows = table(spark, sf_dir, "customer").select(brand("c_custkey"), c.alias("profile_id"), (c % 7 != 0).alias("is_active"), F.explode(named).alias("identifier_hash"))
    return rows.withColumn("identifier_type", F.lit("anon_id"))


STITCH_SQL = """
, vs AS (SELECT DISTINCT brand_id, visitor_id FROM e),
lk AS (SELECT DISTINCT 'b' || CAST(c_custkey % 3 AS VARCHAR) AS brand_id, c_custkey AS profile_id, c_custkey + d AS v FROM customer CROSS JOIN (VALUES (0), (3)) AS x(d) WHERE c_custkey % 7 <> 0 AND (d = 0 OR c_custkey % 10 = 0)),
kv AS (SELECT lk.brand_id, profile_id, min(visitor_id) AS visitor_id, count(DISTINCT visitor_id) AS n FROM lk JOIN vs ON vs.brand_id = lk.brand_id AND vs.visitor_id = v GROUP BY 1, 2),
so AS (SELECT os.brand_id, order_id, CAST(visitor_id AS VARCHAR) AS visitor_id, profile_id FROM os JOIN kv ON kv.brand_id = os.brand_id AND kv.profile_id = os.customer_id WHERE n = 1)
"""


def stitches(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    visitors = S.known_visitors(J.touches(spark, sf_dir), visitor_links(spark, sf_dir), "x1")
    return visitors, S.stitched_orders(ledger(spark, sf_dir).withColumn("profile_id", F.col("customer_id")), visitors)


@query("q_journey_stitch", sql(STITCH_SQL + "SELECT * FROM so"))
def journey_stitch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders stitched to the one visitor that their customer is linked to."""
    return stitches(spark, sf_dir)[1]


@query("q_journey_stitch_outcome", sql(STITCH_SQL + "SELECT k.brand_id, coalesce(s.n, 0) AS stitched, k.n AS ambiguous FROM (SELECT brand_id, count(*) FILTER (WHERE n > 1) AS n FROM kv GROUP BY 1) k LEFT JOIN (SELECT brand_id, count(*) AS n FROM so GROUP BY 1) s USING (brand_id)"))
def journey_stitch_outcome(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many orders each brand's run stitched, and how many customers it passed over."""
    return S.outcome(*stitches(spark, sf_dir))
