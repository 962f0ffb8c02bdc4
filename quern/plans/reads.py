"""Tenant reads and views over the marts: outcomes, funnels, timelines, identity as of a time, campaigns."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quern.functions import scalars as R
from quern.operators.economics import dated_lookup
from quern.operators.sessions import sessionize
from quern.plans import journeys as J
from quern.plans.catalogue import query
from quern.plans.customers import facts
from quern.plans.products import ECONOMICS_SQL, economics, product_costs
from quern.plans.revenue import ledger, total
from quern.plans.shop import lines, orders, sql, touches
from quern.session import table


@query(
    "q_cod_mix",
    sql("SELECT brand_id, payment_method, count(*) AS orders, CAST(sum(amount_minor) AS BIGINT) AS amount_minor, count(*) * 10000 // CAST(sum(count(*)) OVER (PARTITION BY brand_id) AS BIGINT) AS share_bps FROM o GROUP BY 1, 2"),
)
def cod_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders by payment method and their share."""
    n = orders(spark, sf_dir).groupBy("brand_id", "payment_method").agg(F.count("*").alias("orders"), total("amount_minor").alias("amount_minor"))
    return n.withColumn("share_bps", R.bps(F.col("orders"), F.sum("orders").over(Window.partitionBy("brand_id"))))


@query(
    "q_rto_risk_distribution",
    sql("""SELECT risk, count(*) AS orders, count(*) FILTER (WHERE terminal_class = 'rto') AS rto FROM (SELECT *, CASE WHEN amount_minor >= 30000000 THEN 'high' WHEN amount_minor >= 10000000 THEN 'medium' ELSE 'low' END AS risk FROM o WHERE payment_method = 'cod') GROUP BY 1"""),
)
def rto_risk_distribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cash-on-delivery orders by risk band and outcome."""
    a = F.col("amount_minor")
    band = R.ladder([(a >= 30_000_000, "high"), (a >= 10_000_000, "medium")], "low").alias("risk")
    return orders(spark, sf_dir).where(F.col("payment_method") == "cod").groupBy(band).agg(F.count("*").alias("orders"), F.count_if(F.col("terminal_class") == "rto").alias("rto"))


@query(
    "q_return_funnel",
    sql("""SELECT courier, count(*) AS shipped, count(*) FILTER (WHERE return_flag IN ('R', 'A')) AS requested, count(*) FILTER (WHERE return_flag = 'R') AS returned,
  count(*) FILTER (WHERE return_flag = 'R' AND line_status = 'F') AS completed FROM l GROUP BY 1"""),
)
def return_funnel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stages of returns by courier."""
    flag = F.col("return_flag")
    return lines(spark, sf_dir).groupBy("courier").agg(
        F.count("*").alias("shipped"), F.count_if(flag.isin("R", "A")).alias("requested"), F.count_if(flag == "R").alias("returned"), F.count_if((flag == "R") & (F.col("line_status") == "F")).alias("completed")
    )


@query(
    "q_settlement_summary",
    sql("""SELECT brand_id, entity_type, count(*) AS n, CAST(sum(amount_minor) AS BIGINT) AS amount_minor, CAST(sum(amount_minor * 2 // 100) AS BIGINT) AS fee_minor FROM
  (SELECT *, CASE WHEN is_refunded THEN 'refund' WHEN is_cancelled THEN 'reversal' ELSE 'payment' END AS entity_type FROM o WHERE payment_method = 'prepaid') GROUP BY 1, 2"""),
)
def settlement_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Settlements by kind with fees."""
    kind = R.ladder([(F.col("is_refunded"), "refund"), (F.col("is_cancelled"), "reversal")], "payment").alias("entity_type")
    rows = orders(spark, sf_dir).where(F.col("payment_method") == "prepaid")
    return rows.groupBy("brand_id", kind).agg(F.count("*").alias("n"), total("amount_minor").alias("amount_minor"), total(F.expr("amount_minor * 2 div 100")).alias("fee_minor"))


@query("q_cohort_users_page", sql("SELECT customer_id, orders, value_minor FROM cf WHERE brand_id = 'b1' AND strftime(first_at, '%Y') = '1996' ORDER BY value_minor DESC, customer_id LIMIT 30"))
def cohort_users_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first members of a cohort by value."""
    rows = facts(spark, sf_dir).where((F.col("brand_id") == "b1") & (F.year("first_at") == 1996))
    return rows.orderBy(F.desc("value_minor"), "customer_id").limit(30).select("customer_id", "orders", "value_minor")


@query(
    "q_suppression_list",
    sql("SELECT DISTINCT visitor_id FROM e WHERE event_type = 'error' AND k > 90 UNION SELECT visitor_id FROM (SELECT visitor_id, arg_max(k, (seen_at, event_id)) AS last_k FROM e WHERE event_type = 'signup' GROUP BY 1) WHERE last_k % 2 = 1"),
)
def suppression_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Subjects of either suppression source, once each."""
    rows = touches(spark, sf_dir)
    hard = rows.where((F.col("event_type") == "error") & (F.col("k") > 90)).select("visitor_id")
    last = rows.where(F.col("event_type") == "signup").groupBy("visitor_id").agg(F.max_by("k", F.struct("seen_at", "event_id")).alias("k"))
    return hard.union(last.where(F.col("k") % 2 == 1).select("visitor_id")).distinct()


@query("q_touchpoint_timeline", sql("SELECT touch_seq, session_seq, event_type, channel FROM s WHERE visitor_id = 7 ORDER BY touch_seq LIMIT 100"))
def touchpoint_timeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One visitor's touches in order; the visitor is filtered before the windows."""
    rows = sessionize(touches(spark, sf_dir).where(F.col("visitor_id") == 7), J.VISITOR, "seen_at", "event_id")
    return rows.orderBy("touch_seq").limit(100).select("touch_seq", "session_seq", "event_type", "channel")


@query(
    "q_search_behavior",
    sql("""SELECT term, count(*) AS searches, count(DISTINCT visitor_id) AS visitors FROM (SELECT visitor_id, 'term ' || (k % 40) AS term FROM e WHERE event_type = 'view') GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 15"""),
)
def search_behavior(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 15 most frequent search terms."""
    rows = touches(spark, sf_dir).where(F.col("event_type") == "view").select("visitor_id", F.concat(F.lit("term "), (F.col("k") % 40).cast("string")).alias("term"))
    n = rows.groupBy("term", "visitor_id").agg(F.count("*").alias("n")).groupBy("term").agg(F.sum("n").alias("searches"), F.count("*").alias("visitors"))
    return n.orderBy(F.desc("searches"), "term").limit(15)


@query(
    "q_storefront_engagement",
    sql("""SELECT brand_id, count(*) AS sessions, count(*) FILTER (WHERE n = 1) AS bounced, CAST(sum(n) AS BIGINT) AS touches, CAST(sum(n) AS BIGINT) * 100 // count(*) AS touches_x100 FROM
  (SELECT brand_id, visitor_id, session_seq, count(*) AS n FROM s GROUP BY 1, 2, 3) GROUP BY 1"""),
)
def storefront_engagement(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sessions, bounces and touches per session."""
    each = J.sessions(spark, sf_dir).groupBy("brand_id", "visitor_id", "session_seq").agg(F.count("*").alias("n"))
    out = each.groupBy("brand_id").agg(F.count("*").alias("sessions"), F.count_if(F.col("n") == 1).alias("bounced"), F.sum("n").alias("touches"))
    return out.withColumn("touches_x100", F.expr("touches * 100 div sessions"))


@query(
    "q_blended_roas",
    sql("""SELECT coalesce(a.brand_id, p.brand_id) AS brand_id, coalesce(attributed_minor, 0) AS attributed_minor, coalesce(spend_minor, 0) AS spend_minor, coalesce(attributed_minor, 0) * 10000 // nullif(coalesce(spend_minor, 0), 0) AS roas_bps FROM
  (SELECT brand_id, CAST(sum(value_minor) AS BIGINT) AS attributed_minor FROM e WHERE event_type = 'purchase' GROUP BY 1) a FULL OUTER JOIN
  (SELECT brand_id, CAST(sum(value_minor) AS BIGINT) AS spend_minor FROM e WHERE event_type = 'click' GROUP BY 1) p ON a.brand_id = p.brand_id"""),
)
def blended_roas(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All purchases over all spend; both from one aggregate, so nothing is joined."""
    rows = touches(spark, sf_dir)
    of = lambda t: total(F.when(F.col("event_type") == t, F.col("value_minor")))
    out = rows.where(F.col("event_type").isin("purchase", "click")).groupBy("brand_id").agg(of("purchase").alias("attributed_minor"), of("click").alias("spend_minor"))
    return out.withColumn("roas_bps", R.bps(F.col("attributed_minor"), F.col("spend_minor")))


@query(
    "g33_campaign_attribution",
    sql(J.JOURNEY_SQL + """SELECT brand_id, k % 7 AS campaign_id, model, CAST(sum(credit_minor) AS BIGINT) AS attributed_minor, count(DISTINCT visitor_id) AS journeys FROM cr GROUP BY 1, 2, 3"""),
)
def campaign_attribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Credits by campaign and model."""
    k = touches(spark, sf_dir).select("event_id", (F.col("k") % 7).alias("campaign_id"))
    rows = J.credited(spark, sf_dir).join(k, "event_id")
    each = rows.groupBy("brand_id", "campaign_id", "model", "visitor_id").agg(F.sum("credit_minor").alias("c"))
    return each.groupBy("brand_id", "campaign_id", "model").agg(total("c").alias("attributed_minor"), F.count("*").alias("journeys"))


@query(
    "s18_campaign",
    sql("""SELECT coalesce(p.campaign_id, n.campaign_id) AS campaign_id, n.status, coalesce(p.spend_minor, 0) AS spend_minor, coalesce(p.conversions, 0) AS conversions, coalesce(n.status = 'paused' AND p.conversions > 0, false) AS paused_with_conversions FROM
  (SELECT k % 20 AS campaign_id, CAST(sum(value_minor) FILTER (WHERE event_type = 'click') AS BIGINT) AS spend_minor, count(*) FILTER (WHERE event_type = 'purchase') AS conversions FROM e GROUP BY 1) p FULL OUTER JOIN
  (SELECT n_nationkey AS campaign_id, CASE WHEN n_regionkey % 2 = 0 THEN 'active' ELSE 'paused' END AS status FROM nation) n ON n.campaign_id = p.campaign_id"""),
)
def campaign(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spend beside the campaign entity, either of which may lack the other."""
    rows = touches(spark, sf_dir)
    spend = rows.groupBy((F.col("k") % 20).alias("campaign_id")).agg(total(F.when(F.col("event_type") == "click", F.col("value_minor"))).alias("spend_minor"), F.count_if(F.col("event_type") == "purchase").alias("conversions"))
    entity = table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("bigint").alias("campaign_id"), F.when(F.col("n_regionkey") % 2 == 0, "active").otherwise("paused").alias("status"))
    zero = F.lit(0).cast("bigint")
    out = spend.join(entity, "campaign_id", "full_outer").withColumn("spend_minor", F.coalesce("spend_minor", zero)).withColumn("conversions", F.coalesce("conversions", zero))
    return out.withColumn("paused_with_conversions", F.coalesce((F.col("status") == "paused") & (F.col("conversions") > 0), F.lit(False)))


@query(
    "s25_session_identity",
    sql("""SELECT brand_id, visitor_id, session_seq, CASE WHEN count(DISTINCT b) = 1 THEN min(b) END AS profile_id, coalesce(string_agg(DISTINCT lane, ',' ORDER BY lane) FILTER (WHERE b IS NOT NULL), '') AS matched_via FROM
  (SELECT brand_id, visitor_id, session_seq, 'cookie' AS lane, CASE WHEN k % 4 = 0 THEN visitor_id END AS b FROM s UNION ALL SELECT brand_id, visitor_id, session_seq, 'email', CASE WHEN event_type = 'signup' THEN visitor_id // 2 * 2 END FROM s) GROUP BY 1, 2, 3"""),
)
def session_identity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Identifier lanes of a session against the current map; a profile only if all agree."""
    v = F.col("visitor_id")
    lanes = F.array(
        F.struct(F.lit("cookie").alias("lane"), F.when(F.col("k") % 4 == 0, v).alias("b")),
        F.struct(F.lit("email").alias("lane"), F.when(F.col("event_type") == "signup", F.expr("visitor_id div 2 * 2")).alias("b")),
    )
    rows = J.sessions(spark, sf_dir).select("brand_id", "visitor_id", "session_seq", F.inline(lanes))
    met = rows.groupBy("brand_id", "visitor_id", "session_seq").agg(F.min("b").alias("_lo"), F.max("b").alias("_hi"), F.array_sort(F.collect_set(F.when(F.col("b").isNotNull(), F.col("lane")))).alias("_l"))
    return met.select("brand_id", "visitor_id", "session_seq", F.when(F.col("_lo") == F.col("_hi"), F.col("_lo")).alias("profile_id"), F.array_join("_l", ",").alias("matched_via"))


@query("s28_reference_code")
def reference_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Printed references of profiles, by native expressions."""
    key = R.uuid_of(F.lit("customer"), F.col("c_custkey"))
    return table(spark, sf_dir, "customer").select("c_custkey", R.reference_code(key).alias("reference"))


BAND_SQL = """
, dv AS (SELECT customer_id, placed_at, arg_max(payment_method, order_id) AS pm FROM o GROUP BY 1, 2),
vb AS (SELECT customer_id, pm, placed_at AS valid_from, lead(placed_at) OVER (PARTITION BY customer_id ORDER BY placed_at) AS valid_to FROM dv)
"""


@query(
    "g37_as_of_identity",
    sql(BAND_SQL + """SELECT o.order_id, vb.pm AS as_of_value FROM o LEFT JOIN vb ON vb.customer_id = o.customer_id AND valid_from <= o.placed_at + INTERVAL 30 DAY AND (valid_to IS NULL OR valid_to > o.placed_at + INTERVAL 30 DAY)"""),
)
def as_of_identity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each event with the version of its entity that held at a time."""
    o = orders(spark, sf_dir)
    days = o.groupBy("customer_id", "placed_at").agg(F.max_by("payment_method", "order_id").alias("as_of_value"))
    w = Window.partitionBy("customer_id").orderBy("placed_at")
    bands = days.withColumn("valid_to", F.lead("placed_at").over(w)).withColumnRenamed("placed_at", "valid_from")
    rows = o.select("order_id", "customer_id", (F.col("placed_at") + F.make_dt_interval(F.lit(30))).alias("_at"))
    return dated_lookup(rows, bands, ["customer_id"], "_at").select("order_id", "as_of_value")


@query(
    "v_identity_current",
    sql(BAND_SQL + "SELECT customer_id, pm AS payment_method FROM vb WHERE valid_to IS NULL"),
)
def identity_current(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The open version of each entity."""
    days = orders(spark, sf_dir).groupBy("customer_id", "placed_at").agg(F.max_by("payment_method", "order_id").alias("payment_method"))
    return days.groupBy("customer_id").agg(F.max_by("payment_method", "placed_at").alias("payment_method"))


@query(
    "v_sessions_extended",
    sql("""SELECT visitor_id, session_seq, 'deterministic' AS basis, 1.0::DOUBLE AS confidence FROM s WHERE event_type = 'signup' GROUP BY 1, 2
  UNION ALL SELECT visitor_id, session_seq, 'probabilistic', max(k) / 100.0::DOUBLE FROM s GROUP BY 1, 2 HAVING bool_and(event_type <> 'signup') AND max(k) >= 95"""),
)
def sessions_extended(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Deterministic and probabilistic session links with their basis, from one aggregate."""
    each = J.sessions(spark, sf_dir).groupBy("visitor_id", "session_seq").agg(F.bool_or(F.col("event_type") == "signup").alias("_s"), F.max("k").alias("_k"))
    sure = F.col("_s")
    out = each.where(sure | (F.col("_k") >= 95))
    return out.select("visitor_id", "session_seq", F.when(sure, "deterministic").otherwise("probabilistic").alias("basis"), F.when(sure, 1.0).otherwise(F.col("_k") / 100.0).alias("confidence"))


@query(
    "v_semantic_customer",
    sql("""SELECT cf.customer_id, cf.orders, cf.value_minor, cf.recency_days, i.n_methods, i.methods FROM cf LEFT JOIN (SELECT customer_id, count(DISTINCT payment_method) AS n_methods, array_to_string(list_sort(list(DISTINCT payment_method)), ',') AS methods FROM o GROUP BY 1) i USING (customer_id)"""),
)
def semantic_customer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The customer entity with an aggregate of its identifiers."""
    i = orders(spark, sf_dir).groupBy("customer_id").agg(F.array_sort(F.collect_set("payment_method")).alias("_m"))
    i = i.select("customer_id", F.size("_m").cast("bigint").alias("n_methods"), F.array_join("_m", ",").alias("methods"))
    return facts(spark, sf_dir).select("customer_id", "orders", "value_minor", "recency_days").join(i, "customer_id", "left")


@query(
    "v_semantic_product",
    sql(ECONOMICS_SQL + """SELECT d.product_id, d.units, d.net_minor, pc.cost_minor FROM (SELECT product_id, CAST(sum(quantity) AS BIGINT) AS units, CAST(sum(gross_minor - discount_minor) AS BIGINT) AS net_minor FROM l GROUP BY 1) d
  LEFT JOIN pc ON pc.product_id = d.product_id AND pc.valid_to IS NULL"""),
)
def semantic_product(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The product entity with its open cost row."""
    d = lines(spark, sf_dir).groupBy("product_id").agg(total("quantity").alias("units"), total(F.col("gross_minor") - F.col("discount_minor")).alias("net_minor"))
    open_cost = product_costs(spark, sf_dir).where(F.col("valid_to").isNull()).select("product_id", "cost_minor")
    return d.join(open_cost, "product_id", "left")


@query(
    "v_semantic_campaign",
    sql(J.JOURNEY_SQL + """SELECT c.campaign_id, c.spend_minor, coalesce(a.attributed_minor, 0) AS attributed_minor FROM (SELECT k % 7 AS campaign_id, CAST(sum(value_minor) AS BIGINT) AS spend_minor FROM e WHERE event_type = 'click' GROUP BY 1) c
  LEFT JOIN (SELECT k % 7 AS campaign_id, CAST(sum(credit_minor) AS BIGINT) AS attributed_minor FROM cr WHERE model = 'last_touch' GROUP BY 1) a USING (campaign_id)"""),
)
def semantic_campaign(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The campaign entity; one attribution model is picked before the join, so spend isn't multiplied."""
    rows = touches(spark, sf_dir).withColumn("campaign_id", F.col("k") % 7)
    spend = rows.where(F.col("event_type") == "click").groupBy("campaign_id").agg(total("value_minor").alias("spend_minor"))
    credit = J.credited(spark, sf_dir).where(F.col("model") == "last_touch").join(rows.select("event_id", "campaign_id"), "event_id")
    credit = credit.groupBy("campaign_id").agg(total("credit_minor").alias("attributed_minor"))
    return spend.join(credit, "campaign_id", "left").withColumn("attributed_minor", F.coalesce("attributed_minor", F.lit(0).cast("bigint")))


@query(
    "q_finalized_purchases",
    sql("SELECT order_id, amount_minor, currency_code FROM r WHERE event_type = 'finalization' AND effective_at >= TIMESTAMP '1998-03-01' AND effective_at < TIMESTAMP '1998-03-15'"),
)
def finalized_purchases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Purchases that became final in a window."""
    at = F.col("effective_at")
    rows = ledger(spark, sf_dir).where(F.col("event_type") == "finalization")
    rows = rows.where((at >= F.lit("1998-03-01").cast("timestamp")) & (at < F.lit("1998-03-15").cast("timestamp")))
    return rows.select("order_id", F.col("signed_minor").alias("amount_minor"), "currency_code")


@query(
    "q_identity_evidence",
    sql("""SELECT identifier_type, identifier_hash, count(*) AS seen, min(placed_at) AS first_at, max(placed_at) AS last_at FROM
  (SELECT 'email' AS identifier_type, customer_id % 400 AS identifier_hash, placed_at FROM o WHERE brand_id = 'b0' UNION ALL SELECT 'phone', customer_id % 700, placed_at FROM o WHERE brand_id = 'b0') GROUP BY 1, 2"""),
)
def identity_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """When and how often each identifier was seen."""
    pair = lambda t, m: F.struct(F.lit(t).alias("identifier_type"), (F.col("customer_id") % m).alias("identifier_hash"))
    rows = orders(spark, sf_dir).where(F.col("brand_id") == "b0").select("placed_at", F.inline(F.array(pair("email", 400), pair("phone", 700))))
    return rows.groupBy("identifier_type", "identifier_hash").agg(F.count("*").alias("seen"), F.min("placed_at").alias("first_at"), F.max("placed_at").alias("last_at"))


@query(
    "q_data_health",
    sql("SELECT event_type, count(*) AS n, max(seen_at) AS newest, count(*) FILTER (WHERE k % 5 = 0) AS gaps FROM e GROUP BY 1"),
)
def data_health(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts, newest times and gaps by event name."""
    return touches(spark, sf_dir).groupBy("event_type").agg(F.count("*").alias("n"), F.max("seen_at").alias("newest"), F.count_if(F.col("k") % 5 == 0).alias("gaps"))


@query(
    "q_cost_confidence",
    sql(ECONOMICS_SQL + "SELECT brand_id, CASE WHEN count(*) FILTER (WHERE cogs_minor > 0) * 10000 // count(*) >= 9500 THEN 'trusted' WHEN count(*) FILTER (WHERE cogs_minor > 0) * 10000 // count(*) >= 5000 THEN 'estimated' ELSE 'untrusted' END AS tier FROM oe GROUP BY 1"),
)
def cost_confidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trust tier of a tenant's margins from how many orders have a known cost."""
    share = R.bps(F.count_if(F.col("cogs_minor") > 0), F.count("*"))
    out = economics(spark, sf_dir).groupBy("brand_id").agg(share.alias("_s"))
    return out.select("brand_id", R.ladder([(F.col("_s") >= 9500, "trusted"), (F.col("_s") >= 5000, "estimated")], "untrusted").alias("tier"))


@query(
    "s24_unmerge_audit",
    sql("SELECT visitor_id AS absorbed, visitor_id - 1 AS canonical, max(seen_at) AS unmerged_at FROM e WHERE visitor_id % 10 = 0 AND visitor_id > 0 AND event_type = 'error' GROUP BY 1, 2"),
)
def unmerge_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The latest unmerge of each absorbed profile."""
    v = F.col("visitor_id")
    rows = touches(spark, sf_dir).where((v % 10 == 0) & (v > 0) & (F.col("event_type") == "error"))
    return rows.groupBy(v.alias("absorbed"), (v - 1).alias("canonical")).agg(F.max("seen_at").alias("unmerged_at"))
