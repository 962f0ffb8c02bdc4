"""Silver folds, session winners, probabilistic stitches and the journey ledger, over events made of the driver's tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.operators import silver as V
from quern.operators import stitch as P
from quern.plans import journeys as J
from quern.plans.catalogue import query
from quern.plans.revenue import states
from quern.plans.shop import lines, orders, sql, touches
from quern.session import stored, table

TEXT_TIME = "yyyy-MM-dd HH:mm:ss"


def text(c: Column | str) -> Column:
    return (F.col(c) if isinstance(c, str) else c).cast("string")


def brand(c: str) -> Column:
    return F.concat(F.lit("b"), text(F.col(c) % 3)).alias("brand_id")


def pj(**properties: Column) -> Column:
    """An event's JSON envelope with these properties."""
    return F.to_json(F.struct(F.struct(*[v.alias(k) for k, v in properties.items()]).alias("properties"))).alias("pj")


@query(
    "s12_return_state",
    """SELECT brand_id, order_id, b.current_status, b.return_class, b.is_return_complete, b.courier, b.last_status_at, first_event_at FROM (
  SELECT 'b' || CAST(l_orderkey % 3 AS VARCHAR) AS brand_id, CAST(l_orderkey AS VARCHAR) AS order_id, min(CAST(l_shipdate AS TIMESTAMP)) AS first_event_at,
    arg_max({'current_status': l_returnflag, 'return_class': CASE l_returnflag WHEN 'R' THEN 'refund' ELSE 'none' END, 'is_return_complete': l_returnflag = 'R' AND l_linestatus = 'F',
      'courier': 'c' || CAST(l_suppkey % 5 AS VARCHAR), 'last_status_at': strftime(CAST(l_shipdate AS TIMESTAMP), '%Y-%m-%d %H:%M:%S')},
      (l_returnflag = 'R' AND l_linestatus = 'F', strftime(CAST(l_shipdate AS TIMESTAMP), '%Y-%m-%d %H:%M:%S'), l_orderkey * 10 + l_linenumber, l_returnflag, l_suppkey % 5)) AS b
  FROM lineitem WHERE l_returnflag IN ('R', 'A') GROUP BY 1, 2)""",
)
def return_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The latest return state of each order, completed returns first."""
    flag, at = F.col("l_returnflag"), F.col("l_shipdate").cast("timestamp")
    done = (flag == "R") & (F.col("l_linestatus") == "F")
    events = table(spark, sf_dir, "lineitem").where(flag.isin("R", "A")).select(
        brand("l_orderkey"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("event_id"), at.alias("occurred_at"),
        pj(order_id=text("l_orderkey"), status=flag, return_class=F.when(flag == "R", "refund"), is_return_complete=F.when(done, "true").otherwise("false"),
           courier=F.concat(F.lit("c"), text(F.col("l_suppkey") % 5)), status_changed_at=F.when(F.col("l_partkey") % 4 != 0, F.date_format(at, TEXT_TIME))),
    )
    return V.return_states(events)


@query(
    "s14_fulfillment",
    """SELECT brand_id, fulfillment_id, b.* FROM (SELECT 'b' || CAST(l_orderkey % 3 AS VARCHAR) AS brand_id,
    CASE WHEN l_linenumber % 2 = 0 THEN 'f' || CAST(l_orderkey % 700 AS VARCHAR) WHEN l_linenumber % 3 = 0 THEN 'g' || CAST(l_orderkey % 500 AS VARCHAR) END AS fulfillment_id,
    arg_max({'order_id': CAST(l_orderkey AS VARCHAR), 'status': l_linestatus, 'tracking_company': 'c' || CAST(l_suppkey % 5 AS VARCHAR), 'event_id': l_orderkey * 10 + l_linenumber, 'occurred_at': CAST(l_shipdate AS TIMESTAMP)},
      (CAST(l_shipdate AS TIMESTAMP), l_orderkey * 10 + l_linenumber, l_orderkey, l_linestatus, l_suppkey % 5)) AS b FROM lineitem GROUP BY 1, 2) WHERE fulfillment_id IS NOT NULL""",
)
def fulfillment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The latest state of each fulfilment."""
    at, line = F.col("l_shipdate").cast("timestamp"), F.col("l_linenumber")
    events = table(spark, sf_dir, "lineitem").select(
        brand("l_orderkey"), (F.col("l_orderkey") * 10 + line).alias("event_id"), at.alias("occurred_at"), at.alias("ingested_at"),
        pj(fulfillment_id=F.when(line % 2 == 0, F.concat(F.lit("f"), text(F.col("l_orderkey") % 700))), shopify_fulfillment_id=F.when(line % 3 == 0, F.concat(F.lit("g"), text(F.col("l_orderkey") % 500))),
           order_id=text("l_orderkey"), status=F.col("l_linestatus"), tracking_company=F.concat(F.lit("c"), text(F.col("l_suppkey") % 5))),
    )
    return V.fulfillments(events)


@query(
    "s15_settlement",
    sql("""SELECT brand_id, order_id AS event_id, CASE WHEN is_refunded THEN 'refund' ELSE 'payment' END AS entity_type, 's' || CAST(order_id AS VARCHAR) AS settlement_id, CAST(order_id AS VARCHAR) AS order_id,
  CASE WHEN order_id % 17 = 0 THEN 0 ELSE amount_minor END AS amount_minor, amount_minor * 2 // 100 AS fee_minor, CAST(0 AS BIGINT) AS tax_minor, CASE WHEN order_id % 5 = 0 THEN 'INR' ELSE currency_code END AS currency_code,
  CASE WHEN order_id % 19 <> 0 THEN placed_at END AS settlement_at, placed_at AS occurred_at FROM o WHERE payment_method = 'prepaid'"""),
)
def settlement(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Typed settlements with their defaults."""
    key = F.col("order_id")
    events = orders(spark, sf_dir).where(F.col("payment_method") == "prepaid").select(
        "brand_id", key.alias("event_id"), F.col("placed_at").alias("occurred_at"),
        pj(entity_type=F.when(F.col("is_refunded"), "refund").otherwise("payment"), settlement_id=F.concat(F.lit("s"), text(key)), order_id=text(key), amount_minor=F.when(key % 17 == 0, "x1").otherwise(text("amount_minor")),
           fee_minor=text(F.expr("amount_minor * 2 div 100")), currency_code=F.when(key % 5 != 0, F.col("currency_code")), settlement_at=F.when(key % 19 == 0, "soon").otherwise(F.date_format("placed_at", TEXT_TIME))),
    )
    return V.settlements(events)


@query(
    "s17_spend_facts",
    sql("""SELECT brand_id, spend_event_id, 'meta' AS platform, 'campaign' AS level, b.campaign_id, b.stat_date, b.spend_minor, b.impressions, CAST(0 AS BIGINT) AS clicks, b.occurred_at FROM (
  SELECT brand_id, 'sp' || CAST(visitor_id AS VARCHAR) || '-' || CAST(k % 10 AS VARCHAR) AS spend_event_id,
    arg_max({'campaign_id': CAST(k % 20 AS VARCHAR), 'stat_date': CASE WHEN k % 23 <> 0 THEN CAST(seen_at AS DATE) END, 'spend_minor': value_minor, 'impressions': CASE WHEN k % 2 = 0 THEN k ELSE 0 END, 'occurred_at': seen_at},
      (seen_at + to_hours(k % 7), seen_at, event_id)) AS b FROM e WHERE event_type = 'click' AND k % 6 <> 0 GROUP BY 1, 2) WHERE b.stat_date IS NOT NULL"""),
)
def spend_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spend at base grain, the latest ingested version of each spend event."""
    k = F.col("k")
    ingested = F.col("seen_at") + F.make_dt_interval(F.lit(0), (k % 7).cast("int"))
    events = touches(spark, sf_dir).where(F.col("event_type") == "click").select(
        "brand_id", "event_id", F.col("seen_at").alias("occurred_at"), ingested.alias("ingested_at"),
        pj(spend_event_id=F.concat(F.lit("sp"), text("visitor_id"), F.lit("-"), text(k % 10)), platform=F.lit("meta"), level=F.lit("campaign"), campaign_id=text(k % 20),
           stat_date=F.when(k % 23 == 0, "n/a").otherwise(F.date_format("seen_at", "yyyy-MM-dd")), spend_minor=text("value_minor"), impressions=F.when(k % 2 == 0, text(k)), breakdown_key=F.when(k % 6 == 0, "age")),
    )
    return V.spend_facts(events)


@query(
    "s19_cod_outcome",
    sql("""
, pr AS (SELECT brand_id, order_id, arg_max(['high', 'medium', 'low'][CAST(product_id % 3 + 1 AS BIGINT)], (shipped_at, line_number, ['high', 'medium', 'low'][CAST(product_id % 3 + 1 AS BIGINT)])) AS flag, max(shipped_at) AS predicted_at, max((shipped_at, line_number)) AS m FROM lo WHERE line_number % 2 = 0 GROUP BY 1, 2),
sh AS (SELECT brand_id, order_id, arg_max(CASE WHEN return_flag = 'R' THEN 'rto' WHEN line_status = 'F' THEN 'delivered' ELSE 'none' END, (shipped_at, line_number, CASE WHEN return_flag = 'R' THEN 'rto' WHEN line_status = 'F' THEN 'delivered' ELSE 'none' END)) AS kind, max(shipped_at) AS awb_terminal_at, max((shipped_at, line_number)) AS m FROM lo WHERE line_number % 3 = 0 GROUP BY 1, 2)
SELECT o.brand_id, o.order_id, o.amount_minor AS cod_amount_minor, o.currency_code, flag AS rto_risk_flag, flag IN ('high', 'medium') AS predicted_rto, kind AS awb_terminal_class, kind = 'rto' AS actual_rto, kind = 'delivered' AS actual_delivered,
  (flag IN ('high', 'medium')) = (kind = 'rto') AS prediction_correct, o.placed_at AS cod_order_at, predicted_at, awb_terminal_at, greatest(o.placed_at, predicted_at + to_hours(pr.m[2]), awb_terminal_at + to_hours(sh.m[2])) AS ingested_at
FROM o LEFT JOIN pr ON pr.brand_id = o.brand_id AND pr.order_id = o.order_id LEFT JOIN sh ON sh.brand_id = o.brand_id AND sh.order_id = o.order_id WHERE payment_method = 'cod'"""),
)
def cod_outcome(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cash-on-delivery orders with their latest prediction and shipment."""
    o = orders(spark, sf_dir).withColumn("occurred_at", F.col("placed_at")).withColumn("ingested_at", F.col("placed_at"))
    later = F.col("shipped_at") + F.make_dt_interval(F.lit(0), F.col("line_number").cast("int"))
    lo = lines(spark, sf_dir).join(o.select("order_id", "brand_id"), "order_id").withColumn("occurred_at", F.col("shipped_at")).withColumn("ingested_at", later)
    flag = F.get(F.array(F.lit("High"), F.lit("MEDIUM"), F.lit("low")), (F.col("product_id") % 3).cast("int"))
    kind = F.when(F.col("return_flag") == "R", "RTO").when(F.col("line_status") == "F", "delivered").otherwise("none")
    return V.cod_outcomes(o, lo.where(F.col("line_number") % 2 == 0).withColumn("risk_flag", flag), lo.where(F.col("line_number") % 3 == 0).withColumn("terminal_class", kind))


def nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Identity nodes as an export would hold them, some in two versions."""
    c, day = F.col("c_custkey"), 86_400_000
    minted = F.when(c % 6 != 0, c * day)
    one = table(spark, sf_dir, "customer").select(
        brand("c_custkey"), c.alias("profile_id"), F.lit("active").alias("lifecycle_state"), F.lit(None).cast("bigint").alias("merged_into"), minted.alias("minted_at_ms"), F.when(c % 9 != 0, c * day + 3_600_000).alias("first_identified_at_ms")
    )
    two = one.where(F.col("profile_id") % 4 == 0).withColumn("lifecycle_state", F.lit("merged")).withColumn("merged_into", F.expr("profile_id div 2")).withColumn("minted_at_ms", F.col("minted_at_ms") + 1000)
    return one.unionByName(two)


NODE_SQL = """
, nd AS (SELECT 'b' || CAST(c_custkey % 3 AS VARCHAR) AS brand_id, c_custkey AS profile_id, CASE WHEN c_custkey % 4 = 0 THEN 'merged' ELSE 'active' END AS lifecycle_state,
  CASE WHEN c_custkey % 4 = 0 THEN c_custkey // 2 END AS merged_into, CASE WHEN c_custkey % 6 <> 0 THEN make_timestamp((c_custkey * 86400000 + CASE WHEN c_custkey % 4 = 0 THEN 1000 ELSE 0 END) * 1000) END AS minted_at,
  CASE WHEN c_custkey % 9 <> 0 THEN make_timestamp((c_custkey * 86400000 + 3600000) * 1000) END AS first_identified_at FROM customer)
"""


@query("s21_identity_node", sql(NODE_SQL + "SELECT * FROM nd"))
def identity_node(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Identity nodes, the latest version of each."""
    return V.customer_nodes(nodes(spark, sf_dir))


@query(
    "s20_customer",
    sql(NODE_SQL + """, ro AS (SELECT brand_id, customer_id AS profile_id, count(order_id) AS lifetime_orders, CAST(sum(amount_minor) AS BIGINT) AS lifetime_value_minor, max(currency_code) AS currency_code, min(placed_at) AS first_seen_at, max(last_at) AS last_seen_at
  FROM os WHERE customer_id % 5 <> 0 GROUP BY 1, 2)
SELECT ro.*, nd.first_identified_at FROM ro LEFT JOIN nd ON nd.brand_id = ro.brand_id AND nd.profile_id = ro.profile_id AND nd.lifecycle_state <> 'merged'"""),
)
def customer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders of each known profile, beside its live identity node."""
    rows = states(spark, sf_dir).withColumn("profile_id", F.when(F.col("customer_id") % 5 != 0, F.col("customer_id")))
    return V.customers(rows, V.customer_nodes(nodes(spark, sf_dir)))


@query(
    "s25_session_winner",
    sql("""
, st AS (SELECT brand_id, visitor_id, session_seq, min(seen_at) AS session_start, bool_or(event_type = 'signup') AS signed, bool_or(k % 11 = 0) AS known FROM s GROUP BY 1, 2, 3),
la AS (SELECT *, 'anonymous_id' AS lane, 'a' || CAST(visitor_id AS VARCHAR) AS h, false AS strong FROM st UNION ALL SELECT *, 'email', 'e' || CAST(visitor_id // 2 AS VARCHAR), true FROM st WHERE signed
  UNION ALL SELECT *, 'platform_customer_id', 'p' || CAST(visitor_id % 50 AS VARCHAR), true FROM st WHERE known),
mp AS (SELECT 'b' || CAST(c_custkey % 3 AS VARCHAR) AS brand_id, 'a' || CAST(c_custkey AS VARCHAR) AS h, c_custkey % 40 AS profile_id, TIMESTAMP '2023-09-20' + to_days(CAST(c_custkey % 200 AS INTEGER)) AS seen FROM customer
  UNION ALL SELECT 'b' || CAST((2 * c_custkey) % 3 AS VARCHAR), 'e' || CAST(c_custkey AS VARCHAR), (2 * c_custkey) % 40, TIMESTAMP '2000-01-01' FROM customer
  UNION ALL SELECT b, 'p' || CAST(c_custkey AS VARCHAR), c_custkey % 40, NULL FROM customer CROSS JOIN (VALUES ('b0'), ('b1'), ('b2')) AS x(b)),
mt AS (SELECT la.*, mp.profile_id FROM la JOIN mp ON mp.brand_id = la.brand_id AND mp.h = la.h WHERE NOT coalesce(lane = 'anonymous_id' AND seen < session_start - INTERVAL 90 DAY, false)),
ag AS (SELECT brand_id, visitor_id, session_seq, string_agg(DISTINCT lane, ',' ORDER BY lane) AS matched_via, coalesce(list(DISTINCT profile_id) FILTER (WHERE strong), []) AS sp, coalesce(list(DISTINCT profile_id) FILTER (WHERE lane = 'anonymous_id'), []) AS ap FROM mt GROUP BY 1, 2, 3),
wn AS (SELECT *, CASE WHEN len(sp) = 1 AND (len(ap) = 0 OR list_contains(ap, sp[1])) THEN sp[1] WHEN len(sp) = 0 AND len(ap) = 1 THEN ap[1] END AS profile_id FROM ag)
SELECT brand_id, CAST(visitor_id AS VARCHAR) || '-' || CAST(session_seq AS VARCHAR) AS session_id, profile_id, matched_via FROM wn WHERE profile_id IS NOT NULL"""),
)
def session_winner(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The one profile that a session's identifiers leave, with 90 days' recency of shared devices."""
    each = J.sessions(spark, sf_dir).groupBy("brand_id", "visitor_id", "session_seq").agg(
        F.min("seen_at").alias("session_start"), F.bool_or(F.col("event_type") == "signup").alias("signed"), F.bool_or(F.col("k") % 11 == 0).alias("known")
    )
    lane = lambda name, prefix, key, strong, there: F.when(there, F.struct(F.lit(name).alias("lane"), F.concat(F.lit(prefix), text(key)).alias("identifier_hash"), F.lit(strong).alias("is_strong")))
    v = F.col("visitor_id")
    found = F.array_compact(F.array(lane("anonymous_id", "a", v, False, F.lit(True)), lane("email", "e", F.expr("visitor_id div 2"), True, F.col("signed")), lane("platform_customer_id", "p", v % 50, True, F.col("known"))))
    session = F.concat_ws("-", text(v), text("session_seq")).alias("session_id")
    lanes = each.select("brand_id", session, "session_start", F.inline(found))
    c = F.col("c_custkey")
    entry = lambda b, prefix, profile, seen: F.struct(F.concat(F.lit("b"), text(b)).alias("brand_id"), F.concat(F.lit(prefix), text(c)).alias("identifier_hash"), profile.alias("profile_id"), seen.cast("timestamp").alias("last_seen_at"))
    rows = [entry(c % 3, "a", c % 40, F.date_add(F.lit("2023-09-20").cast("date"), (c % 200).cast("int"))), entry((2 * c) % 3, "e", (2 * c) % 40, F.lit("2000-01-01"))]
    rows += [entry(F.lit(b), "p", c % 40, F.lit(None)) for b in range(3)]
    return V.session_winners(lanes, table(spark, sf_dir, "customer").select(F.inline(F.array(*rows))))


def _weight_sql(name: str) -> str:
    import math

    w = [repr(math.log2(m / u)) for m, u in P.MODEL[name]]
    x, y = f"a.{name}", f"b.{name}"
    n = f"len(list_intersect({x}, {y}))"
    told = f"WHEN {x} = {y} THEN {w[0]} ELSE {w[1]}" if len(w) == 2 else f"WHEN {n} >= 3 THEN {w[0]} WHEN {n} >= 2 THEN {w[1]} WHEN {n} >= 1 THEN {w[2]} ELSE {w[3]}"
    return f"CASE WHEN {x} IS NULL OR {y} IS NULL THEN 0.0 {told} END"


def visitor_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Comparison features of visitors."""
    rows = touches(spark, sf_dir).where(F.col("event_type").isin("signup", "purchase", "view")).withColumn("at", F.col("seen_at"))
    v = F.col("visitor_id")
    email = F.when((F.col("event_type") == "signup") & (v % 3 != 0), F.concat(F.lit("m"), text(F.expr("visitor_id div 2"))))
    devices = rows.select("brand_id", v, "at", F.concat(F.lit("ua"), text(v % 4)).alias("ua_class"), F.concat(F.lit("s"), text(F.expr("visitor_id % 6 div 2"))).alias("screen_class"), email.alias("email"))
    views = rows.where(F.col("event_type") == "view").select("brand_id", v, "at", F.when(F.col("k") % 12 == 0, "").otherwise(F.concat(F.lit("p"), text(F.col("k") % 12))).alias("product"))
    return P.features(devices, views)


@query(
    "s26_probabilistic_stitch",
    sql("""
, ft AS (SELECT brand_id, visitor_id, 'ua' || CAST(visitor_id % 4 AS VARCHAR) AS ua_class, 's' || CAST(visitor_id % 6 // 2 AS VARCHAR) AS screen_class, min('m' || CAST(visitor_id // 2 AS VARCHAR)) FILTER (WHERE event_type = 'signup' AND visitor_id % 3 <> 0) AS email,
    list_sort(list(DISTINCT hour(seen_at)) FILTER (WHERE event_type IN ('signup', 'purchase', 'view'))) AS active_hours, coalesce(list_sort(list(DISTINCT 'p' || CAST(k % 12 AS VARCHAR)) FILTER (WHERE event_type = 'view' AND k % 12 <> 0)), []) AS top_products
  FROM e WHERE event_type IN ('signup', 'purchase', 'view') GROUP BY ALL),
fx AS (SELECT *, active_hours[1] // 6 AS daypart, CASE WHEN email IS NOT NULL THEN 'DET-' || sha1(brand_id || '|' || email) END AS person FROM ft),
sc AS (SELECT a.brand_id, a.visitor_id, b.person, round(1 / (1 + pow(2.0, -(""" + " + ".join(["log2(0.001 / 0.999)", *[_weight_sql(n) for n in P.MODEL]]) + """))), 9) AS confidence
  FROM fx a JOIN fx b ON a.brand_id = b.brand_id AND a.person IS NULL AND b.person IS NOT NULL AND ((a.screen_class = b.screen_class AND a.daypart = b.daypart) OR a.ua_class = b.ua_class))
SELECT brand_id, visitor_id, arg_min(person, (-confidence, person)) AS person, max(confidence) AS confidence FROM sc WHERE confidence >= 0.95 GROUP BY 1, 2"""),
)
def probabilistic_stitch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Features, blocks, comparisons, the floor, pairs with one identified side, the best a visitor."""
    return P.stitched(visitor_features(spark, sf_dir))


@query("s26_fitted_model")
def fitted_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    """S26's model, fitted on all visitors: how often pairs of one person, and pairs at random, are at each level of each comparison."""
    model = P.fit(stored(visitor_features(spark, sf_dir)))
    rows = [(c, i, round(m, 9), round(u, 9)) for c, levels in model.items() for i, (m, u) in enumerate(levels)]
    return spark.createDataFrame(rows, "comparison string, level int, m double, u double")


@query(
    "g37_journey_ledger",
    sql("""
, tp AS (SELECT brand_id, visitor_id, touch_seq, seen_at, CASE WHEN visitor_id % 4 <> 0 THEN CAST(visitor_id % 60 AS VARCHAR) ELSE 'anonymous_' || CAST(visitor_id AS VARCHAR) END AS profile_id, event_type = 'purchase' AND k % 2 = 0 AS is_composite, k * 4 AS order_key,
    sha256(concat_ws('||', brand_id, CAST(visitor_id AS VARCHAR), CAST(touch_seq AS VARCHAR))) AS touchpoint_id, 'channel=' || channel || CASE WHEN k % 3 = 0 THEN ',device=d' || CAST(k % 5 AS VARCHAR) ELSE '' END AS signals FROM s),
bd AS (SELECT 'b' || CAST(c_custkey % 3 AS VARCHAR) AS brand_id, CAST(c_custkey AS VARCHAR) AS profile_id, c, CASE WHEN c = 5 THEN TIMESTAMP '2024-01-05' ELSE TIMESTAMP '2024-01-05' + to_days(CAST(c_custkey % 20 AS INTEGER)) END AS f, CASE WHEN c = 5 THEN TIMESTAMP '2024-01-05' + to_days(CAST(c_custkey % 20 AS INTEGER)) END AS t FROM customer CROSS JOIN (VALUES (5), (9)) AS x(c))
SELECT tp.brand_id, tp.profile_id, touchpoint_id, row_number() OVER (PARTITION BY tp.brand_id, tp.profile_id ORDER BY seen_at, touch_seq, visitor_id) AS sequence_number, o.amount_minor AS revenue_minor, o.currency_code, signals,
  bd.profile_id AS profile_id_asof, CAST(bd.c AS BIGINT) AS confidence_asof, 1 AS data_version, NOT (visitor_id % 10 = 0 AND touch_seq <= 2) AS is_current
FROM tp LEFT JOIN o ON o.brand_id = tp.brand_id AND o.order_id = tp.order_key AND is_composite LEFT JOIN bd ON bd.brand_id = tp.brand_id AND bd.profile_id = tp.profile_id AND bd.f <= seen_at AND (bd.t IS NULL OR seen_at < bd.t)"""),
)
def journey_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The versioned journey ledger's first versions."""
    v, k = F.col("visitor_id"), F.col("k")
    rows = J.sessions(spark, sf_dir).select(
        "brand_id", v, "touch_seq", F.when(v % 4 != 0, v % 60).alias("profile_id"), F.col("seen_at").alias("occurred_at"), ((F.col("event_type") == "purchase") & (k % 2 == 0)).alias("is_composite"),
        (k * 4).alias("order_key"), "channel", F.when(k % 3 == 0, F.concat(F.lit("d"), text(k % 5))).otherwise("").alias("device"),
    )
    c, first = F.col("c_custkey"), F.lit("2024-01-05").cast("date")
    split = F.date_add(first, (c % 20).cast("int")).cast("timestamp")
    band = lambda n, low, high: F.struct(F.lit(n).cast("bigint").alias("confidence"), low.alias("effective_from"), high.cast("timestamp").alias("effective_to"))
    bands = table(spark, sf_dir, "customer").select(brand("c_custkey"), c.alias("profile_id"), F.inline(F.array(band(5, first.cast("timestamp"), split), band(9, split, F.lit(None)))))
    ref = F.sha2(F.concat_ws("||", "brand_id", text(v), text("touch_seq")), 256)
    stored = rows.where((v % 10 == 0) & (F.col("touch_seq") <= 3)).select("brand_id", ref.alias("touchpoint_id"), F.when(F.col("touch_seq") <= 2, 2).otherwise(1).alias("data_version"))
    out = P.journey_ledger(rows, bands, orders(spark, sf_dir), stored, ["channel", "device"])
    told = F.array_join(F.transform(F.map_entries("attribution_signals"), lambda s: F.concat_ws("=", s["key"], s["value"])), ",")
    return out.select("brand_id", "profile_id", "touchpoint_id", "sequence_number", "revenue_minor", "currency_code", told.alias("signals"), "profile_id_asof", "confidence_asof", "data_version", "is_current")
