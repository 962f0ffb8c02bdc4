"""Admission, silver projections, identity, incremental tables and quality, bound to the driver's tables."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.functions import scalars as R
from quern.operators import identity as I
from quern.operators import quality as Q
from quern.operators import upsert as U
from quern.plans.catalogue import query
from quern.plans.revenue import states, total
from quern.plans.shop import AS_OF, EVENTS_AS_OF, lines, orders, sql, touches
from quern.session import table
from quern.sources.events import admit

# -- admission: the driver's events as raw JSON envelopes ------------------------------------------------------------


def raw_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Envelopes as a log would hold them: purchases come from servers, the rest from pixels."""
    e = table(spark, sf_dir, "events")
    k = F.get_json_object("props", "$.k").cast("bigint")
    name = F.when(F.col("event_type") == "purchase", "order.live.v1").when(F.col("event_type") == "signup", "identify").when(F.col("event_type") == "error", "ticket.opened").otherwise(F.concat(F.lit("page."), "event_type"))
    brand = F.concat(F.lit("b"), (F.col("user_id") % 3).cast("string"))
    consent = F.when(k % 9 != 0, F.struct(F.when(k % 5 == 0, "false").otherwise("true").alias("analytics")))
    props = F.struct(F.concat(F.lit("t"), ((F.col("user_id") + F.when(k % 17 == 0, 1).otherwise(0)) % 3).cast("string")).alias("install_token"), k.alias("k"))
    payload = F.struct(
        F.when(F.col("event_id") % 101 != 0, F.col("event_id").cast("string")).alias("event_id"), brand.alias("brand_id"), name.alias("event_name"),
        F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("occurred_at"), F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("ingested_at"), consent.alias("consent_flags"), props.alias("properties"),
    )
    return e.select(F.to_json(payload).alias("payload"))


def tokens(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(f"t{i}", f"b{i}") for i in range(3)], "install_token string, brand_id string")


GATE_SQL = """
, g AS (SELECT *, CASE event_type WHEN 'purchase' THEN 'order.live.v1' WHEN 'signup' THEN 'identify' WHEN 'error' THEN 'ticket.opened' ELSE 'page.' || event_type END AS event_name FROM e WHERE event_id % 101 <> 0),
ad AS (SELECT *, CASE WHEN event_name = 'order.live.v1' THEN 'server' ELSE 'pixel' END AS lane FROM g WHERE event_name = 'order.live.v1' OR (k % 9 <> 0 AND k % 17 <> 0 AND NOT (event_name = 'identify' AND k % 5 = 0)))
"""


@query(
    "s1_admission",
    sql(GATE_SQL + """SELECT CAST(event_id AS VARCHAR) AS event_id, brand_id, event_name, lane, CASE event_name WHEN 'order.live.v1' THEN 'transaction' WHEN 'ticket.opened' THEN 'support' ELSE 'behaviour' END AS category FROM ad"""),
)
def admission(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The admission gate over raw JSON envelopes."""
    out = admit(raw_events(spark, sf_dir), tokens(spark), ("order.live.v1",))
    return out.select("event_id", "brand_id", "event_name", "lane", "category")


@query(
    "s1a_event_category",
    sql("""SELECT event_id, n.name, n.category FROM e JOIN (VALUES (0, 'order.upsert.v1', 'other'), (1, 'Order.live.v1', 'transaction'), (2, 'spend.live.v1', 'marketing'), (3, 'shiprocket.x', 'fulfillment'),
  (4, 'gokwik.rto_predict.v1', 'fulfillment'), (5, 'call.ended', 'support'), (6, 'rage.click', 'behaviour'), (7, 'begin_checkout', 'behaviour'), (8, '', 'other'), (9, 'zzz', 'other')) AS n(i, name, category) ON n.i = e.k % 10"""),
)
def event_categories(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The category ladder over the names of all events, whose JSON property picks one of ten."""
    names = ["order.upsert.v1", "Order.live.v1", "spend.live.v1", "shiprocket.x", "gokwik.rto_predict.v1", "call.ended", "rage.click", "begin_checkout", "", "zzz"]
    name = F.get(F.array(*map(F.lit, names)), (F.col("k") % 10).cast("int"))
    return touches(spark, sf_dir).where(F.col("k").isNotNull()).select("event_id", name.alias("name")).withColumn("category", R.event_category(F.col("name")))


# -- silver projections ------------------------------------------------------------------------------------------------


@query(
    "s8_cart_event",
    sql("""SELECT brand_id, event_id, event_type, value_minor, k AS quantity FROM e WHERE event_type IN ('click', 'signup') AND k BETWEEN 1 AND 50 AND value_minor >= 0 AND seen_at < TIMESTAMP '2024-02-01'"""),
)
def cart_event(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cart and coupon lanes with quality filters (sign, quantity bounds, no future times)."""
    ok = F.col("event_type").isin("click", "signup") & F.col("k").between(1, 50) & (F.col("value_minor") >= 0) & (F.col("seen_at") < F.lit(EVENTS_AS_OF).cast("timestamp"))
    return touches(spark, sf_dir).where(ok).select("brand_id", "event_id", "event_type", "value_minor", F.col("k").alias("quantity"))


@query(
    "s9_checkout_signal",
    sql("""SELECT brand_id, visitor_id, signal, event_id FROM (SELECT *, CASE event_type WHEN 'signup' THEN 'started' WHEN 'purchase' THEN 'completed' WHEN 'error' THEN 'failed' END AS signal,
  row_number() OVER (PARTITION BY visitor_id, event_type, CAST(seen_at AS DATE) ORDER BY seen_at, event_id) AS i FROM e WHERE event_type IN ('signup', 'purchase', 'error')) WHERE i = 1"""),
)
def checkout_signal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first signal of each kind and day; found by an aggregate, not a sort."""
    kind = R.ladder([(F.col("event_type") == "signup", "started"), (F.col("event_type") == "purchase", "completed"), (F.col("event_type") == "error", "failed")], None)
    rows = touches(spark, sf_dir).withColumn("signal", kind).where(F.col("signal").isNotNull()).withColumn("_d", F.col("seen_at").cast("date"))
    first = rows.groupBy("brand_id", "visitor_id", "signal", "_d").agg(F.min(F.struct("seen_at", "event_id")).alias("_f"))
    return first.select("brand_id", "visitor_id", "signal", F.col("_f.event_id").alias("event_id"))


@query(
    "s10_payment",
    sql("""SELECT brand_id, 'pixel' AS source, CAST(event_id AS VARCHAR) AS payment_id, value_minor AS amount_minor FROM e WHERE event_type = 'purchase'
  UNION ALL SELECT brand_id, 'connector', CAST(order_id AS VARCHAR), amount_minor FROM o WHERE payment_method = 'prepaid' AND amount_minor > 0"""),
)
def payment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Payments of the pixel and connector lanes; the latter need an amount."""
    pixel = touches(spark, sf_dir).where(F.col("event_type") == "purchase").select("brand_id", F.lit("pixel").alias("source"), F.col("event_id").cast("string").alias("payment_id"), F.col("value_minor").alias("amount_minor"))
    other = orders(spark, sf_dir).where((F.col("payment_method") == "prepaid") & (F.col("amount_minor") > 0))
    return pixel.unionByName(other.select("brand_id", F.lit("connector").alias("source"), F.col("order_id").cast("string").alias("payment_id"), "amount_minor"))


@query(
    "s11_refund",
    sql("""SELECT l.order_id, l.line_number, l.product_id, l.gross_minor, CASE line_status WHEN 'F' THEN 'damaged' ELSE 'return' END AS reason_code, o.order_id IS NULL AS unresolved
  FROM l LEFT JOIN o ON o.order_id = l.order_id WHERE return_flag = 'R' AND (o.order_id IS NULL OR shipped_at >= placed_at)"""),
)
def refund(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Refunds with a reason from the note's text; those dated before their order are rejected."""
    note = F.when(F.col("line_status") == "F", " Box was Damaged ").otherwise("please exchange")
    o = orders(spark, sf_dir).select(F.col("order_id").alias("_id"), "placed_at")
    rows = lines(spark, sf_dir).where(F.col("return_flag") == "R").join(o, F.col("order_id") == F.col("_id"), "left")
    rows = rows.where(F.col("_id").isNull() | (F.col("shipped_at") >= F.col("placed_at")))
    return rows.select("order_id", "line_number", "product_id", "gross_minor", R.reason_code(note).alias("reason_code"), F.col("_id").isNull().alias("unresolved"))


@query(
    "s16_typed_projection",
    sql("SELECT event_id, TRY_CAST(CASE WHEN k % 4 = 0 THEN 'x' ELSE CAST(k AS VARCHAR) END AS BIGINT) AS amount, coalesce(CASE WHEN k % 3 = 0 THEN NULL ELSE 'USD' END, 'INR') AS currency_code FROM e"),
)
def typed_projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Typed projections that turn junk to null and fill defaults."""
    text = F.when(F.col("k") % 4 == 0, "x").otherwise(F.col("k").cast("string"))
    return touches(spark, sf_dir).select("event_id", text.try_cast("bigint").alias("amount"), F.coalesce(F.when(F.col("k") % 3 != 0, "USD"), F.lit("INR")).alias("currency_code"))


# -- incremental tables ------------------------------------------------------------------------------------------------


@query(
    "f4_merge_on_key",
    sql("""SELECT order_id, CASE WHEN placed_at >= TIMESTAMP '2000-01-01' THEN amount_minor + 1 ELSE amount_minor END AS amount_minor FROM o"""),
)
def merge_on_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    """upsert of a late batch that repeats its keys; the newest version of a key wins."""
    rows = orders(spark, sf_dir).select("order_id", "amount_minor", "placed_at", F.lit(0).alias("v"))
    late = rows.where(F.col("placed_at") >= F.lit("2000-01-01").cast("timestamp"))
    staged = late.withColumn("v", F.lit(1)).unionByName(late.withColumn("v", F.lit(2)).withColumn("amount_minor", F.col("amount_minor") + 1))
    return U.merge_on_key(rows, staged, ["order_id"], [F.desc("v")]).select("order_id", "amount_minor")


@query("f5_shed_orphans", sql("SELECT order_id, amount_minor FROM o WHERE NOT is_cancelled"))
def shed_orphans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """a full fold drops old keys that it lacks."""
    rows = orders(spark, sf_dir).select("order_id", "amount_minor", "is_cancelled")
    return U.merge_on_key(rows, rows.where(~F.col("is_cancelled")), ["order_id"], [F.desc("amount_minor")], shed=True).select("order_id", "amount_minor")


@query(
    "f8_refold_changed",
    sql("""SELECT customer_id, count(*) AS orders, CAST(sum(amount_minor) AS BIGINT) AS amount_minor FROM o WHERE customer_id IN
  (SELECT customer_id FROM o WHERE placed_at >= TIMESTAMP '2001-07-01' - INTERVAL 600 SECOND) GROUP BY 1"""),
)
def refold_changed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers that changed since the watermark, folded again from their whole history."""
    window = U.incremental_window(datetime(2001, 7, 1), datetime(2001, 12, 31))
    rows = U.refold_changed(orders(spark, sf_dir), ["customer_id"], "placed_at", window)
    return rows.groupBy("customer_id").agg(F.count("*").alias("orders"), total("amount_minor").alias("amount_minor"))


@query(
    "f11_parity",
    sql("SELECT count(*) FILTER (WHERE is_cancelled) AS only_left, CAST(0 AS BIGINT) AS only_right, count(*) FILTER (WHERE NOT is_cancelled AND order_id % 5 = 0) AS different, count(*) FILTER (WHERE NOT is_cancelled AND order_id % 5 <> 0) AS equal FROM o"),
)
def parity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """differences of two versions of a table by key, null-safe."""
    a = orders(spark, sf_dir).select("order_id", "amount_minor", "is_cancelled")
    b = a.where(~F.col("is_cancelled")).withColumn("amount_minor", F.when(F.col("order_id") % 5 != 0, F.col("amount_minor")))
    return U.parity(a, b, ["order_id"])


@query(
    "g40_snapshot",
    sql("""SELECT order_id, state, DATE '2001-09-01' AS snapshot_date FROM os UNION ALL SELECT order_id, state, DATE '2001-08-31' FROM os WHERE order_id % 2 = 0"""),
)
def snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily snapshots; a rerun replaces its date."""
    today = states(spark, sf_dir).select("order_id", "state")
    history = today.where(F.col("order_id") % 2 == 0).withColumn("snapshot_date", F.lit("2001-08-31").cast("date"))
    once = U.snapshot(history, today.where(F.col("order_id") < 10), AS_OF)
    return U.snapshot(once, today, AS_OF)


@query(
    "s23_version_bands",
    sql("""SELECT customer_id, payment_method, valid_from, lead(valid_from) OVER (PARTITION BY customer_id ORDER BY valid_from) AS valid_to FROM
  (SELECT customer_id, payment_method, placed_at AS valid_from, lag(payment_method) OVER (PARTITION BY customer_id ORDER BY placed_at) AS before FROM
    (SELECT customer_id, placed_at, arg_max(payment_method, order_id) AS payment_method FROM o GROUP BY 1, 2)) WHERE before IS NULL OR before <> payment_method"""),
)
def version_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Half-open validity bands of a changing attribute."""
    days = orders(spark, sf_dir).groupBy("customer_id", "placed_at").agg(F.max_by("payment_method", "order_id").alias("payment_method"))
    return U.version_history(days, ["customer_id"], "placed_at", ["payment_method"]).select("customer_id", "payment_method", "valid_from", "valid_to")


@query(
    "s23_bitemporal_merge",
    sql("""SELECT order_id, status, TIMESTAMP '2000-01-01' AS system_from, CASE WHEN order_id % 4 = 0 THEN TIMESTAMP '2000-02-01' END AS system_to FROM o WHERE order_id % 3 <> 0
  UNION ALL SELECT order_id, 'X', TIMESTAMP '2000-02-01', NULL FROM o WHERE order_id % 4 = 0 AND order_id % 3 <> 0
  UNION ALL SELECT order_id, CASE WHEN order_id % 4 = 0 THEN 'X' ELSE status END, TIMESTAMP '2000-02-01', NULL FROM o WHERE order_id % 3 = 0"""),
)
def bitemporal_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Changed open rows are closed, new versions appended; the batch is replayed to no effect."""
    rows = orders(spark, sf_dir).select("order_id", "status")
    old = rows.where(F.col("order_id") % 3 != 0).withColumn("system_from", F.lit("2000-01-01").cast("timestamp")).withColumn("system_to", F.lit(None).cast("timestamp"))
    staged = rows.withColumn("status", F.when(F.col("order_id") % 4 == 0, "X").otherwise(F.col("status")))
    once = U.bitemporal_merge(old, staged, ["order_id"], ["status"], "2000-02-01")
    return U.bitemporal_merge(once, staged, ["order_id"], ["status"], "2000-03-01")


# -- identity ----------------------------------------------------------------------------------------------------------


@query(
    "i_components",
    """WITH RECURSIVE ed AS (SELECT DISTINCT o_custkey AS a, o_custkey + 1 AS b FROM orders WHERE o_orderkey % 9 = 0), bo AS (SELECT a, b FROM ed UNION SELECT b, a FROM ed),
  re AS (SELECT a AS node, a AS other FROM bo UNION SELECT re.node, bo.b FROM re JOIN bo ON bo.a = re.other)
  SELECT node, min(other) AS component FROM re GROUP BY 1""",
)
def components(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Union-find as label propagation: the smallest profile that each is linked with."""
    key = F.col("o_custkey")
    return I.components(table(spark, sf_dir, "orders").where(F.col("o_orderkey") % 9 == 0).select(key.alias("a"), (key + 1).alias("b")).distinct())


@query(
    "i_components_all",
    """WITH nd AS (SELECT o_custkey AS node FROM orders UNION SELECT o_custkey + 1 FROM orders), lk AS (SELECT DISTINCT o_custkey + 1 AS node FROM orders),
  st AS (SELECT node, sum(CASE WHEN node IN (SELECT node FROM lk) THEN 0 ELSE 1 END) OVER (ORDER BY node) AS run FROM nd)
  SELECT node, min(node) OVER (PARTITION BY run) AS component FROM st""",
)
def components_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``i_components`` over all orders: long chains, whose components SQL finds as runs of neighbouring keys."""
    key = F.col("o_custkey")
    return I.components(table(spark, sf_dir, "orders").select(key.alias("a"), (key + 1).alias("b")).distinct())


@query(
    "s22_identity_alias",
    """WITH RECURSIVE al AS (SELECT DISTINCT o_custkey AS node, o_custkey // 2 AS target FROM orders WHERE o_custkey % 2 = 0 AND o_custkey > 0),
  w AS (SELECT node, target AS here, 1 AS n FROM al UNION ALL SELECT w.node, al.target, n + 1 FROM w JOIN al ON al.node = w.here WHERE n < 50)
  SELECT node, arg_max(here, n) AS canonical FROM w GROUP BY 1""",
)
def identity_alias(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Alias chains followed to their ends by pointer doubling."""
    key = F.col("o_custkey")
    links = table(spark, sf_dir, "orders").where((key % 2 == 0) & (key > 0)).select(key.alias("node"), F.expr("o_custkey div 2").alias("target")).distinct()
    return I.canonical(links)


LINK_SQL = """
, ln AS (SELECT DISTINCT 'email' AS t, customer_id % 400 AS h, customer_id AS b FROM o UNION SELECT DISTINCT 'phone', customer_id % 700, customer_id FROM o),
gd AS (SELECT * FROM ln WHERE (t, h) IN (SELECT (t, h) FROM ln GROUP BY t, h HAVING count(DISTINCT b) <= 3))
"""


def links(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = orders(spark, sf_dir)
    pair = lambda t, m: F.struct(F.lit(t).alias("identifier_type"), (F.col("customer_id") % m).alias("identifier_hash"))
    return o.select(F.col("customer_id").alias("profile_id"), F.inline(F.array(pair("email", 400), pair("phone", 700)))).distinct()


@query(
    "s27_resolve_unique",
    sql(LINK_SQL + """SELECT o.order_id, CASE WHEN count(DISTINCT gd.b) = 1 THEN min(gd.b) END AS profile_id, CAST(count(DISTINCT gd.b) AS INTEGER) AS candidates, coalesce(string_agg(DISTINCT gd.t, ',' ORDER BY gd.t), '') AS matched_via
  FROM o CROSS JOIN (VALUES ('email'), ('phone')) AS k(t) LEFT JOIN gd ON gd.t = k.t AND gd.h = CASE k.t WHEN 'email' THEN o.customer_id % 400 ELSE o.customer_id % 700 END GROUP BY 1"""),
)
def resolve_unique(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Identifiers of orders against guarded links; one profile or none."""
    o = orders(spark, sf_dir)
    pair = lambda t, m: F.struct(F.lit(t).alias("identifier_type"), (F.col("customer_id") % m).alias("identifier_hash"))
    lanes = o.select("order_id", F.inline(F.array(pair("email", 400), pair("phone", 700))))
    out = I.resolve_unique(lanes, I.guarded_links(links(spark, sf_dir), 3), ["order_id"])
    return out.withColumn("matched_via", F.array_join("matched_via", ","))


@query(
    "i_weak_score",
    sql("""SELECT event_id, least(95, pts + CASE WHEN hits >= 2 THEN 15 ELSE 0 END) AS score, CASE WHEN least(95, pts + CASE WHEN hits >= 2 THEN 15 ELSE 0 END) >= 80 THEN 'high'
  WHEN least(95, pts + CASE WHEN hits >= 2 THEN 15 ELSE 0 END) >= 45 THEN 'medium' WHEN pts >= 1 THEN 'low' ELSE 'none' END AS band FROM
  (SELECT event_id, CAST(k % 2 = 0 AS INTEGER) * 45 + CAST(k % 3 = 0 AS INTEGER) * 35 + CAST(k % 5 = 0 AS INTEGER) * 30 + CAST(k % 7 = 0 AS INTEGER) * 15 AS pts,
    CAST(k % 2 = 0 AS INTEGER) + CAST(k % 3 = 0 AS INTEGER) + CAST(k % 5 = 0 AS INTEGER) + CAST(k % 7 = 0 AS INTEGER) AS hits FROM e)"""),
)
def weak_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weak-signal match scores and bands, never certain."""
    k = F.col("k")
    score = I.weak_score({"device_fingerprint": k % 2 == 0, "cookie_id": k % 3 == 0, "session_id": k % 5 == 0, "ip": k % 7 == 0})
    return touches(spark, sf_dir).select("event_id", score.alias("score")).withColumn("band", I.band(F.col("score")))


@query(
    "s26_match_probability",
    sql("""SELECT event_id, round(2 ** w / (1 + 2 ** w), 9) AS probability FROM (SELECT event_id, log2(0.001 / 0.999) + CASE WHEN k % 2 = 0 THEN log2(0.9 / 0.1) ELSE log2(0.1 / 0.9) END
  + CASE WHEN k % 3 = 0 THEN log2(0.95 / 0.01) ELSE log2(0.05 / 0.99) END AS w FROM e)"""),
)
def match_probability(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Match probability from agreement levels and a prior."""
    k = F.col("k")
    p = I.match_probability({"city": (k % 2 == 0, 0.9, 0.1), "device": (k % 3 == 0, 0.95, 0.01)}, 0.001)
    return touches(spark, sf_dir).select("event_id", F.round(p, 9).alias("probability"))


@query(
    "g38_reversion",
    sql("""
, jv AS (SELECT event_id, visitor_id AS profile_id, seen_at, 1 AS data_version, true AS is_current FROM e),
rv AS (SELECT event_id, profile_id, seen_at, data_version, NOT (profile_id % 10 = 0 AND profile_id > 0) AS is_current FROM jv UNION ALL SELECT event_id, profile_id - 1, seen_at, 2, true FROM jv WHERE profile_id % 10 = 0 AND profile_id > 0)
SELECT event_id, profile_id, data_version, is_current, CASE WHEN is_current THEN row_number() OVER (PARTITION BY profile_id, is_current ORDER BY seen_at, event_id) END AS sequence FROM rv"""),
)
def reversion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Journey rows of merged profiles appended as a new version, numbered again."""
    rows = touches(spark, sf_dir).select("event_id", F.col("visitor_id").alias("profile_id"), "seen_at", F.lit(1).alias("data_version"), F.lit(True).alias("is_current"))
    ids = rows.select("profile_id").distinct().where((F.col("profile_id") % 10 == 0) & (F.col("profile_id") > 0))
    out = I.reversion(rows, ids.select(F.col("profile_id").alias("node"), (F.col("profile_id") - 1).alias("canonical")), ["event_id"], [F.col("seen_at"), F.col("event_id")])
    return out.select("event_id", "profile_id", "data_version", "is_current", "sequence")


# -- quality and insights ----------------------------------------------------------------------------------------------


def _grade_sql(f: str) -> str:
    return f"CASE WHEN {f} <= 0 THEN 'A+' WHEN {f} <= 0.25 THEN 'A' WHEN {f} <= 0.5 THEN 'B' WHEN {f} <= 1.0 THEN 'C' ELSE 'D' END"


@query(
    "dq_freshness",
    sql(f"""SELECT brand_id, newest, round(age, 4) AS observed, round(least(age / 1440.0::DOUBLE, 9.9999), 4) AS fraction, {_grade_sql("age / 1440.0::DOUBLE")} AS grade, age / 1440.0::DOUBLE <= 1 AS passing FROM
  (SELECT brand_id, max(seen_at) AS newest, (epoch(TIMESTAMP '2024-02-01') - floor(epoch(max(seen_at)))) / 60.0::DOUBLE AS age FROM e GROUP BY 1)"""),
)
def dq_freshness(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Freshness of each tenant's events, graded."""
    return Q.freshness(touches(spark, sf_dir), ["brand_id"], "seen_at", EVENTS_AS_OF, 1440)


@query(
    "dq_completeness",
    sql(f"""SELECT brand_id, 'v' AS "column", n AS rows, nulls, round(nulls / n, 6) AS observed, round(least((nulls / n) / 0.5::DOUBLE, 9.9999), 4) AS fraction, {_grade_sql("(nulls / n) / 0.5::DOUBLE")} AS grade, (nulls / n) / 0.5::DOUBLE <= 1 AS passing
  FROM (SELECT brand_id, count(*) AS n, count(*) FILTER (WHERE k % 5 = 0) AS nulls FROM e GROUP BY 1)"""),
)
def dq_completeness(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Null rates, graded."""
    return Q.completeness(touches(spark, sf_dir).withColumn("v", F.when(F.col("k") % 5 != 0, F.col("k"))), ["brand_id"], ["v"], 0.5)


@query(
    "dq_reconciliation",
    sql(f"""SELECT brand_id, left_rows, right_rows, left_rows - right_rows AS observed, round(least((left_rows - right_rows) / 2000.0::DOUBLE, 9.9999), 4) AS fraction, {_grade_sql("(left_rows - right_rows) / 2000.0::DOUBLE")} AS grade,
  (left_rows - right_rows) / 2000.0::DOUBLE <= 1 AS passing FROM (SELECT brand_id, count(*) AS left_rows, count(*) FILTER (WHERE event_id % 101 <> 0) AS right_rows FROM e GROUP BY 1)"""),
)
def dq_reconciliation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw against admitted row counts, graded."""
    rows = touches(spark, sf_dir)
    return Q.reconciliation(rows, rows.where(F.col("event_id") % 101 != 0), ["brand_id"], 2000)


@query(
    "dq_validity",
    sql(f"""SELECT brand_id, 'positive' AS rule, n AS rows, broken, round(broken / n, 6) AS observed, round(least((broken / n) / 0.1::DOUBLE, 9.9999), 4) AS fraction, {_grade_sql("(broken / n) / 0.1::DOUBLE")} AS grade, (broken / n) / 0.1::DOUBLE <= 1 AS passing
  FROM (SELECT brand_id, count(*) AS n, count(*) FILTER (WHERE NOT k > 3) AS broken FROM e GROUP BY 1)"""),
)
def dq_validity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shares of rows that break a rule, graded."""
    return Q.validity(touches(spark, sf_dir), ["brand_id"], {"positive": F.col("k") > 3}, 0.1)


@query(
    "q_detectors",
    sql("""
, kp AS (SELECT brand_id, count(*) AS n, count(*) FILTER (WHERE state = 'rto') * 10000 // count(*) AS rto, CAST(sum(CASE WHEN is_terminal THEN 0 ELSE amount_minor END) AS BIGINT) * 10000 // CAST(sum(amount_minor) AS BIGINT) AS gap,
  CAST(sum(realized_minor) AS BIGINT) // 10 * 10000 // CAST(sum(amount_minor) AS BIGINT) AS margin FROM os GROUP BY 1)
SELECT brand_id, 'rto_risk' AS signal, rto AS observed_bps, rto >= 300 AS fires FROM kp UNION ALL SELECT brand_id, 'realization_gap', gap, gap >= 6000 FROM kp
UNION ALL SELECT brand_id, 'margin_erosion', margin, margin < 1000 FROM kp UNION ALL SELECT brand_id, 'scale_opportunity', margin, margin >= 2000 FROM kp"""),
)
def detectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recommendation signals over a tenant's figures."""
    kpis = states(spark, sf_dir).groupBy("brand_id").agg(
        F.count("*").alias("orders"), F.count_if(F.col("state") == "rto").alias("rto_orders"), total("amount_minor").alias("provisional_minor"),
        total(F.when(F.col("is_terminal"), 0).otherwise(F.col("amount_minor"))).alias("unsettled_minor"), total("amount_minor").alias("net_minor"), F.expr("cast(sum(realized_minor) as bigint) div 10").alias("cm2_minor"),
    )
    return Q.detect(kpis)


@query(
    "q_insights",
    sql("""SELECT *, CASE WHEN change_bps IS NULL THEN 'new' WHEN change_bps <= -2000 THEN 'drop' WHEN change_bps >= 2000 THEN 'rise' ELSE 'steady' END AS insight FROM
  (SELECT *, (amount_minor - amount_before_minor) * 10000 // nullif(amount_before_minor, 0) AS change_bps FROM
  (SELECT brand_id, priority, count(*) FILTER (WHERE placed_at >= TIMESTAMP '2001-07-03') AS orders, count(*) FILTER (WHERE placed_at < TIMESTAMP '2001-07-03') AS orders_before,
    CAST(coalesce(sum(amount_minor) FILTER (WHERE placed_at >= TIMESTAMP '2001-07-03'), 0) AS BIGINT) AS amount_minor, CAST(coalesce(sum(amount_minor) FILTER (WHERE placed_at < TIMESTAMP '2001-07-03'), 0) AS BIGINT) AS amount_before_minor
  FROM o WHERE placed_at >= TIMESTAMP '2001-06-03' AND placed_at < TIMESTAMP '2001-08-02' GROUP BY 1, 2))"""),
)
def insights(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Period over period in one scan, with the rule that fires."""
    return Q.period_over_period(orders(spark, sf_dir), ["brand_id", "priority"], "placed_at", "amount_minor", "2001-08-02", 30)


@query(
    "q_consent_coverage",
    sql("""SELECT brand_id, granted, count(*) AS subjects FROM (SELECT brand_id, visitor_id, arg_max(k % 2 = 0, (seen_at, event_id)) AS granted FROM e WHERE event_type = 'signup' GROUP BY 1, 2) GROUP BY 1, 2"""),
)
def consent_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The latest consent of each subject, counted."""
    rows = touches(spark, sf_dir).where(F.col("event_type") == "signup").groupBy("brand_id", "visitor_id").agg(F.max_by(F.col("k") % 2 == 0, F.struct("seen_at", "event_id")).alias("granted"))
    return rows.groupBy("brand_id", "granted").agg(F.count("*").alias("subjects"))


@query("q_freshness_board", sql("SELECT 'orders' AS source, max(placed_at) AS newest FROM o UNION ALL SELECT 'events', max(seen_at) FROM e UNION ALL SELECT 'lines', max(shipped_at) FROM l"))
def freshness_board(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The newest time of each table."""
    newest = lambda df, c, n: df.agg(F.lit(n).alias("source"), F.max(c).alias("newest"))
    out = newest(orders(spark, sf_dir), "placed_at", "orders").unionByName(newest(touches(spark, sf_dir), "seen_at", "events"))
    return out.unionByName(newest(lines(spark, sf_dir), "shipped_at", "lines"))


@query(
    "q_connector_records",
    sql("""SELECT order_id, strftime(placed_at, '%Y-%m-%d') AS placed_on, n FROM (SELECT o.*, (SELECT count(*) FROM l WHERE l.order_id = o.order_id) AS n FROM o
  WHERE placed_at >= TIMESTAMP '1997-01-01' AND placed_at < TIMESTAMP '1997-02-01' AND lower(priority) LIKE '%urgent%') ORDER BY placed_at DESC, order_id LIMIT 20 OFFSET 5"""),
)
def connector_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A record browser: dates, case-insensitive search, counts from a pre-aggregated join, a page."""
    at = F.col("placed_at")
    some = orders(spark, sf_dir).where((at >= F.lit("1997-01-01").cast("timestamp")) & (at < F.lit("1997-02-01").cast("timestamp")) & F.lower("priority").contains("urgent"))
    page = some.orderBy(F.desc("placed_at"), "order_id").offset(5).limit(20).select("order_id", F.date_format("placed_at", "yyyy-MM-dd").alias("placed_on"))
    n = lines(spark, sf_dir).join(F.broadcast(page.select("order_id")), "order_id", "left_semi").groupBy("order_id").agg(F.count("*").alias("n"))
    return page.join(n, "order_id", "left").withColumn("n", F.coalesce("n", F.lit(0).cast("bigint")))
