"""Vendors' webhook lanes, over payloads made of the driver's tables, and the payments that they feed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.operators import silver as V
from quern.plans.catalogue import query
from quern.plans.folds import text
from quern.plans.shop import lines, orders, sql, touches
from quern.sources import lanes as L

SALT = "7175"
ISO = "yyyy-MM-dd'T'HH:mm:ss'Z'"
WEBHOOKS = ("refund.processed", "refund.failed", "payment.dispute.created", "payment.dispute.won", "payment.dispute.lost", "order.paid", "payment.authorized", "payment.captured", "payment.failed", "invoice.paid")


def uuid_sql(h: str) -> str:
    return f"substr({h}, 1, 8) || '-' || substr({h}, 9, 4) || '-5' || substr({h}, 14, 3) || '-' || substr('89ab', CAST('0x' || substr({h}, 17, 1) AS INTEGER) % 4 + 1, 1) || substr({h}, 18, 3) || '-' || substr({h}, 21, 12)"


def js(**fields: Column) -> Column:
    return F.to_json(F.struct(*[c.alias(n) for n, c in fields.items()])).alias("payload")


def major(c: str) -> Column:
    return (F.col(c).cast("decimal(20,2)") / 100).cast("decimal(20,2)").cast("string")


def gateway_webhooks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A webhook an order: ids with blanks and capitals, absent and unreadable amounts, seconds and ISO times."""
    k = F.col("order_id")
    name = F.element_at(F.array(*[F.lit(w) for w in WEBHOOKS]), (k % len(WEBHOOKS)).cast("int") + 1)
    amount = F.when(k % 17 == 0, "1.5").when(k % 19 != 0, text("amount_minor"))
    made = F.when(k % 2 == 0, text(F.unix_seconds("placed_at"))).otherwise(F.date_format("placed_at", ISO))
    return orders(spark, sf_dir).select(
        "brand_id", F.concat(F.lit("w"), text(k)).alias("webhook_id"), name.alias("event"),
        js(id=F.when(k % 23 != 0, F.concat(F.lit(" ID_"), text(k), F.lit(" "))), payment_id=F.concat(F.lit("pay_"), text(k)), order_id=text(k), amount=amount, fee=F.when(k % 3 == 0, text(F.expr("-(amount_minor div 50)"))).otherwise("n/a"),
           status=F.col("status"), method=F.lit("upi"), reason_code=F.lit("FROD"), created_at=F.when(k % 29 != 0, made), respond_by=F.lit("2000-01-01T00:00:00Z")),
    )


WEBHOOK_SQL = f"""
, wn AS (SELECT *, list_extract({list(WEBHOOKS)}, CAST(order_id % 10 + 1 AS BIGINT)) AS w, CASE WHEN order_id % 23 <> 0 THEN 'ID_' || CAST(order_id AS VARCHAR) END AS own, 'pay_' || CAST(order_id AS VARCHAR) AS pay FROM o),
wk AS (SELECT *, CASE WHEN w LIKE 'refund.%' THEN 'refund' WHEN w LIKE 'payment.dispute.%' THEN 'dispute' WHEN w = 'order.paid' THEN 'order_paid' WHEN w = 'invoice.paid' THEN NULL ELSE replace(w, '.', '_') END AS kind FROM wn),
ww AS (SELECT *, CASE WHEN kind IN ('payment_captured', 'payment_failed') AND order_id % 3 = 0 THEN -(amount_minor // 50) END AS fee_minor, CASE WHEN kind LIKE 'payment%' THEN own WHEN kind IN ('refund', 'dispute') THEN pay END AS paid,
  CASE WHEN kind IS NULL THEN 'event not known' WHEN kind IN ('refund', 'dispute') AND own IS NULL THEN 'id missing' WHEN order_id % 17 = 0 THEN 'amount not whole' WHEN order_id % 29 = 0 THEN 'time missing' END AS reject_reason,
  sha256(brand_id || ':w' || CAST(order_id AS VARCHAR) || ':' || kind || ':settlement.webhook.v1') AS h FROM wk)
"""


@query(
    "v_payment_webhooks",
    sql(WEBHOOK_SQL + f"""SELECT brand_id, {uuid_sql('h')} AS event_id, kind AS entity_type, placed_at AS occurred_at, CASE WHEN kind = 'dispute' THEN substr(w, 9) END AS dispute_lifecycle, CASE WHEN kind = 'dispute' THEN CASE WHEN w LIKE '%won' THEN 'credit' ELSE 'debit' END END AS dispute_direction,
  CASE WHEN kind = 'refund' THEN sha256('qu' || lower(own)) END AS refund_id_hash, CASE WHEN kind = 'dispute' THEN sha256('qu' || lower(own)) END AS dispute_id_hash, sha256('qu' || lower(paid)) AS payment_id_hash, CASE WHEN kind = 'order_paid' THEN own WHEN kind LIKE 'payment%' THEN CAST(order_id AS VARCHAR) END AS order_id,
  CASE WHEN order_id % 19 = 0 THEN 0 ELSE amount_minor END AS amount_minor, fee_minor, 'INR' AS currency_code FROM ww WHERE reject_reason IS NULL"""),
)
def payment_webhooks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Refunds, disputes, paid orders and payments of a gateway, in one pass over its webhooks."""
    out = L.accepted(L.payment_webhooks(gateway_webhooks(spark, sf_dir), SALT))
    return out.select("brand_id", "event_id", "entity_type", "occurred_at", "dispute_lifecycle", "dispute_direction", "refund_id_hash", "dispute_id_hash", "payment_id_hash", "order_id", "amount_minor", "fee_minor", "currency_code")


@query("v_webhook_rejects", sql(WEBHOOK_SQL + "SELECT brand_id, reject_reason, count(*) AS n FROM ww WHERE reject_reason IS NOT NULL GROUP BY 1, 2"))
def webhook_rejects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the gateway's lane refused, by reason."""
    out = L.rejected(L.payment_webhooks(gateway_webhooks(spark, sf_dir), SALT))
    return out.groupBy("brand_id", "reject_reason").agg(F.count("*").alias("n"))


def checkout_events(spark: SparkSession, sf_dir: str, vendor: str) -> DataFrame:
    """Checkout payloads of one vendor: half of the visitors each."""
    k, v = F.col("k"), F.col("visitor_id")
    kinds = F.when(F.col("event_type") == "view", "started").when(F.col("event_type") == "click", "step").when(F.col("event_type") == "signup", "abandoned").otherwise("completed")
    total = F.when(k % 13 == 0, "12.345").otherwise(major("value_minor"))
    rows = touches(spark, sf_dir).where(v % 2 == (0 if vendor == "gokwik" else 1))
    return rows.select("brand_id", kinds.alias("kind"), js(
        checkout_id=F.when(k % 11 == 0, "  "), cart_id=F.when(k % 22 != 0, F.concat(F.lit("c"), text("event_id"))), total=total, discount=F.when(k % 3 == 0, text(k)), currency_code=F.when(k % 2 == 0, "usd"), shipping_address=F.struct(F.lit("x").alias("city")), pincode=F.when(k % 5 == 0, k),
        has_address=F.when(k % 7 == 0, True), step=F.lit("pay"), customer_email=F.concat(F.lit(" V"), text(v), F.lit("@X.example")), created_at=F.date_format("seen_at", ISO)))


@query(
    "v_checkout_lanes",
    sql(f"""
, ck AS (SELECT *, CASE visitor_id % 2 WHEN 0 THEN 'gokwik' ELSE 'shopflo' END AS source, date_trunc('second', seen_at) AS t, 'c' || CAST(event_id AS VARCHAR) AS c FROM e WHERE k % 22 <> 0 AND NOT (event_type NOT IN ('view', 'click', 'signup') AND visitor_id % 2 = 0)),
cn AS (SELECT *, CASE event_type WHEN 'view' THEN source || '.checkout_started.v1' WHEN 'click' THEN source || '.checkout_step.v1' WHEN 'signup' THEN 'checkout.abandoned.v1' ELSE source || '.checkout_completed.v1' END AS event_name FROM ck),
ch AS (SELECT *, sha256(brand_id || ':' || c || ':' || CAST(epoch_ms(t) AS VARCHAR) || ':' || event_name) AS h FROM cn)
SELECT brand_id, event_name, {uuid_sql('h')} AS event_id, t AS occurred_at, source, c AS order_id, CASE WHEN k % 13 <> 0 THEN value_minor END AS total_price_minor, CASE WHEN k % 3 = 0 THEN k * 100 END AS total_discount_minor, CASE WHEN k % 2 = 0 THEN 'USD' ELSE 'INR' END AS currency_code,
  k % 5 = 0 OR k % 7 = 0 AS has_address, CASE WHEN event_type = 'click' THEN 'pay' END AS step_name, sha256(concat_ws(chr(0), '{SALT}', 'email', 'v' || CAST(visitor_id AS VARCHAR) || '@x.example')) AS email_hash FROM ch"""),
)
def checkout_lanes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Checkout funnels of two vendors as one table."""
    each = [L.accepted(L.checkouts(checkout_events(spark, sf_dir, v), v, SALT)) for v in ("gokwik", "shopflo")]
    return each[0].unionByName(each[1]).select("brand_id", "event_name", "event_id", "occurred_at", "source", "order_id", "total_price_minor", "total_discount_minor", "currency_code", "has_address", "step_name", "email_hash")


def payment_events(spark: SparkSession, sf_dir: str, vendor: str) -> DataFrame:
    """Payment payloads of cash-on-delivery orders that were paid after all."""
    k = F.col("order_id")
    rows = orders(spark, sf_dir).where((F.col("payment_method") == "cod") & (k % 2 == (0 if vendor == "gokwik" else 1)))
    return rows.select("brand_id", F.col("placed_at").alias("ingested_at"), F.when(k % 5 == 0, "authorized").otherwise("attempted").alias("kind"), js(
        order_id=text(k), amount=F.when(k % 31 == 0, "0").otherwise(major("amount_minor")), status=F.when(k % 7 == 0, "Declined").when(k % 11 == 0, "FAILED"), payment_id=F.when(k % 4 < 2, F.concat(F.lit("Pay"), text(k))), currency=F.col("currency_code"), updated_at=F.date_format("placed_at", ISO)))


@query(
    "s10_payment_lanes",
    sql(WEBHOOK_SQL + f"""
, px AS (SELECT brand_id, 'px' || CAST(event_id AS VARCHAR) AS event_id, 'pixel' AS source, CASE WHEN k % 3 = 0 THEN 'failed' WHEN k % 3 = 1 THEN 'succeeded' ELSE 'initiated' END AS payment_status, CAST(k * 4 AS VARCHAR) AS order_id, NULL AS payment_id_hash, CASE WHEN k % 2 = 0 THEN value_minor END AS amount_minor, seen_at AS occurred_at FROM e WHERE event_type = 'purchase'),
cx AS (SELECT brand_id, {uuid_sql('h')} AS event_id, 'razorpay' AS source, CASE kind WHEN 'order_paid' THEN 'paid' ELSE 'authorized' END AS payment_status, CASE WHEN kind = 'order_paid' THEN own ELSE CAST(order_id AS VARCHAR) END AS order_id, CASE WHEN kind = 'payment_authorized' THEN sha256('qu' || lower(own)) END AS payment_id_hash,
  amount_minor, placed_at AS occurred_at FROM ww WHERE kind IN ('order_paid', 'payment_authorized') AND reject_reason IS NULL AND order_id % 19 <> 0),
w0 AS (SELECT *, CASE order_id % 2 WHEN 0 THEN 'gokwik' ELSE 'shopflo' END AS source, CASE WHEN order_id % 4 < 2 THEN 'Pay' || CAST(order_id AS VARCHAR) END AS pid, CASE WHEN order_id % 5 = 0 THEN 'authorized' WHEN order_id % 7 = 0 AND order_id % 2 = 1 THEN 'failed' WHEN order_id % 7 <> 0 AND order_id % 11 = 0 THEN 'failed' ELSE 'initiated' END AS st FROM o WHERE payment_method = 'cod' AND order_id % 31 <> 0),
w1 AS (SELECT *, sha256(brand_id || ':' || CAST(order_id AS VARCHAR) || ':' || coalesce(pid, 'na:' || st) || ':' || CAST(epoch_ms(placed_at) AS VARCHAR) || CASE WHEN order_id % 5 = 0 THEN ':payment.authorized.v1' ELSE ':payment.attempted.v1' END) AS h FROM w0)
SELECT * FROM px UNION ALL SELECT * FROM cx UNION ALL SELECT brand_id, {uuid_sql('h')}, source, st, CAST(order_id AS VARCHAR), sha256('qu' || lower(pid)), amount_minor, placed_at FROM w1"""),
)
def payment_lanes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Payments of the pixel, connector and webhook lanes, one row an event; all but the pixel's need an amount."""
    k = F.col("k")
    pixel = touches(spark, sf_dir).where(F.col("event_type") == "purchase").select(
        "brand_id", F.concat(F.lit("px"), text("event_id")).alias("event_id"), F.when(k % 3 == 0, "payment.failed").when(k % 3 == 1, "payment.succeeded").otherwise("payment.initiated").alias("event_type"), text(k * 4).alias("order_id"),
        F.when(k % 2 == 0, F.col("value_minor")).alias("amount_minor"), F.lit(None).cast("string").alias("currency_code"), F.col("seen_at").alias("occurred_at"),
    )
    connector = L.accepted(L.payment_webhooks(gateway_webhooks(spark, sf_dir), SALT)).withColumn("source", F.lit("razorpay"))
    hooks = [L.accepted(L.payments(payment_events(spark, sf_dir, v), v, SALT)) for v in ("gokwik", "shopflo")]
    out = V.payments(pixel, connector, hooks[0].unionByName(hooks[1]))
    return out.select("brand_id", "event_id", "source", "payment_status", "order_id", "payment_id_hash", "amount_minor", "occurred_at")


RETURNS = ("Return.Created", "PICKED_UP", "return - in transit", "delivered", "Return Refund_Processed", "closed", "lost")


@query(
    "v_return_states",
    sql(f"""
, rt AS (SELECT DISTINCT brand_id, lo.order_id, line_number, return_flag, shipped_at, product_id % 7 AS s FROM lo WHERE return_flag = 'R'),
rx AS (SELECT *, 'AWB' || CAST(order_id * 10 + line_number AS VARCHAR) AS awb, trim(list_extract({list(RETURNS)}, CAST(s + 1 AS BIGINT))) AS st FROM rt),
rh AS (SELECT *, sha256(brand_id || ':' || awb || ':' || st || ':' || strftime(shipped_at, '%Y-%m-%dT%H:%M:%S.000Z') || ':shiprocket.return_status.v1') AS h FROM rx)
SELECT brand_id, {uuid_sql('h')} AS event_id, shipped_at AS occurred_at, sha256('qu' || lower(awb)) AS awb_hash, CAST(order_id AS VARCHAR) AS order_id, st AS status,
  ['return_initiated', 'return_in_transit', 'return_in_transit', 'return_delivered', 'return_completed', 'return_completed', 'none'][CAST(s + 1 AS BIGINT)] AS return_class, s IN (4, 5) AS is_return_complete, CASE WHEN order_id % 3 = 0 THEN 'cod' WHEN order_id % 3 = 1 THEN 'prepaid' END AS payment_method FROM rh"""),
)
def return_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Return states of lines that came back, each once."""
    k = F.col("order_id")
    o = orders(spark, sf_dir).select("order_id", "brand_id")
    status = F.element_at(F.array(*[F.lit(s) for s in RETURNS]), (F.col("product_id") % len(RETURNS)).cast("int") + 1)
    rows = lines(spark, sf_dir).where(F.col("return_flag") == "R").join(o, "order_id")
    raw = rows.select("brand_id", js(order_id=text(k), awb=F.concat(F.lit("AWB"), text(k * 10 + F.col("line_number"))), status=F.concat(F.lit(" "), status), status_changed_at=F.date_format("shipped_at", ISO), payment_method=F.when(k % 3 == 0, "COD").when(k % 3 == 1, "online").otherwise("card")))
    out = L.accepted(L.return_states(raw, SALT)).dropDuplicates(["brand_id", "event_id"])
    return out.select("brand_id", "event_id", "occurred_at", "awb_hash", "order_id", "status", "return_class", "is_return_complete", "payment_method")


@query(
    "v_risk_predictions",
    sql(f"""
, rp AS (SELECT *, CASE WHEN order_id % 4 <> 0 THEN 'rq' || CAST(order_id AS VARCHAR) END AS rq, ['High Risk', 'MED', 'low', 'control group', ''][CAST(order_id % 5 + 1 AS BIGINT)] AS f FROM o WHERE NOT (order_id % 4 = 0 AND order_id % 3 = 0)),
rh AS (SELECT *, sha256(brand_id || ':' || CAST(order_id AS VARCHAR) || ':' || coalesce(rq, strftime(placed_at, '%Y-%m-%dT%H:%M:%S.000Z')) || ':gokwik.rto_predict.v1') AS h FROM rp)
SELECT brand_id, {uuid_sql('h')} AS event_id, CAST(order_id AS VARCHAR) AS order_id, rq AS request_id, ['high', 'medium', 'low', 'control', 'unknown'][CAST(order_id % 5 + 1 AS BIGINT)] AS risk_flag, nullif(f, '') AS risk_flag_raw, CASE WHEN order_id % 3 <> 0 THEN placed_at END AS occurred_at FROM rh"""),
)
def risk_predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predictions of returns to origin, by request or by time; those with neither are refused."""
    k = F.col("order_id")
    flag = F.element_at(F.array(*[F.lit(s) for s in ("High Risk", "MED", "low", "control group", "")]), (k % 5).cast("int") + 1)
    raw = orders(spark, sf_dir).select("brand_id", js(order_id=k, request_id=F.when(k % 4 != 0, F.concat(F.lit("rq"), text(k))), risk_flag=flag, occurred_at=F.when(k % 3 != 0, F.date_format("placed_at", ISO))))
    return L.accepted(L.risk_predictions(raw)).select("brand_id", "event_id", "order_id", "request_id", "risk_flag", "risk_flag_raw", "occurred_at")


@query(
    "v_vendor_refunds",
    sql(f"""
, rf AS (SELECT *, sha256(brand_id || ':r' || CAST(order_id AS VARCHAR) || ':refund.recorded.v1') AS h FROM o WHERE is_refunded)
SELECT brand_id, {uuid_sql('h')} AS event_id, 'r' || CAST(order_id AS VARCHAR) AS refund_id, CAST(order_id AS VARCHAR) AS order_id, CASE WHEN order_id % 4 = 0 THEN 0 ELSE amount_minor END AS amount_minor, currency_code, 'size' AS reason, placed_at AS occurred_at FROM rf"""),
)
def vendor_refunds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Refunds of a checkout vendor, each once however often it is told."""
    k = F.col("order_id")
    rows = orders(spark, sf_dir).where("is_refunded")
    raw = rows.select("brand_id", js(refund_id=F.concat(F.lit("r"), text(k)), order_id=text(k), refund_amount=F.when(k % 4 != 0, major("amount_minor")), currency=F.lower("currency_code"), note=F.lit(" size "), updated_at=F.date_format("placed_at", ISO)))
    out = L.accepted(L.refunds(raw.unionByName(raw))).dropDuplicates(["brand_id", "event_id"])
    return out.select("brand_id", "event_id", "refund_id", "order_id", "amount_minor", "currency_code", "reason", "occurred_at")


def storefront_payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as a storefront sends them, with their lines; some lines have no readable price."""
    k = F.col("order_id")
    price = F.when(F.col("line_number") == 5, "free").otherwise(major("gross_minor"))
    line = F.struct(text("product_id").alias("product_id"), F.col("quantity"), price.alias("price"), major("discount_minor").alias("total_discount"))
    items = lines(spark, sf_dir).groupBy("order_id").agg(F.collect_list(line).alias("line_items"))
    money = lambda c: F.struct(major(c).alias("amount"), F.lit("Refund").alias("kind"), F.when(k % 2 == 0, "failure").alias("status"))
    return orders(spark, sf_dir).join(items, "order_id", "left").select("brand_id", js(
        id=k, current_total_price=major("amount_minor"), currency=F.col("currency_code"), gateway=F.when(F.col("payment_method") == "cod", "COD"), total_tax=F.when(k % 5 != 0, "1.5"), updated_at=F.date_format("placed_at", ISO), line_items=F.col("line_items"),
        shipping_lines=F.array(F.struct(F.lit("40").alias("price")), F.struct(F.when(k % 3 == 0, "x").otherwise("9.99").alias("price"))), discount_codes=F.when(k % 6 == 0, F.array(F.struct(F.lit("TEN").alias("code"), F.lit("10").alias("amount")))),
        refunds=F.when(F.col("is_refunded"), F.array(F.struct(k.alias("id"), F.array(money("amount_minor")).alias("transactions")))), note_attributes=F.array(F.struct(F.lit("visitor_id").alias("name"), F.when(k % 4 != 0, text(k)).otherwise("").alias("value")), F.struct(F.lit("gclid").alias("name"), F.when(k % 9 == 0, "g").alias("value")))))


@query(
    "v_storefront_orders",
    sql("""
, it AS (SELECT order_id, count(*) AS n_lines, CAST(sum(gross_minor * quantity - discount_minor) AS BIGINT) AS lines_minor, CAST(sum(discount_minor) AS BIGINT) AS lines_discount_minor FROM l WHERE line_number <> 5 GROUP BY 1)
SELECT brand_id, CAST(o.order_id AS VARCHAR) AS order_id, amount_minor, payment_method, n_lines, lines_minor, lines_discount_minor, CASE WHEN o.order_id % 5 <> 0 THEN 150 END AS tax_total_minor, CASE WHEN o.order_id % 3 = 0 THEN 4000 ELSE 4999 END AS shipping_total_minor,
  CASE WHEN is_refunded THEN CASE WHEN o.order_id % 2 = 0 THEN 0 ELSE amount_minor END END AS refund_total_minor, CASE WHEN o.order_id % 6 = 0 THEN 'TEN:1000' END AS codes, CASE WHEN o.order_id % 4 <> 0 THEN CAST(o.order_id AS VARCHAR) END AS stitched_visitor_id, CASE WHEN o.order_id % 9 = 0 THEN 'g' END AS click_id
FROM o LEFT JOIN it ON it.order_id = o.order_id"""),
)
def storefront_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A storefront's orders in depth, their lines added up."""
    out = L.accepted(L.storefront_orders(storefront_payloads(spark, sf_dir)))
    added = lambda c: F.aggregate("line_items", F.lit(0).cast("bigint"), lambda a, x: a + x[c])
    codes = F.array_join(F.transform("discount_codes", lambda c: F.concat_ws(":", c["code"], c["amount_minor"])), ",")
    n = F.when(F.col("line_items").isNotNull(), F.size("line_items").cast("bigint"))
    return out.select("brand_id", "order_id", "amount_minor", "payment_method", n.alias("n_lines"), added("line_total_minor").alias("lines_minor"), added("line_discount_minor").alias("lines_discount_minor"), "tax_total_minor", "shipping_total_minor", "refund_total_minor", codes.alias("codes"), "stitched_visitor_id", "click_id")
