"""Vendors' webhook lanes: payments, refunds, disputes, checkouts, return states, risk predictions, order depth.

A payload is parsed once, into a map of texts or by a declared schema, behind a generator that keeps filters from
repeating the parse. What a lane can't accept keeps its row with a ``reject_reason``; ``accepted`` and ``rejected``
split on it. Personal and financial identifiers leave as salted hashes only. Amounts are exact: a text that isn't a
plain number of the lane's form is never rounded into one. Times are never made up: an event's id is a digest of its own fields,
so a payload that comes twice has one id.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.functions.scalars import any_of, ladder, uuid_shaped
from quern.operators.identity import identifier_hash, normal_email, normal_phone

# A vendor's keys for one thing, in the order in which they are tried.
GOKWIK = {
    "order_id": ("moid", "merchant_order_id", "gokwik_order_id", "order_id", "oid"),
    "checkout_id": ("checkout_id", "cart_id", "moid", "merchant_order_id", "order_id"),
    "amount": ("total", "order_total", "grand_total", "amount"),
    "cart": ("total", "cart_value", "order_total", "amount", "cart_total"),
    "discount": ("total_discount", "discount", "discount_total", "discounts"),
    "email": ("email", "customer_email", "user_email"),
    "phone": ("phone", "customer_phone", "mobile", "user_phone", "contact"),
    "customer": ("customer_id", "gokwik_customer_id", "user_id"),
    "payment_id": ("payment_id", "txn_id", "transaction_id", "razorpay_payment_id", "pg_payment_id"),
    "occurred": ("updated_at", "event_time", "created_at", "timestamp"),
}
SHOPFLO = {
    "order_id": ("order_id", "shopflo_order_id", "merchant_order_id", "id", "reference", "order_number"),
    "checkout_id": ("checkout_id", "cart_token", "checkout_session_id", "session_id", "cart_id", "id"),
    "amount": ("total_price", "grand_total", "order_total", "amount", "total"),
    "cart": ("total_price", "grand_total", "order_total", "amount", "total", "subtotal_price", "subtotal", "sub_total"),
    "discount": ("total_discount", "discount", "discount_total"),
    "email": ("email", "customer_email", "user_email"),
    "phone": ("phone", "customer_phone", "mobile", "contact"),
    "customer": ("customer_id", "customer_uid", "uid", "user_id"),
    "payment_id": ("payment_id", "txn_id", "transaction_id", "pg_payment_id", "gateway_payment_id"),
    "occurred": ("occurred_at", "updated_at", "event_time", "created_at", "timestamp"),
    "refund_id": ("refund_id", "id", "refund_reference"),
    "refunded": ("amount", "refund_amount", "total", "total_refund"),
}
VENDORS = {"gokwik": GOKWIK, "shopflo": SHOPFLO}
CURRENCY = ("currency", "currency_code")
STEP = ("step", "step_name", "stage", "checkout_step")
ADDRESS = ("address", "shipping_address", "pincode", "zip")
FAILED = {"gokwik": r"fail", "shopflo": r"fail|declin|error"}
# Return states by class.
RETURN_STATES = (
    ("return_completed", ("completed", "closed", "refunded", "refund processed")),
    ("return_delivered", ("delivered", "received", "reached")),
    ("return_in_transit", ("picked up", "pickup", "pickup done", "pickup generated", "in transit", "out for pickup")),
    ("return_initiated", ("created", "initiated", "requested", "approved", "raised", "qc pending")),
)
EXCEPTIONS = ("exception", "ndr", "undelivered", "address issue", "customer unavailable", "failed delivery attempt")
CREDITS = ("dispute.won", "dispute.closed")
DISPUTES = ("dispute.created", "dispute.under_review", "dispute.action_required", "dispute.lost", *CREDITS)


def parsed(raw: DataFrame, payload: str, schema: str = "map<string,string>", **picked: Column) -> DataFrame:
    """``raw`` with its payload parsed once, as ``_r``, null where it isn't JSON of that form; ``picked`` are columns of their own.

    Expressions that a lane uses more than once are picked, behind a generator of their own, so that each is reckoned
    once a row and filters hold short conditions.
    """
    rows = raw.select("*", F.inline(F.array(F.struct(F.from_json(payload, schema).alias("_r")))))
    return rows.select("*", F.inline(F.array(F.struct(*[c.alias(n) for n, c in picked.items()])))) if picked else rows


def first_of(*keys: str) -> Column:
    """The first of ``keys`` with a text or number that isn't blank, trimmed; objects and arrays don't count."""
    text = [F.trim(F.try_element_at("_r", F.lit(k))) for k in keys]
    return F.coalesce(*[F.when((t != "") & ~t.rlike(r"^[{\[]"), t) for t in text])


def exact_minor(text: Column) -> Column:
    """'12.5' to 1250; null where the text isn't a number without sign and of at most two decimals."""
    t = F.trim(text)
    return F.when(t.rlike(r"^[0-9]{1,15}(\.[0-9]{1,2})?$"), (t.try_cast("decimal(18,2)") * 100).cast("bigint"))


def whole_minor(text: Column, signed: bool = False) -> Column:
    t = F.trim(text)
    return F.when(t.rlike(r"^-?[0-9]{1,18}$" if signed else r"^[0-9]{1,18}$"), t.try_cast("bigint"))


def moment(text: Column) -> Column:
    """A time from seconds since 1970 or ISO text; null where it is neither."""
    t = F.trim(text)
    return F.when(t.rlike(r"^[0-9]{1,11}$"), F.timestamp_seconds(t.try_cast("bigint"))).otherwise(F.try_to_timestamp(t))


def secret_hash(text: Column, salt: str) -> Column:
    """sha-256 of the salt's bytes (given in hex) and the id, trimmed and lower-cased."""
    return F.sha2(F.concat(F.unhex(F.lit(salt)), F.encode(F.lower(F.trim(text)), "UTF-8")), 256)


def event_id(*parts: Column | str) -> Column:
    return uuid_shaped(F.sha2(F.concat_ws(":", *[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts]), 256))


def currency() -> Column:
    return F.upper(F.coalesce(first_of(*CURRENCY), F.lit("INR")))


def folded(status: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(F.trim(F.coalesce(status, F.lit("")))), r"[_\s-]+", " "))


def return_class(status: Column) -> Column:
    """Class of a return's state; its own ladder, as 'delivered' means back at the seller here."""
    text = F.regexp_replace(folded(F.regexp_replace(status, r"\.", " ")), r"^return ", "")
    return ladder([(text.isin(*states), c) for c, states in RETURN_STATES], "none")


def exception_class(status: Column) -> Column:
    text = folded(status)
    return F.when(text == "delayed", "delayed").when(text.isin(*EXCEPTIONS), "ndr")


def risk_flag(text: Column) -> Column:
    t = F.lower(F.trim(F.coalesce(text, F.lit(""))))
    return ladder([(t.contains("high"), "high"), (t.contains("med"), "medium"), (t.contains("low"), "low"), (t.contains("control"), "control")], "unknown")


def accepted(rows: DataFrame) -> DataFrame:
    return rows.where(F.col("reject_reason").isNull()).drop("reject_reason")


def rejected(rows: DataFrame) -> DataFrame:
    return rows.where(F.col("reject_reason").isNotNull())


def _reasons(*steps: tuple[Column, str]) -> Column:
    return ladder([(F.col("_r").isNull(), "payload isn't an object"), *steps], None).alias("reject_reason")


def payment_webhooks(raw: DataFrame, salt: str = "", payload: str = "payload", event: str = "event", webhook: str = "webhook_id") -> DataFrame:
    """Money events of a payment gateway: refunds, disputes, paid orders, authorised, captured and failed payments.

    ``raw`` has brand_id, the webhook's id and event name, and the entity's JSON, amounts in whole minor units. All
    kinds go in one pass. A dispute withholds money (debit) until it is won or closed (credit). Fees and taxes are optional
    and null where they can't be read; an amount that can't be read rejects the row, an absent one is 0.
    """
    name = F.lower(F.trim(F.col(event)))
    short = F.regexp_replace(name, r"^payment\.(?=dispute\.)", "")
    kind = ladder(
        [(name.isin("refund.processed", "refund.failed"), "refund"), (short.isin(*DISPUTES), "dispute"), (name == "order.paid", "order_paid")]
        + [(name == f"payment.{s}", f"payment_{s}") for s in ("authorized", "captured", "failed")],
        None,
    )
    at = lambda k: F.try_element_at("_r", F.lit(k))
    lifted = parsed(
        raw, payload, _kind=kind, _short=short, _own=first_of("id"), _pay=first_of("payment_id"), _made=moment(at("created_at")), _done=moment(at("processed_at")),
        _amount=F.when(at("amount").isNull(), 0).otherwise(whole_minor(at("amount"))),
    )
    kind, short, own, amount = (F.col(c) for c in ("_kind", "_short", "_own", "_amount"))
    pays, refund, dispute = kind.startswith("payment_"), kind == "refund", kind == "dispute"
    payment = F.when(pays, own).when(refund | dispute, F.col("_pay"))
    occurred = F.coalesce(F.when(refund, F.col("_done")), F.col("_made"))
    settled = kind.isin("payment_captured", "payment_failed")
    return lifted.select(
        "brand_id", F.lit("settlement.live.v1").alias("event_name"), event_id(F.col("brand_id"), F.col(webhook), kind, "settlement.webhook.v1").alias("event_id"), kind.alias("entity_type"), occurred.alias("occurred_at"),
        F.when(dispute, short).alias("dispute_lifecycle"), F.when(dispute, F.when(short.isin(*CREDITS), "credit").otherwise("debit")).alias("dispute_direction"),
        F.when(refund, secret_hash(own, salt)).alias("refund_id_hash"), F.when(dispute, secret_hash(own, salt)).alias("dispute_id_hash"), secret_hash(payment, salt).alias("payment_id_hash"),
        F.when(kind == "order_paid", own).when(pays, first_of("order_id")).alias("order_id"), amount.alias("amount_minor"), F.when(settled, whole_minor(at("fee"), True)).alias("fee_minor"), F.when(settled, whole_minor(at("tax"), True)).alias("tax_minor"),
        F.upper(F.coalesce(first_of("currency"), F.lit("INR"))).alias("currency_code"), first_of("status").alias("status"), F.when(settled, first_of("method")).alias("method"), F.when(settled, first_of("error_code")).alias("error_code"),
        F.when(dispute, first_of("reason_code")).alias("reason_code"), F.when(dispute, moment(at("respond_by"))).alias("respond_by"),
        _reasons((kind.isNull(), "event not known"), ((refund | dispute) & own.isNull(), "id missing"), (amount.isNull(), "amount not whole"), (occurred.isNull(), "time missing")),
    )


def _checkout_name(vendor: str, kind: Column) -> Column:
    return F.when(kind == "abandoned", "checkout.abandoned.v1").when(kind.isin("started", "step", *(["completed"] if vendor == "shopflo" else [])), F.concat(F.lit(f"{vendor}.checkout_"), kind, F.lit(".v1")))


def checkouts(raw: DataFrame, vendor: str, salt: str = "", payload: str = "payload", kind: str = "kind") -> DataFrame:
    """Checkout events: abandoned, started, step (and completed); an amount that can't be read is null."""
    keys, record = VENDORS[vendor], first_of
    rows = parsed(
        raw, payload, _name=_checkout_name(vendor, F.col(kind)), _checkout=record(*keys["checkout_id"]), _at=F.try_to_timestamp(record(*keys["occurred"])), _email=record(*keys["email"]), _phone=record(*keys["phone"])
    )
    name, checkout, occurred = F.col("_name"), F.col("_checkout"), F.col("_at")
    address = F.coalesce(F.coalesce(F.try_element_at("_r", F.lit("has_address")), F.try_element_at("_r", F.lit("address_present"))) == "true", F.lit(False)) | record(*ADDRESS).isNotNull()
    minor = lambda names: F.coalesce(*[exact_minor(record(k)) for k in names]) if vendor == "shopflo" else exact_minor(record(*names))
    return rows.select(
        "brand_id", name.alias("event_name"), event_id(F.col("brand_id"), checkout, F.unix_millis(occurred), name).alias("event_id"), occurred.alias("occurred_at"), F.lit(vendor).alias("source"),
        F.coalesce(record(*keys["order_id"]), checkout).alias("order_id"), minor(keys["cart"]).alias("total_price_minor"), minor(keys["discount"]).alias("total_discount_minor"), currency().alias("currency_code"),
        address.alias("has_address"), F.when(F.col(kind) == "step", record(*STEP)).alias("step_name"), identifier_hash(salt, "email", normal_email(F.col("_email"))).alias("email_hash"),
        identifier_hash(salt, "phone", normal_phone(F.col("_phone"))).alias("phone_hash"), record(*keys["customer"]).alias("storefront_customer_id"),
        _reasons((name.isNull(), "kind not known"), (checkout.isNull(), "checkout id missing"), (occurred.isNull(), "time missing")),
    )


def payments(raw: DataFrame, vendor: str, salt: str = "", payload: str = "payload", kind: str = "kind") -> DataFrame:
    """Payment attempts and authorisations; without a payment id, the state is part of the event's id."""
    keys = VENDORS[vendor]
    name = F.when(F.col(kind) == "authorized", "payment.authorized.v1").when(F.col(kind) == "attempted", "payment.attempted.v1")
    told = F.lower(F.coalesce(F.try_element_at("_r", F.lit("payment_status")), F.try_element_at("_r", F.lit("status")), F.lit("")))
    state = F.when(F.col(kind) == "authorized", "authorized").when(told.rlike(FAILED[vendor]), "failed").otherwise("initiated")
    rows = parsed(raw, payload, _name=name, _state=state, _order=first_of(*keys["order_id"]), _pay=first_of(*keys["payment_id"]), _at=F.try_to_timestamp(first_of(*keys["occurred"])))
    name, state, order, payment, occurred = (F.col(c) for c in ("_name", "_state", "_order", "_pay", "_at"))
    amount = F.coalesce(*[exact_minor(first_of(k)) for k in keys["amount"]]) if vendor == "shopflo" else exact_minor(first_of(*keys["amount"]))
    identity = F.coalesce(payment, F.concat(F.lit("na:"), state))
    return rows.select(
        "brand_id", name.alias("event_name"), event_id(F.col("brand_id"), order, identity, F.unix_millis(occurred), name).alias("event_id"), occurred.alias("occurred_at"), F.lit(vendor).alias("source"), order.alias("order_id"),
        state.alias("payment_status"), secret_hash(payment, salt).alias("payment_id_hash"), amount.alias("amount_minor"), currency().alias("currency_code"),
        _reasons((name.isNull(), "kind not known"), (order.isNull(), "order id missing"), (occurred.isNull(), "time missing")),
    )


def refunds(raw: DataFrame, payload: str = "payload") -> DataFrame:
    """Refunds of a checkout vendor: one id a refund, whenever it is told; without an amount, 0."""
    keys = SHOPFLO
    rows = parsed(raw, payload, _refund=first_of(*keys["refund_id"]), _at=F.try_to_timestamp(first_of(*keys["occurred"])))
    refund, occurred = F.col("_refund"), F.col("_at")
    amount = F.coalesce(*[exact_minor(first_of(k)) for k in keys["refunded"]], F.lit(0).cast("bigint"))
    return rows.select(
        "brand_id", F.lit("refund.recorded.v1").alias("event_name"), event_id(F.col("brand_id"), refund, "refund.recorded.v1").alias("event_id"), occurred.alias("occurred_at"), refund.alias("refund_id"),
        first_of(*keys["order_id"]).alias("order_id"), amount.alias("amount_minor"), F.upper(first_of(*CURRENCY)).alias("currency_code"), first_of("reason", "note").alias("reason"),
        _reasons((refund.isNull(), "refund id missing"), (occurred.isNull(), "time missing")),
    )


def risk_predictions(raw: DataFrame, payload: str = "payload") -> DataFrame:
    """Predictions of returns to origin; the request names the event, or else its time does."""
    rows = parsed(raw, payload, _order=first_of("order_id"), _request=first_of("request_id"), _flag=first_of("risk_flag"), _at=F.try_to_timestamp(first_of("occurred_at")))
    order, request, told, occurred = (F.col(c) for c in ("_order", "_request", "_flag", "_at"))
    seed = F.coalesce(request, F.date_format(occurred, "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'"))
    return rows.select(
        "brand_id", F.lit("gokwik.rto_predict.v1").alias("event_name"), event_id(F.col("brand_id"), order, seed, "gokwik.rto_predict.v1").alias("event_id"), occurred.alias("occurred_at"), order.alias("order_id"),
        request.alias("request_id"), risk_flag(told).alias("risk_flag"), told.alias("risk_flag_raw"), first_of("risk_reason").alias("risk_reason"),
        _reasons((order.isNull(), "order id missing"), (seed.isNull(), "neither request nor time")),
    )


def return_states(raw: DataFrame, salt: str = "", payload: str = "payload") -> DataFrame:
    """A carrier's return states, by the ladder of returns and never that of deliveries."""
    status = F.coalesce(first_of("status"), F.lit(""))
    rows = parsed(
        raw, payload, _order=first_of("order_id"), _awb=first_of("awb"), _status=status, _class=return_class(status), _at=F.try_to_timestamp(first_of("status_changed_at")), _method=F.lower(F.coalesce(first_of("payment_method"), F.lit("")))
    )
    order, awb, status, kind, changed, method = (F.col(c) for c in ("_order", "_awb", "_status", "_class", "_at", "_method"))
    paid = F.when(method.isin("cod", "cash_on_delivery", "cash on delivery"), "cod").when(method.isin("prepaid", "online", "paid"), "prepaid")
    time = F.date_format(changed, "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")
    return rows.select(
        "brand_id", F.lit("shiprocket.return_status.v1").alias("event_name"), event_id(F.col("brand_id"), F.coalesce(awb, F.lit("")), status, time, "shiprocket.return_status.v1").alias("event_id"), changed.alias("occurred_at"),
        secret_hash(awb, salt).alias("awb_hash"), order.alias("order_id"), status.alias("status"), kind.alias("return_class"), (kind == "return_completed").alias("is_return_complete"),
        paid.alias("payment_method"), first_of("pincode").alias("pincode"), first_of("courier").alias("courier"), _reasons((order.isNull(), "order id missing"), (changed.isNull(), "time missing")),
    )


ORDER = """id string, current_total_price string, currency string, gateway string, payment_gateway_names array<string>, financial_status string, total_tax string, total_discounts string, updated_at string,
  line_items array<struct<sku string, title string, name string, quantity long, price string, total_discount string, product_id string, variant_id string>>,
  tax_lines array<struct<title string, price string>>, shipping_lines array<struct<price string>>, discount_codes array<struct<code string, amount string>>,
  refunds array<struct<id string, note string, transactions array<struct<kind string, status string, amount string>>>>, note_attributes array<struct<name string, value string>>"""


def _sum(of: Column) -> Column:
    return F.aggregate(of, F.lit(0).cast("bigint"), lambda a, x: a + F.coalesce(x, F.lit(0).cast("bigint")))


def storefront_orders(raw: DataFrame, payload: str = "payload", visitor: str = "visitor_id") -> DataFrame:
    """A storefront's orders in depth: lines with exact totals, tax, shipping, discounts, refunds, the visitor that they name.

    A line without a readable price is left out, one without a quantity has 0. Refunds count transactions of kind refund
    or sale that succeeded or are pending. Absent depth is null, not 0. All stays in one row: no join, no shuffle.
    """
    r = F.col("_r")
    some = lambda a: F.when(F.size(a) > 0, a)
    none = F.lit(0).cast("bigint")
    number = lambda x: F.greatest(F.coalesce(x["quantity"], none), none)
    cut = lambda x: F.coalesce(exact_minor(x["total_discount"]), none)
    line = lambda x: F.struct(
        x["sku"].alias("sku"), F.coalesce(x["title"], x["name"]).alias("title"), number(x).alias("quantity"), exact_minor(x["price"]).alias("unit_price_minor"),
        (exact_minor(x["price"]) * number(x) - cut(x)).alias("line_total_minor"), cut(x).alias("line_discount_minor"), x["product_id"].alias("product_id"), x["variant_id"].alias("variant_id"),
    )
    items = some(F.transform(F.filter(r["line_items"], lambda x: exact_minor(x["price"]).isNotNull()), line))
    shipping = F.filter(F.transform(r["shipping_lines"], lambda x: exact_minor(x["price"])), lambda x: x.isNotNull())
    good = lambda t: F.lower(F.coalesce(t["kind"], F.lit(""))).isin("refund", "sale") & F.lower(F.coalesce(t["status"], F.lit("success"))).isin("success", "pending")
    paid_back = lambda x: _sum(F.transform(F.filter(F.coalesce(x["transactions"], F.array()), good), lambda t: exact_minor(t["amount"])))
    back = some(F.transform(r["refunds"], lambda x: F.struct(x["id"].alias("refund_id"), paid_back(x).alias("amount_minor"), x["note"].alias("reason"))))
    codes = some(F.transform(r["discount_codes"], lambda x: F.struct(x["code"].alias("code"), F.coalesce(exact_minor(x["amount"]), none).alias("amount_minor"))))
    gate = F.lower(F.coalesce(r["gateway"], F.lit("")))
    named = F.exists(F.coalesce(r["payment_gateway_names"], F.array().cast("array<string>")), lambda n: any_of([F.lower(n).contains(s) for s in ("cash on delivery", "cod", "pay on delivery", "manual")]))
    cod = gate.isin("cash_on_delivery", "cod", "cash", "pay_on_delivery") | F.coalesce(named, F.lit(False)) | F.coalesce(F.lower(r["financial_status"]) == "pending", F.lit(False))
    attribute = lambda n: F.get(F.transform(F.filter(r["note_attributes"], lambda a: (a["name"] == n) & (a["value"] != "")), lambda a: a["value"]), F.lit(0))
    rows = parsed(raw, payload, ORDER, _amount=exact_minor(r["current_total_price"]), _at=F.try_to_timestamp(r["updated_at"]), _back=back, _shipping=shipping, _cod=cod)
    amount, occurred, back, shipping, cod = (F.col(c) for c in ("_amount", "_at", "_back", "_shipping", "_cod"))
    return rows.select(
        "brand_id", F.lit("order.live.v1").alias("event_name"), event_id(F.col("brand_id"), r["id"], F.unix_millis(occurred), "order.live.v1").alias("event_id"), occurred.alias("occurred_at"), r["id"].alias("order_id"), amount.alias("amount_minor"),
        r["currency"].alias("currency_code"), F.when(cod, "cod").otherwise("prepaid").alias("payment_method"), items.alias("line_items"), exact_minor(r["total_tax"]).alias("tax_total_minor"), F.when(F.size(shipping) > 0, _sum(shipping)).alias("shipping_total_minor"),
        exact_minor(r["total_discounts"]).alias("discount_total_minor"), codes.alias("discount_codes"), back.alias("refunds"), F.when(back.isNotNull(), _sum(F.transform(back, lambda x: x["amount_minor"]))).alias("refund_total_minor"),
        attribute(visitor).alias("stitched_visitor_id"), F.coalesce(*[attribute(c) for c in ("fbclid", "gclid", "ttclid")]).alias("click_id"), attribute("utm_source").alias("utm_source"),
        _reasons((r["id"].isNull(), "order id missing"), (amount.isNull(), "amount not exact"), (occurred.isNull(), "time missing")),
    )

