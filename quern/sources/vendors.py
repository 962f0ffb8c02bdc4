"""Vendor payloads to canonical rows: ad spend, web sessions, orders, payments, settlements, shipments.

Amounts come as text in major units or micros and leave as bigint minor units by exact decimals; ids
are deterministic; personal identifiers leave as salted hashes only.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.functions.scalars import terminal_class, uuid_of
from quern.operators.identity import identifier_hash, normal_email, normal_phone


def major_to_minor(text: Column, scale: int = 2) -> Column:
    """'12.34' to 1234, half up, exact; null where it isn't a number."""
    return F.round(text.try_cast("decimal(30,9)") * 10**scale, 0).cast("bigint")


def micros_to_minor(text: Column, scale: int = 2) -> Column:
    return F.round(text.try_cast("decimal(30,0)") / F.lit(10 ** (6 - scale)).cast("decimal(10,0)"), 0).cast("bigint")


@dataclass(frozen=True)
class Mapping:
    """How one vendor's JSON becomes canonical columns.

    ``fields`` maps output names to JSON paths; ``money`` to paths of major amounts, ``micros`` of
    millionths; ``hashed`` to (path, kind) of identifiers; ``status`` names a path to classify.
    """

    event_name: str
    key: tuple[str, ...]
    fields: dict[str, str]
    money: dict[str, str] = field(default_factory=dict)
    micros: dict[str, str] = field(default_factory=dict)
    counts: dict[str, str] = field(default_factory=dict)
    hashed: dict[str, tuple[str, str]] = field(default_factory=dict)
    status: str | None = None


# The vendors' field paths.
MAPPINGS = {
    "meta_insight": Mapping("spend.live.v1", ("campaign_id", "stat_date", "level"), {"campaign_id": "campaign_id", "campaign_name": "campaign_name", "level": "level", "stat_date": "date_start", "currency_code": "account_currency"}, money={"spend_minor": "spend"}, counts={"impressions": "impressions", "clicks": "clicks"}),
    "google_row": Mapping("spend.live.v1", ("campaign_id", "stat_date", "level"), {"campaign_id": "campaign.id", "campaign_name": "campaign.name", "level": "level", "stat_date": "segments.date", "currency_code": "customer.currencyCode"}, micros={"spend_minor": "metrics.costMicros"}, counts={"impressions": "metrics.impressions", "clicks": "metrics.clicks"}),
    "ga4_session": Mapping("session.ga4.v1", ("property_id", "date", "source", "medium"), {"property_id": "property", "date": "date", "source": "sessionSource", "medium": "sessionMedium"}, counts={"sessions": "sessions", "conversions": "conversions"}, money={"revenue_minor": "totalRevenue"}),
    "gokwik_order": Mapping("order.live.v1", ("order_id",), {"order_id": "moid", "payment_method": "payment_method", "currency_code": "currency", "risk_flag": "rto_risk"}, money={"amount_minor": "total"}, hashed={"email_hash": ("customer.email", "email"), "phone_hash": ("customer.phone", "phone")}, status="order_status"),
    "razorpay_settlement": Mapping("settlement.live.v1", ("settlement_id", "entity_type"), {"settlement_id": "settlement_id", "entity_type": "type", "order_id": "order_id", "currency_code": "currency"}, counts={"amount_minor": "amount", "fee_minor": "fee", "tax_minor": "tax"}),
    "razorpay_refund": Mapping("refund.recorded.v1", ("refund_id",), {"refund_id": "id", "order_id": "notes.order_id", "currency_code": "currency", "status": "status"}, counts={"amount_minor": "amount"}),
    "shiprocket_shipment": Mapping("shiprocket.shipment_status.v1", ("awb", "status"), {"awb": "awb", "order_id": "order_id", "status": "current_status", "courier": "courier_name", "pincode": "delivery_pincode"}, status="current_status"),
    "shopflo_checkout": Mapping("checkout.started", ("checkout_id",), {"checkout_id": "token", "currency_code": "currency"}, money={"total_minor": "total_price", "discount_minor": "total_discount"}, hashed={"email_hash": ("email", "email"), "phone_hash": ("phone", "phone")}),
    "shopify_order": Mapping("order.live.v1", ("order_id",), {"order_id": "id", "currency_code": "currency", "financial_status": "financial_status", "cancelled_at": "cancelled_at"}, money={"amount_minor": "total_price"}, hashed={"email_hash": ("email", "email"), "phone_hash": ("phone", "phone")}),
    "woocommerce_order": Mapping("order.live.v1", ("order_id",), {"order_id": "id", "currency_code": "currency", "financial_status": "status"}, money={"amount_minor": "total"}, hashed={"email_hash": ("billing.email", "email"), "phone_hash": ("billing.phone", "phone")}),
}


def canonical(raw: DataFrame, vendor: str, brand: str = "brand_id", payload: str = "payload", salt: str = "") -> DataFrame:
    """Canonical rows of one vendor's payloads; a row without a key field is dropped."""
    m = MAPPINGS[vendor]
    at = lambda path: F.get_json_object(payload, f"$.{path}")
    columns = {name: at(path) for name, path in m.fields.items()}
    columns |= {name: major_to_minor(at(path)) for name, path in m.money.items()}
    columns |= {name: micros_to_minor(at(path)) for name, path in m.micros.items()}
    columns |= {name: at(path).try_cast("bigint") for name, path in m.counts.items()}
    normal = {"email": normal_email, "phone": normal_phone}
    columns |= {name: identifier_hash(salt, kind, normal[kind](at(path))) for name, (path, kind) in m.hashed.items()}
    if m.status:
        columns["terminal_class"] = terminal_class(at(m.status))
    out = raw.select(F.col(brand).alias("brand_id"), F.lit(m.event_name).alias("event_name"), *[c.alias(n) for n, c in columns.items()])
    for k in m.key:
        out = out.where(F.col(k).isNotNull())
    return out.withColumn("event_id", uuid_of(F.col("brand_id"), F.lit(vendor), *[F.col(k) for k in m.key]))


def cost_sheet(rows: DataFrame, currencies: tuple[str, ...] = ("INR", "USD", "KWD")) -> tuple[DataFrame, DataFrame]:
    """(clean, rejected) rows of an uploaded cost sheet of text columns sku, cost, currency, valid_from."""
    cost, day = major_to_minor(F.col("cost")), F.try_to_timestamp("valid_from", F.lit("yyyy-MM-dd")).cast("date")
    reason = (
        F.when(F.trim(F.coalesce("sku", F.lit(""))) == "", "sku missing")
        .when(cost.isNull() | (cost < 0), "cost not a positive number")
        .when(~F.coalesce(F.upper("currency").isin(*currencies), F.lit(False)), "currency unknown")
        .when(day.isNull(), "date not valid")
    )
    marked = rows.withColumn("reason", reason)
    clean = marked.where(F.col("reason").isNull()).select(F.trim("sku").alias("sku"), cost.alias("cost_minor"), F.upper("currency").alias("currency_code"), day.alias("valid_from"))
    return clean, marked.where(F.col("reason").isNotNull())
