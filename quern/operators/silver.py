"""Typed silver folds over admitted events: returns, fulfilments, settlements, spend, cash-on-delivery outcomes, customers.

Each takes rows whose ``pj`` column is the event's JSON envelope (one parse by a declared schema), or
typed relations, and folds by aggregates that combine before their shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BIG = "bigint"


def parsed(events: DataFrame, fields: str, payload: str = "pj") -> DataFrame:
    """The event's own columns and those ``properties`` that ``fields`` (a DDL of strings) names, by one parse a row.

    The generator keeps filters from being pushed below the parse, which would repeat it.
    """
    kept = [c for c in events.columns if c != payload]
    body = F.from_json(payload, f"properties struct<{fields}>")
    return events.select(*kept, F.inline(F.array(body))).select(*kept, "properties.*")


def newest(rows: DataFrame, keys: list[str], order: list[str], columns: list[str | Column]) -> DataFrame:
    """The row of each key that is greatest in ``order``; of rows alike in all of it, the one of greatest ``columns``.

    So the order is total on what is returned: replayed or repeated rows in any arrangement give one result.
    """
    content = F.struct(*columns)
    return rows.groupBy(*keys).agg(F.max_by(content, F.struct(*order, content.alias("_content"))).alias("_b")).select(*keys, "_b.*")


def return_states(events: DataFrame) -> DataFrame:
    """Latest return state of an order: a completed return wins, then the later change, event, id and greatest content."""
    fields = "order_id string, source string, awb_number_hash string, courier string, status string, return_class string, is_return_complete string, status_changed_at string"
    rows = parsed(events, fields).where(F.coalesce(F.col("order_id"), F.lit("")) != "")
    rows = rows.withColumn("is_return_complete", F.coalesce(F.col("is_return_complete") == "true", F.lit(False)))
    rows = rows.withColumn("return_class", F.coalesce("return_class", F.lit("none"))).withColumn("last_status_at", F.coalesce("status_changed_at", F.col("occurred_at").cast("string")))
    columns = [F.col("status").alias("current_status"), "return_class", "is_return_complete", "courier", "last_status_at"]
    content = F.struct(*columns)
    best = F.max_by(content, F.struct("is_return_complete", "last_status_at", "occurred_at", "event_id", content.alias("_content"))).alias("_b")
    return rows.groupBy("brand_id", "order_id").agg(best, F.min("occurred_at").alias("first_event_at")).select("brand_id", "order_id", "_b.*", "first_event_at")


def fulfillments(events: DataFrame) -> DataFrame:
    """Latest state of each fulfilment, by either of its ids."""
    rows = parsed(events, "fulfillment_id string, shopify_fulfillment_id string, order_id string, status string, tracking_company string")
    rows = rows.withColumn("fulfillment_id", F.coalesce("fulfillment_id", "shopify_fulfillment_id")).where(F.col("fulfillment_id").isNotNull() & F.col("brand_id").isNotNull())
    return newest(rows, ["brand_id", "fulfillment_id"], ["occurred_at", "ingested_at", "event_id"], ["order_id", "status", "tracking_company", "event_id", "occurred_at"])


def settlements(events: DataFrame) -> DataFrame:
    """Typed settlements: amounts that can't be read are 0, a missing currency is INR, a time that can't be read is null."""
    rows = parsed(events, "entity_type string, settlement_id string, order_id string, amount_minor string, fee_minor string, tax_minor string, currency_code string, settlement_at string")
    rows = rows.where(F.col("event_id").isNotNull() & F.col("brand_id").isNotNull())
    whole = lambda c: F.coalesce(F.col(c).try_cast(BIG), F.lit(0).cast(BIG)).alias(c)
    return rows.select(
        "brand_id", "event_id", "entity_type", "settlement_id", "order_id", whole("amount_minor"), whole("fee_minor"), whole("tax_minor"),
        F.coalesce("currency_code", F.lit("INR")).alias("currency_code"), F.col("settlement_at").try_cast("timestamp").alias("settlement_at"), "occurred_at",
    )


def spend_facts(events: DataFrame) -> DataFrame:
    """Spend at base grain (rows of a breakdown are left out), the latest ingested version of each spend event."""
    fields = "spend_event_id string, platform string, level string, campaign_id string, stat_date string, spend_minor string, impressions string, clicks string, breakdown_key string"
    rows = parsed(events, fields).where((F.coalesce(F.col("event_id").cast("string"), F.lit("")) != "") & (F.coalesce(F.col("breakdown_key"), F.lit("")) == ""))
    rows = newest(
        rows.where(F.col("spend_event_id").isNotNull()), ["brand_id", "spend_event_id"], ["ingested_at", "occurred_at", "event_id"],
        ["platform", "level", "campaign_id", "stat_date", "spend_minor", "impressions", "clicks", "occurred_at"],
    )
    day = F.col("stat_date").try_cast("date")
    number = lambda c: F.coalesce(F.col(c).try_cast(BIG), F.lit(0).cast(BIG)).alias(c)
    return rows.where(day.isNotNull()).select(
        "brand_id", "spend_event_id", "platform", "level", "campaign_id", day.alias("stat_date"), F.col("spend_minor").try_cast(BIG).alias("spend_minor"), number("impressions"), number("clicks"), "occurred_at"
    )


def _known(signal: str, value: Column) -> Column:
    """``value``, null until its signal is there."""
    return F.when(F.col(signal).isNotNull(), value)


def cod_outcomes(orders: DataFrame, predictions: DataFrame, shipments: DataFrame) -> DataFrame:
    """Cash-on-delivery orders with their latest prediction and shipment, and whether the prediction was right.

    All three have brand_id, order_id, occurred_at, ingested_at. What a missing signal would tell is null.
    """
    keys, order = ["brand_id", "order_id"], ["occurred_at", "ingested_at"]
    spine = orders.where((F.lower("payment_method") == "cod") & F.col("order_id").isNotNull() & F.col("brand_id").isNotNull())
    spine = newest(spine, keys, order, ["amount_minor", "currency_code", F.col("occurred_at").alias("cod_order_at"), F.col("ingested_at").alias("_o")])
    flag = F.lower("risk_flag").alias("rto_risk_flag")
    risk = newest(predictions.where(F.col("order_id").isNotNull()), keys, order, [flag, F.col("occurred_at").alias("predicted_at"), F.col("ingested_at").alias("_p")])
    kind = F.lower("terminal_class").alias("awb_terminal_class")
    awb = newest(shipments.where(F.col("order_id").isNotNull()), keys, order, [kind, F.col("occurred_at").alias("awb_terminal_at"), F.col("ingested_at").alias("_a")])
    risky, returned = F.col("rto_risk_flag").isin("high", "medium"), F.col("awb_terminal_class") == "rto"
    return spine.join(risk, keys, "left").join(awb, keys, "left").select(
        *keys, F.coalesce("amount_minor", F.lit(0).cast(BIG)).alias("cod_amount_minor"), F.coalesce("currency_code", F.lit("INR")).alias("currency_code"),
        "rto_risk_flag", _known("rto_risk_flag", risky).alias("predicted_rto"), "awb_terminal_class", _known("awb_terminal_class", returned).alias("actual_rto"),
        _known("awb_terminal_class", F.col("awb_terminal_class") == "delivered").alias("actual_delivered"),
        _known("rto_risk_flag", _known("awb_terminal_class", risky == returned)).alias("prediction_correct"),
        "cod_order_at", "predicted_at", "awb_terminal_at", F.greatest("_o", "_p", "_a").alias("ingested_at"),
    )


def customer_nodes(raw: DataFrame) -> DataFrame:
    """Identity nodes, the latest minted version of each; times come as milliseconds."""
    at = lambda c: F.timestamp_millis(F.col(f"{c}_ms")).alias(c)
    rows = raw.where(F.col("brand_id").isNotNull() & F.col("profile_id").isNotNull())
    rows = rows.select("brand_id", "profile_id", "lifecycle_state", "merged_into", at("minted_at"), at("first_identified_at"))
    rank = [F.coalesce("minted_at", F.timestamp_millis(F.lit(0))).alias("m"), F.col("lifecycle_state").alias("l")]
    columns = ["lifecycle_state", "merged_into", "minted_at", "first_identified_at"]
    return rows.groupBy("brand_id", "profile_id").agg(F.max_by(F.struct(*columns), F.struct(*rank)).alias("_b")).select("brand_id", "profile_id", "_b.*")


def customers(order_states: DataFrame, nodes: DataFrame, ingested: str | None = None) -> DataFrame:
    """Orders of each known profile rolled up, with the time at which it was first identified unless it was merged away.

    ``ingested`` names the column whose latest value is the customer's watermark.
    """
    keys = ["brand_id", "profile_id"]
    mark = [F.max(ingested).alias("customer_watermark")] if ingested else []
    rolled = order_states.where(F.col("profile_id").isNotNull()).groupBy(*keys).agg(
        F.count("order_id").alias("lifetime_orders"), F.sum("amount_minor").cast(BIG).alias("lifetime_value_minor"), F.max("currency_code").alias("currency_code"),
        F.min("placed_at").alias("first_seen_at"), F.max("last_at").alias("last_seen_at"), *mark,
    )
    live = nodes.where(F.col("lifecycle_state") != "merged").select(*keys, "first_identified_at")
    return rolled.join(live, keys, "left")


def session_winners(lanes: DataFrame, mapping: DataFrame, recency_days: int = 90) -> DataFrame:
    """The profile of a session, where its identifiers leave one: never a guess.

    ``lanes`` has brand_id, session_id, session_start, lane, identifier_hash, is_strong; ``mapping`` has brand_id,
    identifier_hash, profile_id, last_seen_at. An anonymous match that was last seen over ``recency_days``
    before the session is stale (a shared device). One strong profile wins if no anonymous match
    contradicts it; without strong ones, a single anonymous one does.
    """
    met = lanes.distinct().join(mapping, ["brand_id", "identifier_hash"])
    stale = (F.col("lane") == "anonymous_id") & (F.col("last_seen_at") < F.col("session_start") - F.make_dt_interval(F.lit(recency_days)))
    met = met.where(~F.coalesce(stale, F.lit(False)))
    each = met.groupBy("brand_id", "session_id").agg(
        F.array_sort(F.collect_set("lane")).alias("matched_via"),
        F.collect_set(F.when(F.col("is_strong"), F.col("profile_id"))).alias("_s"), F.collect_set(F.when(F.col("lane") == "anonymous_id", F.col("profile_id"))).alias("_a"),
    )
    strong = F.get("_s", F.lit(0))
    winner = F.when((F.size("_s") == 1) & ((F.size("_a") == 0) | F.array_contains("_a", strong)), strong).when((F.size("_s") == 0) & (F.size("_a") == 1), F.get("_a", F.lit(0)))
    return each.select("brand_id", "session_id", winner.alias("profile_id"), F.array_join("matched_via", ",").alias("matched_via")).where(F.col("profile_id").isNotNull())


# States of a pixel's payment events.
PIXEL_PAYMENTS = (("payment.initiated", "initiated"), ("payment.succeeded", "succeeded"), ("payment.failed", "failed"))


def payments(pixel: DataFrame, connector: DataFrame, webhook: DataFrame) -> DataFrame:
    """Payments of three lanes, one row an event: the latest version, whose whole content is the last key.

    ``pixel`` names its state by event_type and needs no amount; ``connector`` rows count if their entity_type is order_paid
    or payment_authorized; ``webhook`` rows bring payment_status. Money lanes need a positive amount.
    """
    shared = ["brand_id", "event_id", "source", "payment_status", "order_id", "payment_id_hash", "amount_minor", "currency_code", "occurred_at"]
    state = F.coalesce(*[F.when(F.col("event_type") == n, s) for n, s in PIXEL_PAYMENTS], F.lit("unknown"))
    seen = pixel.withColumn("source", F.lit("pixel")).withColumn("payment_status", state).withColumn("payment_id_hash", F.lit(None).cast("string"))
    told = connector.where(F.col("entity_type").isin("order_paid", "payment_authorized")).withColumn("payment_status", F.when(F.col("entity_type") == "order_paid", "paid").otherwise("authorized"))
    money = told.select(*shared).unionByName(webhook.select(*shared)).where(F.col("amount_minor") > 0)
    rows = seen.select(*shared).unionByName(money).where(F.col("brand_id").isNotNull() & F.col("event_id").isNotNull())
    content = [c for c in shared if c not in ("brand_id", "event_id", "occurred_at")]
    return rows.groupBy("brand_id", "event_id").agg(F.max_by(F.struct(*content, "occurred_at"), F.struct("occurred_at", *content)).alias("_b")).select("brand_id", "event_id", "_b.*")


# Fields of a spend event, by type.
SPEND_TEXTS = ("platform", "level", "level_id", "parent_id", "campaign_id", "campaign_name", "currency_code", "advertising_channel_type", "breakdown_key", "quality_ranking", "engagement_rate_ranking", "conversion_rate_ranking", "account_timezone")
SPEND_COUNTS = (
    "conversions", "all_conversions", "conv_value_minor", "view_through_conversions", "cpc_minor", "cpm_minor", "video_views", "reach", "cpp_minor", "unique_clicks", "inline_link_clicks", "outbound_clicks", "unique_outbound_clicks",
    "cost_per_unique_click_minor", "cost_per_inline_link_click_minor", "landing_page_views", "post_engagement", "page_engagement", "inline_post_engagement", "video_p25_watched", "video_p50_watched", "video_p75_watched", "video_p100_watched",
    "video_thruplay_watched", "video_30_sec_watched", "video_avg_time_watched_secs", "engagements", "cost_per_conversion_minor", "value_per_conversion_minor", "all_conversions_value_minor", "cost_per_all_conversions_minor", "average_cost_minor", "interactions",
)
SPEND_RATIOS = (
    "ctr", "frequency", "unique_ctr", "inline_link_click_ctr", "purchase_roas_ratio", "website_purchase_roas_ratio", "mobile_app_purchase_roas_ratio", "video_view_rate", "engagement_rate", "search_impression_share", "search_budget_lost_impression_share",
    "search_rank_lost_impression_share", "absolute_top_impression_percentage", "top_impression_percentage", "interaction_rate", "conversions_from_interactions_rate",
)


def spend_measures(events: DataFrame) -> DataFrame:
    """Spend events at base grain with all their measures, the latest ingested version of each event.

    The envelope is parsed once. A measure that is absent, or can't be read, is null; impressions and clicks are 0 then. Rows
    of a breakdown, without an id, or without a date that can be read are left out.
    """
    names = (*SPEND_TEXTS, "stat_date", "spend_minor", "impressions", "clicks", *SPEND_COUNTS, *SPEND_RATIOS)
    rows = parsed(events, ", ".join(f"{n} string" for n in names)).withColumn("event_id", F.col("event_id").cast("string"))
    rows = rows.where((F.coalesce("event_id", F.lit("")) != "") & (F.coalesce("breakdown_key", F.lit("")) == ""))
    rows = newest(rows, ["brand_id", "event_id"], ["ingested_at", "occurred_at"], [*names, "occurred_at"])
    day, zero = F.col("stat_date").try_cast("date"), F.lit(0).cast(BIG)
    count = lambda n: F.col(n).try_cast(BIG)
    return rows.where(day.isNotNull()).select(
        "brand_id", F.col("event_id").alias("spend_event_id"), *SPEND_TEXTS, day.alias("stat_date"), count("spend_minor").alias("spend_minor"), *[F.coalesce(count(n), zero).alias(n) for n in ("impressions", "clicks")],
        *[count(n).alias(n) for n in SPEND_COUNTS], *[F.col(n).try_cast("double").alias(n) for n in SPEND_RATIOS], "occurred_at",
    )


def form_submissions(events: DataFrame) -> DataFrame:
    """Submitted forms by event, the latest ingested version of each: structure only, never what was entered."""
    fields = "form_id string, form_name string, landing_path string, referrer string, session_id string, brain_anon_id string, device struct<ua_class string, viewport string>"
    rows = parsed(events.where(F.col("event_id").isNotNull() & F.col("brand_id").isNotNull()), fields)
    told = ["form_id", "form_name", F.col("landing_path").alias("page"), "referrer", "session_id", "brain_anon_id", F.col("device.ua_class").alias("device_class"), F.col("device.viewport").alias("viewport")]
    return newest(rows, ["brand_id", "event_id"], ["ingested_at", "occurred_at"], [*told, "occurred_at", "ingested_at"])


# The texts of a settlement, in the table's order.
SETTLEMENT_TEXTS = ("source", "entity_type", "settlement_id", "order_id", "payment_id_hash", "utr_hash", "refund_id_hash", "dispute_id_hash", "dispute_lifecycle", "dispute_direction", "status", "reconciliation_type")


def settlement_details(events: DataFrame) -> DataFrame:
    """Settlements with every field, the latest ingested version of each event; defaults as in ``settlements``."""
    amounts = ("amount_minor", "fee_minor", "tax_minor")
    fields = ", ".join(f"{n} string" for n in (*SETTLEMENT_TEXTS, *amounts, "currency_code", "settlement_at"))
    rows = parsed(events.where(F.col("event_id").isNotNull() & F.col("brand_id").isNotNull()), fields)
    whole = [F.coalesce(F.col(n).try_cast(BIG), F.lit(0).cast(BIG)).alias(n) for n in amounts]
    told = [*SETTLEMENT_TEXTS, *whole, F.coalesce("currency_code", F.lit("INR")).alias("currency_code"), F.col("settlement_at").try_cast("timestamp").alias("settlement_at")]
    return newest(rows, ["brand_id", "event_id"], ["ingested_at", "occurred_at"], [*told, "occurred_at", "ingested_at"])
