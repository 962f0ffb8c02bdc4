"""The customer profile: one row a customer, with commerce, marketing, health, scores and a JSON timeline.

Keys are brand_id and profile_id. The row set is the spine's (``silver.customers``); every other input is folded to
the key before it is joined, so no join multiplies rows, and all joins share the key's partitioning.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern.functions import scalars as R
from quern.operators.marts import mode

KEYS = ["brand_id", "profile_id"]
TIMELINE = 200
UTC_TEXT = "yyyy-MM-dd'T'HH:mm:ss'Z'"


def known(c: str) -> Column:
    return F.coalesce(F.col(c) != "", F.lit(False))


def order_facts(states: DataFrame, as_of: str) -> DataFrame:
    """Outcome counts, and frequency and recency of orders, in one aggregate; an order is one row."""
    last = F.max("placed_at")
    of = lambda s: F.count_if(F.col("state") == s).alias(f"{s}_orders")
    each = states.where(F.col("profile_id").isNotNull()).groupBy(*KEYS)
    return each.agg(
        *[of(s) for s in ("delivered", "rto", "cancelled", "refunded")], F.count("order_id").alias("frequency"), last.alias("last_order_at"),
        F.date_diff(F.lit(as_of).cast("date"), last).alias("recency_days"),
    )


def touch_facts(touches: DataFrame) -> DataFrame:
    """Most frequent channel, first touch's channel and last activity.

    Touches are counted by channel first, combined before the shuffle; a hot customer is then a few rows.
    """
    rows = touches.where(F.col("profile_id").isNotNull())
    first = F.when(F.col("is_first_touch"), 0).when(~F.col("is_first_touch"), 1).otherwise(2)
    met = F.struct(first.alias("f"), F.col("occurred_at").isNull().alias("n"), F.col("occurred_at").alias("t"))
    by = rows.groupBy(*KEYS, "channel").agg(F.count("*").alias("_n"), F.min(met).alias("_m"), F.max("occurred_at").alias("_t"))
    of = lambda order: F.min_by(F.when(known("channel"), F.col("channel")), F.when(known("channel"), order))
    return by.groupBy(*KEYS).agg(
        of(F.struct(-F.col("_n"), F.col("channel"))).alias("preferred_channel"), of(F.struct("_m", "channel")).alias("acquisition_source"), F.max("_t").alias("last_activity_at")
    )


def timeline(touches: DataFrame, limit: int = TIMELINE) -> DataFrame:
    """The last ``limit`` touches as a JSON array, newest first; fields that are null are left out.

    The rank's limit is applied before the shuffle too, so a hot customer sends ``limit`` rows a task.
    """
    extra = ["event_type", "channel", "page_type", "product_handle", "order_id", "is_first_touch"]
    newest = [F.desc_nulls_last(c) for c in ("occurred_at", "touch_seq", "visitor_id", *extra)]
    w = Window.partitionBy(*KEYS).orderBy(*newest)
    rows = touches.where(F.col("profile_id").isNotNull()).select(*KEYS, "occurred_at", "touch_seq", "visitor_id", *extra)
    rows = rows.withColumn("seq", F.row_number().over(w)).where(F.col("seq") <= limit)
    text = F.to_json(F.struct("seq", F.date_format("occurred_at", UTC_TEXT).alias("ts"), *extra))
    array = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", text.alias("j")))), lambda x: x["j"]), ",")
    return rows.groupBy(*KEYS).agg(F.concat(F.lit("["), array, F.lit("]")).alias("journey_summary"))


def devices(touches: DataFrame, views: DataFrame) -> DataFrame:
    """Most frequent device of the page views of each customer's visitors.

    Views are counted by visitor and device before they meet the visitors' customers.
    """
    bridge = touches.where(F.col("profile_id").isNotNull() & F.col("visitor_id").isNotNull()).select(*KEYS, "visitor_id").distinct()
    counted = views.where(known("device")).groupBy("brand_id", "visitor_id", "device").agg(F.count("*").alias("n"))
    rows = counted.join(bridge, ["brand_id", "visitor_id"]).groupBy(*KEYS, "device").agg(F.sum("n").alias("n"))
    return rows.groupBy(*KEYS).agg(F.min_by("device", F.struct(-F.col("n"), F.col("device"))).alias("preferred_device"))


def categories(states: DataFrame, lines: DataFrame) -> DataFrame:
    """Most frequent title among each customer's order lines."""
    owners = states.where(F.col("profile_id").isNotNull()).select(*KEYS, "order_id")
    rows = lines.where(known("title")).select("brand_id", "order_id", "title").join(owners, ["brand_id", "order_id"])
    return mode(rows, KEYS, "title", "top_category")


def steps(value: Column, bounds: list[int], down: bool = False) -> Column:
    """5 for the first bound met, then 4, 3 and 2; 1 for none, or for a null."""
    out = F.lit(None).cast("int")
    for points, bound in zip(range(2, 6), reversed(bounds), strict=True):
        out = F.when(value <= bound if down else value >= bound, points).otherwise(out)
    return F.coalesce(out, F.lit(1))


def profiles(
    customers: DataFrame, states: DataFrame, touches: DataFrame, views: DataFrame, lines: DataFrame, as_of: str, *, changed: DataFrame | None = None
) -> DataFrame:
    """The profile of each of ``customers``.

    ``states`` has brand_id, profile_id, order_id, state, placed_at, one row an order; ``touches`` brand_id, profile_id (null where not
    stitched), visitor_id, occurred_at, touch_seq, event_type, channel, page_type, product_handle, order_id,
    is_first_touch; ``views`` brand_id, visitor_id, device; ``lines`` brand_id, order_id, title. A customer without
    touches, views or lines has nulls there, zeros in its counts. With ``changed`` (keys), only those customers are
    folded, each over its whole history: merging the result on the key equals a fold of all.
    """
    if changed is not None:
        only = changed.select(*KEYS).distinct()
        customers, states, touches = (df.join(only, KEYS, "left_semi") for df in (customers, states, touches))
    out = customers
    for part in (order_facts(states, as_of), touch_facts(touches), timeline(touches), devices(touches, views), categories(states, lines)):
        out = out.join(part, KEYS, "left")
    zero, orders, value = F.lit(0).cast("bigint"), F.col("lifetime_orders"), F.col("lifetime_value_minor")
    days, fresh, often = F.date_diff(F.lit(as_of).cast("date"), "last_seen_at"), F.col("recency_days"), F.col("frequency")
    scored = lambda c: F.when(often.isNotNull(), c)
    risk = R.churn_risk(days)
    average = F.when(orders > 0, R.quotient(value, orders))
    uuid = R.uuid_of(F.col("brand_id"), F.col("profile_id"))
    band = scored(R.health_band(fresh))
    return out.select(
        *KEYS, R.reference_code(uuid).alias("customer_ref"), "lifetime_orders", "lifetime_value_minor", average.alias("aov_minor"), "currency_code", "first_seen_at", "first_identified_at", "last_seen_at",
        F.coalesce("last_activity_at", "last_seen_at").alias("last_activity_at"), *[F.coalesce(c, zero).alias(c) for c in ("delivered_orders", "rto_orders", "cancelled_orders", "refunded_orders")],
        "preferred_channel", "preferred_device", "top_category", "acquisition_source", band.alias("health_band"), R.churn_score(risk).alias("churn_score"), R.lifecycle_stage(band, orders).alias("lifecycle_stage"),
        "journey_summary", "recency_days", "frequency", scored(R.health_score(fresh, often)).alias("health_score"), "last_order_at", days.alias("days_since_last_order"),
        steps(days, [30, 60, 90, 180], down=True).alias("recency_score"), steps(orders, [10, 5, 3, 2]).alias("frequency_score"), steps(value, [10_000_000, 5_000_000, 1_000_000, 200_000]).alias("monetary_score"),
        risk.alias("churn_risk"), R.lifecycle_segment(days, F.coalesce(orders, zero), F.coalesce(value, zero)).alias("segment"), "customer_watermark", F.lit(as_of).cast("timestamp").alias("updated_at"),
    )


def without_merged(profile: DataFrame, mapping: DataFrame) -> DataFrame:
    """Profiles without those that were merged away: known to the identity map, but with no live current band there.

    A profile of which the map knows nothing stays. ``mapping`` has the keys, is_current and system_to.
    """
    live = F.coalesce(F.col("is_current") & F.col("system_to").isNull(), F.lit(False))
    gone = mapping.groupBy(*KEYS).agg(F.bool_or(live).alias("_live")).where(~F.col("_live")).select(*KEYS)
    return profile.join(gone, KEYS, "left_anti")
