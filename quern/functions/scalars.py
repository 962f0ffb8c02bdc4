"""Scalar rules as Column functions: ladders, rates, money and reference codes. All stay on the JVM."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Event name prefixes by category, in the order in which they apply.
CATEGORY_PREFIXES = (
    ("transaction", ("order.", "refund.", "payment.", "settlement.")),
    ("marketing", ("spend.", "ad.")),
    ("fulfillment", ("shiprocket.", "fulfillment.")),
    ("support", ("ticket.", "call.", "support.")),
    ("behaviour", ("page.", "product.", "collection.", "cart.", "session.", "scroll.", "element.", "search.", "form.", "user.")),
)
BEHAVIOUR_NAMES = ("dead.click", "rage.click", "exit_intent", "video", "identify", "pixel.identify.v1", "coupon.applied", "download", "share")
IDENTIFY_NAMES = ("identify", "pixel.identify.v1")
# Click identifiers by paid channel, in the order in which they apply, then media.
CLICK_CHANNELS = (
    ("paid_meta", ("fbclid",)),
    ("paid_google", ("gclid", "gbraid", "wbraid", "dclid")),
    ("paid_tiktok", ("ttclid",)),
    ("paid_bing", ("msclkid",)),
)
MEDIUM_CHANNELS = (("paid", ("cpc", "ppc", "paid")), ("email", ("email",)), ("organic_social", ("social", "paid_social")), ("referral", ("referral",)))
# Substrings of refund notes by reason, first match wins.
REASONS = (
    ("rto", ("rto", "return to origin", "undelivered")),
    ("damaged", ("damage", "defect", "broken")),
    ("cancellation", ("cancel",)),
    ("return", ("return", "exchange")),
)
# Carrier states by terminal class.
TERMINAL_STATES = (
    ("rto", ("rto", "rto initiated", "rto in transit", "rto undelivered", "rto out for delivery", "rto delivered", "rto ofd", "rto acknowledged", "rto rejected", "rto ndr", "rto disposed")),
    ("delivered", ("delivered", "completed")),
    ("other", ("cancelled", "lost", "damaged", "returned", "canceled", "destroyed", "disposed", "disposed of")),
)


def ladder(steps: list[tuple[Column, str]], otherwise: str | None) -> Column:
    """The label of the first condition that holds."""
    out = F.when(F.lit(False), F.lit(None).cast("string"))
    for condition, label in steps:
        out = out.when(condition, F.lit(label))
    return out.otherwise(F.lit(otherwise))


def any_of(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, conditions)


def event_category(event_type: Column) -> Column:
    name = F.trim(F.lower(F.coalesce(event_type, F.lit(""))))
    starts = {c: any_of([name.startswith(p) for p in ps]) for c, ps in CATEGORY_PREFIXES}
    steps = [
        ((name == "") | name.endswith(".upsert.v1"), "other"),
        (starts["transaction"], "transaction"),
        (starts["marketing"], "marketing"),
        (starts["fulfillment"] | (name == "gokwik.rto_predict.v1"), "fulfillment"),
        (starts["support"], "support"),
        (name.isin(*BEHAVIOUR_NAMES) | starts["behaviour"] | name.contains("checkout"), "behaviour"),
    ]
    return ladder(steps, "other")


def identify_denied(event_type: Column, consent_state: Column, analytics: Column) -> Column:
    """Whether an identify event lacks consent; other events are never denied here."""
    state = F.lower(F.trim(consent_state)) != "granted"
    flag = F.coalesce(F.lower(F.trim(analytics)) == "false", F.lit(False))
    is_identify = F.coalesce(event_type.isin(*IDENTIFY_NAMES), F.lit(False))
    return F.when(~is_identify, False).when(consent_state.isNotNull(), state).otherwise(flag)


def channel(fields: dict[str, Column]) -> Column:
    """Marketing channel of a touch from its click identifiers, medium and referrer; absent fields are null."""
    has = lambda f: F.coalesce(fields[f] != "", F.lit(False)) if f in fields else F.lit(False)
    medium = F.lower(F.coalesce(fields.get("utm_medium", F.lit(None).cast("string")), F.lit("")))
    steps = [(any_of([has(f) for f in fs]), label) for label, fs in CLICK_CHANNELS]
    steps += [(medium.isin(*ms), label) for label, ms in MEDIUM_CHANNELS]
    return ladder([*steps, (has("referrer"), "referral")], "direct")


def reason_code(note: Column) -> Column:
    text = F.lower(F.trim(note))
    steps = [(text.isNull() | (text == ""), "other")]
    steps += [(any_of([text.contains(s) for s in ss]), code) for code, ss in REASONS]
    return ladder(steps, "customer_request")


def terminal_class(status: Column) -> Column:
    """Class of a carrier's state text, whatever its case, underscores, hyphens and spaces."""
    text = F.trim(F.regexp_replace(F.lower(F.coalesce(status, F.lit(""))), r"[_\s-]+", " "))
    return ladder([(text.isin(*states), c) for c, states in TERMINAL_STATES], "none")


def value_tier(value: Column) -> Column:
    return ladder([(value >= 100_000, "high_value"), (value >= 50_000, "mid_value"), (value > 0, "low_value")], "no_realized_value")


def lifecycle_segment(recency: Column, orders: Column, value: Column) -> Column:
    steps = [
        (recency > 180, "churned"),
        (recency > 90, "at_risk"),
        ((value >= 10_000_000) & (orders >= 5) & (recency <= 60), "VIP"),
        ((orders >= 5) & (recency <= 90), "loyal"),
        (value >= 5_000_000, "high_value"),
        ((orders == 1) & (value > 0), "first_time_buyer"),
        (value == 0, "cart_abandoner"),
    ]
    return ladder(steps, "window_shopper")


def health_score(recency: Column, orders: Column) -> Column:
    fresh = F.when(recency <= 30, 60).when(recency <= 60, 45).when(recency <= 90, 30).when(recency <= 180, 15).otherwise(0)
    often = F.when(orders >= 10, 40).when(orders >= 5, 30).when(orders >= 3, 20).when(orders >= 2, 10).otherwise(5)
    return (fresh + often).cast("int")


def health_band(recency: Column) -> Column:
    return ladder([(recency <= 90, "healthy"), (recency <= 180, "at_risk")], "churned")


def churn_risk(recency: Column) -> Column:
    return ladder([(recency > 180, "high"), (recency > 90, "medium")], "low")


def churn_score(risk: Column) -> Column:
    return F.when(risk == "low", 15).when(risk == "medium", 55).when(risk == "high", 85)


def lifecycle_stage(band: Column, orders: Column) -> Column:
    new = F.coalesce(orders <= 1, F.lit(True))
    return F.when(band == "healthy", F.when(new, "new").otherwise("active")).when(band.isin("churned", "at_risk"), band)


def whole(numerator: Column, denominator: Column) -> Column:
    """Integer quotient truncated toward zero; null where the denominator is null or zero."""
    n, d = numerator.cast("decimal(38,0)"), denominator.cast("decimal(38,0)")
    negative = (n < 0) != (d < 0)
    size = F.floor(F.abs(n) / F.nullif(F.abs(d), F.lit(0).cast("decimal(38,0)"))).cast("bigint")
    return F.when(negative, -size).otherwise(size)


def quotient(numerator: Column, denominator: Column) -> Column:
    """Integer quotient of two bigints, truncated toward zero; null for a zero denominator."""
    return F.call_function("div", numerator.cast("bigint"), F.nullif(denominator.cast("bigint"), F.lit(0).cast("bigint")))


def bps(numerator: Column, denominator: Column) -> Column:
    return quotient(numerator * 10_000, denominator)


def minor(amount: Column, scale: int = 2) -> Column:
    """A double amount in minor units."""
    return F.round(amount * 10**scale).cast("bigint")


def half_even(amount: Column, divisor: int) -> Column:
    """amount / divisor rounded half to even, exact for any bigint."""
    return F.bround(amount.cast("decimal(30,0)") / F.lit(divisor).cast("decimal(10,0)"), 0).cast("bigint")


def letter_grade(fraction: Column) -> Column:
    """Data-quality grade of a failure fraction; what isn't a number, or is negative, is the worst."""
    bad = fraction.isNull() | F.isnan(fraction) | (fraction < 0)
    return ladder([(bad, "D"), (fraction <= 0, "A+"), (fraction <= 0.25, "A"), (fraction <= 0.5, "B"), (fraction <= 1.0, "C")], "D")


CROCKFORD = "0123456789ABCDEFGHJKMNPQRSTVWXYZ"


def reference_code(uuid: Column, prefix: str = "BRN-", digits: int = 12) -> Column:
    """A short printed form of an id: Crockford base-32 digits of the leading bits of its hex form."""
    bits = F.lpad(F.conv(F.substring(F.regexp_replace(uuid, "-", ""), 1, 15), 16, 2), 60, "0")
    at = lambda i: F.conv(F.substring(bits, i * 5 + 1, 5), 2, 10).cast("int") + 1
    return F.concat(F.lit(prefix), *[F.substring(F.lit(CROCKFORD), at(i), F.lit(1)) for i in range(digits)])


def deterministic_id(*parts: Column) -> Column:
    """sha-256 of NUL-joined parts, as hex."""
    return F.sha2(F.concat_ws("\u0000", *[p.cast("string") for p in parts]), 256)


def uuid_of(*parts: Column) -> Column:
    """A version-5-shaped UUID from the parts' digest."""
    return uuid_shaped(deterministic_id(*parts))


def uuid_shaped(h: Column) -> Column:
    """The first half of a hex digest in the shape of a version 5 UUID; the digest is used twice, as its cost is."""
    variant = F.translate(F.substring(h, 17, 1), "0123456789abcdef", "89ab" * 4)
    half = F.overlay(F.overlay(F.substring(h, 1, 32), F.lit("5"), 13, 1), variant, 17, 1)
    return F.regexp_replace(half, "^(.{8})(.{4})(.{4})(.{4})(.{12})$", "$1-$2-$3-$4-$5")
