"""Probabilistic stitching of anonymous visitors to identified people, and the versioned journey ledger.

Visitors are compared by their features only, so equal features are one row with a count: blocks join
different feature combinations, not visitors. A hot block's pairs are spread over cells of bounded size. m and u are
fitted (``fit``) or given.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Probabilities that a level is met by a match (m) and by two visitors at random (u), and that two at random match.
Model = dict[str, tuple[tuple[float, float], ...]]
MODEL: Model = {
    "ua_class": ((0.9, 0.3), (0.1, 0.7)),
    "screen_class": ((0.9, 0.2), (0.1, 0.8)),
    "daypart": ((0.7, 0.25), (0.3, 0.75)),
    "active_hours": ((0.6, 0.05), (0.2, 0.1), (0.15, 0.25), (0.05, 0.6)),
    "top_products": ((0.5, 0.01), (0.3, 0.04), (0.15, 0.15), (0.05, 0.8)),
}
PRIOR = 0.001
FLOOR = 0.95
FIT_BUCKET = 64  # visitors that are compared with each other to fit m and u
CELL_ROWS = 2000  # rows a side of a block's cell
SHARED = (3, 2, 1)  # sizes of intersections that are levels of their own
BLOCKS = (("screen_class", "daypart"), ("ua_class",))


def features(devices: DataFrame, views: DataFrame) -> DataFrame:
    """Per brand and visitor: ua_class, screen_class, active hours, products, daypart, and the person if it was identified.

    ``devices`` has brand_id, visitor_id, at, ua_class, screen_class, email (of an identify event, else null);
    ``views`` has brand_id, visitor_id, at, product.
    """
    keys = ["brand_id", "visitor_id"]
    dev = devices.groupBy(*keys).agg(
        F.max("ua_class").alias("ua_class"), F.max("screen_class").alias("screen_class"), F.min("email").alias("email"), F.collect_set(F.hour("at")).alias("_h")
    )
    seen = views.groupBy(*keys).agg(F.array_sort(F.collect_set(F.when(F.col("product") != "", F.col("product")))).alias("top_products"), F.collect_set(F.hour("at")).alias("_t"))
    none = F.array().cast("array<int>")
    hours = F.array_sort(F.array_union(F.coalesce("_h", none), F.coalesce("_t", none)))
    out = dev.join(seen, keys, "full_outer").withColumn("active_hours", hours).withColumn("top_products", F.coalesce("top_products", F.array().cast("array<string>")))
    person = F.when(F.col("email").isNotNull(), F.concat(F.lit("DET-"), F.sha1(F.concat_ws("|", "brand_id", "email"))))
    daypart = F.floor(F.get("active_hours", F.lit(0)) / 6).cast("int")
    return out.select(*keys, "ua_class", "screen_class", daypart.alias("daypart"), "active_hours", "top_products", person.alias("person"))


def _level(name: str, x: Column, y: Column) -> Column:
    """Which level two values are at, 0 the best; null where one is missing."""
    if len(MODEL[name]) == 2:
        return F.when(x.isNull() | y.isNull(), None).otherwise(F.when(x == y, 0).otherwise(1))
    n = F.size(F.array_intersect(x, y))
    return F.when(x.isNull() | y.isNull(), None).when(n >= SHARED[0], 0).when(n >= SHARED[1], 1).when(n >= SHARED[2], 2).otherwise(3)


def _weight(name: str, x: Column, y: Column, model: Model) -> Column:
    """log2 of m/u of the level that two values are at; nothing is told where one is missing."""
    level = _level(name, x, y)
    told = F.lit(0.0)
    for i, (m, u) in enumerate(model[name]):
        told = F.when(level == i, math.log2(m / u)).otherwise(told)
    return told


def _bucketed(rows: DataFrame, keys: list[str], most: int) -> DataFrame:
    """``rows`` with a bucket of about ``most`` rows at most within their keys, by a hash of the visitor."""
    n = rows.groupBy(*keys).agg(F.ceil(F.count("*") / most).alias("_n"))
    return rows.join(n, keys).withColumn("_bucket", F.pmod(F.xxhash64(F.lit(26), "visitor_id"), F.col("_n"))).drop("_n")


def _levels(rows: DataFrame, keys: list[str], most: int, apart: bool) -> dict[str, list[int]]:
    """How many pairs within a bucket are at each level of each comparison."""
    names = list(MODEL)
    dealt = _bucketed(rows, keys, most).select("visitor_id", "person", *names, F.struct(*keys, "_bucket").alias("_k"))
    a, b = dealt.alias("a"), dealt.alias("b")
    pairs = a.join(b, (F.col("a._k") == F.col("b._k")) & (F.col("a.visitor_id") < F.col("b.visitor_id")))
    if apart:
        pairs = pairs.where(~F.coalesce(F.col("a.person") == F.col("b.person"), F.lit(False)))
    told = F.array(*[F.struct(F.lit(c).alias("name"), _level(c, F.col(f"a.{c}"), F.col(f"b.{c}")).alias("level")) for c in names])
    counts = pairs.select(F.inline(told)).where(F.col("level").isNotNull()).groupBy("name", "level").count().collect()  # a row a level
    out = {c: [0] * len(MODEL[c]) for c in names}
    for r in counts:
        out[r["name"]][r["level"]] = r["count"]
    return out


def fit(visitors: DataFrame, most: int = FIT_BUCKET) -> Model:
    """m and u of every level: shares among pairs of one known person, and among pairs that no person joins.

    Pairs are those within buckets of about ``most`` visitors, of a person for m and of a tenant for u, dealt by a hash: persons of up
    to that many visitors are compared whole, larger ones and tenants by an unbiased share of pairs that grows with their rows, not
    with their square. Half a pair is added to each level, so that none is impossible.
    """
    same = _levels(visitors.where(F.col("person").isNotNull()), ["brand_id", "person"], most, False)
    other = _levels(visitors, ["brand_id"], most, True)
    share = lambda n: [(x + 0.5) / (sum(n) + 0.5 * len(n)) for x in n]
    return {c: tuple(zip(share(same[c]), share(other[c]), strict=True)) for c in MODEL}


def _in_blocks(a: DataFrame, b: DataFrame, keys: list[str], most: int) -> tuple[DataFrame, DataFrame]:
    """Both sides of a block join with a cell ``_cell`` to join by besides ``keys``: a block is a grid of cells of ``most`` rows a side.

    A row goes to every cell of its line or column, so every pair of a block meets in one cell, and no task gets more
    than ``most`` times ``most`` pairs of a block, however hot it is.
    """
    known = lambda df, n: df.where(F.forall(F.array(*[F.col(k).isNull() for k in keys]), lambda x: ~x)).groupBy(*keys).agg(F.ceil(F.count("*") / most).cast("int").alias(n))
    sizes = known(a, "_na").join(known(b, "_nb"), keys)
    own = lambda salt, n: F.pmod(F.xxhash64(F.lit(salt), *[F.to_json(F.struct(*MODEL))]), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    left = a.join(sizes, keys).withColumn("_i", own(1, "_na")).withColumn("_j", every("_nb"))
    right = b.join(sizes, keys).withColumn("_j", own(2, "_nb")).withColumn("_i", every("_na"))
    cell = F.struct("_i", "_j").alias("_cell")
    return left.select(*a.columns, cell), right.select(*b.columns, cell)


def stitched(visitors: DataFrame, floor: float = FLOOR, prior: float = PRIOR, model: Model | None = None, most: int = CELL_ROWS) -> DataFrame:
    """Per anonymous visitor its best identified person, where the match probability reaches ``floor``.

    Pairs have exactly one identified side, share a block of one tenant, and tie by the smaller person. ``model`` is what
    ``fit`` gives, or the fixed one.
    """
    names, model = list(MODEL), model or MODEL
    told = visitors.where(F.col("person").isNotNull()).groupBy("brand_id", *names).agg(F.min("person").alias("person"))
    asked = visitors.where(F.col("person").isNull()).select("brand_id", *names).distinct()
    pairs = None
    for i, block in enumerate(BLOCKS):
        a, b = (x.alias(n) for x, n in zip(_in_blocks(asked, told, ["brand_id", *block], most), "ab", strict=True))
        same = (F.col("a.brand_id") == F.col("b.brand_id")) & (F.col("a._cell") == F.col("b._cell"))
        for c in block:
            same = same & (F.col(f"a.{c}") == F.col(f"b.{c}"))
        for earlier in BLOCKS[:i]:  # a pair that an earlier block has made
            met = F.lit(True)
            for c in earlier:
                met = met & F.coalesce(F.col(f"a.{c}") == F.col(f"b.{c}"), F.lit(False))
            same = same & ~met
        one = a.join(b, same).select(F.struct("a.brand_id", *[F.col(f"a.{c}") for c in names]).alias("x"), F.struct(*[F.col(f"b.{c}") for c in names]).alias("y"), "b.person")
        pairs = one if pairs is None else pairs.unionByName(one)
    total = F.lit(math.log2(prior / (1 - prior)))
    for c in names:
        total = total + _weight(c, F.col(f"x.{c}"), F.col(f"y.{c}"), model)
    scored = pairs.withColumn("confidence", F.round(1 / (1 + F.pow(F.lit(2.0), -total)), 9)).where(F.col("confidence") >= floor)
    best = scored.groupBy("x").agg(F.min_by(F.struct("person", "confidence"), F.struct(-F.col("confidence"), "person")).alias("_b")).select("x.*", "_b.*")
    on = F.col("v.brand_id") == F.col("k.brand_id")
    for c in names:
        on = on & F.col(f"v.{c}").eqNullSafe(F.col(f"k.{c}"))
    return visitors.where(F.col("person").isNull()).alias("v").join(best.alias("k"), on).select("v.brand_id", "v.visitor_id", "k.person", "k.confidence")


def journey_ledger(touches: DataFrame, bands: DataFrame, orders: DataFrame, stored: DataFrame, signals: list[str]) -> DataFrame:
    """First versions of the journey ledger: one row a touch, numbered within its profile.

    ``touches`` has brand_id, visitor_id, touch_seq, profile_id (null if unknown), occurred_at, is_composite,
    order_key and the columns ``signals``; ``bands`` are half-open intervals (brand_id, profile_id, confidence,
    effective_from, effective_to); ``orders`` give revenue to composite touches only; ``stored`` (brand_id,
    touchpoint_id, data_version) tells which touches a later version has superseded.
    """
    ref = F.concat_ws("||", "brand_id", F.col("visitor_id").cast("string"), F.col("touch_seq").cast("string"))
    profile = F.coalesce(F.col("profile_id").cast("string"), F.concat(F.lit("anonymous_"), F.col("visitor_id").cast("string")))
    rows = touches.withColumn("touchpoint_id", F.sha2(ref, 256)).withColumn("profile_id", profile)
    in_order = Window.partitionBy("brand_id", "profile_id").orderBy("occurred_at", "touch_seq", "visitor_id")
    rows = rows.withColumn("sequence_number", F.row_number().over(in_order).cast("bigint"))
    known = F.array(*[F.struct(F.lit(c).alias("key"), F.col(c).cast("string").alias("value")) for c in signals])
    rows = rows.withColumn("attribution_signals", F.map_from_entries(F.filter(known, lambda s: F.coalesce(s["value"], F.lit("")) != "")))
    e, m = rows.select("brand_id", "touchpoint_id", "profile_id", "occurred_at").alias("e"), bands.withColumn("profile_id", F.col("profile_id").cast("string")).alias("m")
    covers = (F.col("m.effective_from") <= F.col("e.occurred_at")) & (F.col("m.effective_to").isNull() | (F.col("e.occurred_at") < F.col("m.effective_to")))
    at = e.join(m, (F.col("e.brand_id") == F.col("m.brand_id")) & (F.col("e.profile_id") == F.col("m.profile_id")) & covers)
    at = at.groupBy("e.brand_id", "e.touchpoint_id").agg(F.max("m.profile_id").alias("profile_id_asof"), F.max("m.confidence").alias("confidence_asof"))
    money = orders.select("brand_id", F.col("order_id").alias("order_key"), F.col("amount_minor").alias("revenue_minor"), "currency_code")
    versions = stored.groupBy("brand_id", "touchpoint_id").agg(F.max("data_version").alias("_v"))
    composite = rows.where("is_composite").join(money, ["brand_id", "order_key"], "left")
    plain = rows.where(~F.coalesce(F.col("is_composite"), F.lit(False)))
    out = composite.unionByName(plain, allowMissingColumns=True).join(at, ["brand_id", "touchpoint_id"], "left").join(versions, ["brand_id", "touchpoint_id"], "left")
    return out.withColumn("data_version", F.lit(1)).withColumn("is_current", F.coalesce(F.col("_v") == 1, F.lit(True))).drop("_v")
