"""Orders stitched to the visitor that their customer is known by, through identity links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.operators.identity import identifier_hash
from quern.operators.upsert import merge_on_key

PROFILE = ["brand_id", "profile_id"]


def known_visitors(touches: DataFrame, links: DataFrame, salt: str = "", kind: str = "anon_id") -> DataFrame:
    """Per customer the first and the last visitor (as text) that active links name.

    ``touches`` has brand_id and visitor_id; ``links`` brand_id, identifier_type, identifier_hash, profile_id, is_active. Visitors
    are made distinct before they are hashed, so a busy one is hashed once a task and joined once. Least and greatest tell
    one visitor from several without gathering them.
    """
    visitors = touches.select("brand_id", F.col("visitor_id").cast("string").alias("visitor_id")).where(F.coalesce("visitor_id", F.lit("")) != "").distinct()
    hashed = visitors.withColumn("identifier_hash", identifier_hash(salt, kind, F.trim("visitor_id")))
    live = links.where((F.col("identifier_type") == kind) & F.col("is_active") & F.col("profile_id").isNotNull()).select(*PROFILE, "identifier_hash").distinct()
    met = hashed.join(live, ["brand_id", "identifier_hash"])
    return met.groupBy(*PROFILE).agg(F.min("visitor_id").alias("visitor_id"), F.max("visitor_id").alias("last_visitor_id"))


def stitched_orders(ledger: DataFrame, visitors: DataFrame) -> DataFrame:
    """Orders of customers with exactly one known visitor. ``ledger`` has brand_id, order_id, profile_id, several rows an order.

    Nothing is guessed: a customer with several visitors stitches none, nor does an order that the ledger gives to
    customers with different visitors.
    """
    one = visitors.where(F.col("visitor_id") == F.col("last_visitor_id")).select(*PROFILE, "visitor_id")
    each = ledger.where(F.col("order_id").isNotNull()).select("brand_id", "order_id", "profile_id").distinct().join(one, PROFILE)
    least = each.groupBy("brand_id", "order_id").agg(F.min(F.struct("visitor_id", "profile_id")).alias("_a"), F.max("visitor_id").alias("_z"))
    return least.where(F.col("_a.visitor_id") == F.col("_z")).select("brand_id", "order_id", "_a.visitor_id", "_a.profile_id")


def upsert_stitches(old: DataFrame, fresh: DataFrame) -> DataFrame:
    """The stitch map after a run: new stitches win, orders that this run didn't stitch keep theirs. A rerun changes nothing."""
    return merge_on_key(old, fresh, ["brand_id", "order_id"], [F.asc("visitor_id"), F.asc("profile_id")])


def outcome(visitors: DataFrame, stitches: DataFrame) -> DataFrame:
    """Per brand: orders stitched, and customers passed over since they have several visitors."""
    several = visitors.groupBy("brand_id").agg(F.count_if(F.col("visitor_id") != F.col("last_visitor_id")).alias("ambiguous"))
    done = stitches.groupBy("brand_id").agg(F.count("*").alias("stitched"))
    zero = F.lit(0).cast("bigint")
    return several.join(done, "brand_id", "full_outer").select("brand_id", F.coalesce("stitched", zero).alias("stitched"), F.coalesce("ambiguous", zero).alias("ambiguous"))
