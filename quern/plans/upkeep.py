"""Maintenance and vendor mapping, bound to the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.functions.scalars import minor
from quern.operators import costs as C
from quern.operators import maintenance as X
from quern.operators import upsert as U
from quern.operators.tables import StoredTable
from quern.plans.catalogue import query
from quern.plans.shop import orders, sql, touches
from quern.session import scratch, table
from quern.sources.vendors import canonical


@query("x_log_dedup", sql("SELECT visitor_id, event_type, max(event_id) AS event_id, arg_max(value_minor, event_id) AS value_minor FROM e GROUP BY 1, 2"))
def log_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The latest raw row of each key."""
    rows = touches(spark, sf_dir).select("visitor_id", "event_type", "event_id", "value_minor")
    return X.dedup_log(rows, ["visitor_id", "event_type"], ["event_id"])


@query("x_retention", sql("SELECT event_id, seen_at FROM e WHERE seen_at >= TIMESTAMP '2024-01-18'"))
def log_retention(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of the last two weeks."""
    return X.retain(touches(spark, sf_dir).select("event_id", "seen_at"), "seen_at", "2024-02-01", 14)


@query("x_erasure", sql("SELECT order_id, customer_id FROM o WHERE customer_id NOT IN (SELECT customer_id FROM o WHERE is_refunded AND order_id % 2 = 0)"))
def erasure(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The log without erased subjects."""
    rows = orders(spark, sf_dir)
    subjects = rows.where(F.col("is_refunded") & (F.col("order_id") % 2 == 0))
    return X.erase(rows.select("order_id", "customer_id"), subjects, "customer_id")


def _payload(df: DataFrame, **fields) -> DataFrame:
    return df.select("brand_id", F.to_json(F.struct(*[c.alias(n) for n, c in fields.items()])).alias("payload"))


@query(
    "v_ad_spend_mapping",
    sql("""SELECT brand_id, CAST(k AS VARCHAR) AS campaign_id, value_minor AS spend_minor, k AS clicks, 'meta' AS vendor FROM e WHERE event_type = 'click'
  UNION ALL SELECT brand_id, CAST(k AS VARCHAR), value_minor, k, 'google' FROM e WHERE event_type = 'click'"""),
)
def ad_spend_mapping(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spend of two vendors, in major units and in micros, to the same minor units."""
    rows = touches(spark, sf_dir).where(F.col("event_type") == "click")
    key = F.col("k").cast("string")
    text = (F.col("value_minor").cast("decimal(20,2)") / 100).cast("decimal(20,2)").cast("string")
    meta = _payload(rows, campaign_id=key, level=F.lit("campaign"), date_start=F.lit("2024-01-01"), account_currency=F.lit("INR"), spend=text, clicks=key)
    campaign, metrics = F.struct(key.alias("id")), F.struct((F.col("value_minor") * 10_000).cast("string").alias("costMicros"), key.alias("clicks"))
    google = _payload(rows, campaign=campaign, metrics=metrics, level=F.lit("campaign"), segments=F.struct(F.lit("2024-01-01").alias("date")))
    keep = lambda df, v: df.select("brand_id", "campaign_id", "spend_minor", "clicks", F.lit(v).alias("vendor"))
    return keep(canonical(meta, "meta_insight"), "meta").unionByName(keep(canonical(google, "google_row"), "google"))


@query(
    "v_order_mapping",
    sql("""SELECT brand_id, CAST(order_id AS VARCHAR) AS order_id, amount_minor, sha256(concat_ws(chr(0), '', 'email', 'u' || customer_id || '@x.example')) AS email_hash,
  CASE WHEN terminal_class = 'none' THEN 'none' ELSE terminal_class END AS terminal_class FROM o"""),
)
def order_mapping(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders of a vendor: exact amounts, hashed identifiers, classified states."""
    rows = orders(spark, sf_dir)
    text = (F.col("amount_minor").cast("decimal(20,2)") / 100).cast("decimal(20,2)").cast("string")
    email = F.concat(F.lit(" U"), F.col("customer_id").cast("string"), F.lit("@X.example "))
    state = F.when(F.col("terminal_class") == "rto", "RTO_Delivered").when(F.col("terminal_class") == "delivered", " Delivered").otherwise("in transit")
    raw = _payload(rows, moid=F.col("order_id").cast("string"), total=text, customer=F.struct(email.alias("email")), order_status=state)
    return canonical(raw, "gokwik_order").select("brand_id", "order_id", "amount_minor", "email_hash", "terminal_class")


def part_sheet(spark: SparkSession, sf_dir: str, number: int, every: int, start: str, end: str | None, share: int) -> DataFrame:
    """One upload of costs for every so-many-th part."""
    key = F.col("p_partkey")
    cost = F.call_function("div", minor(F.col("p_retailprice")) * share, F.lit(100).cast("bigint"))
    return table(spark, sf_dir, "part").where(key % every == 0).select(
        F.concat(F.lit("b"), (key % 3).cast("string")).alias("brand_id"), key.alias("sku"), F.lit(start).cast("date").alias("valid_from"), F.lit(end).cast("date").alias("valid_to"), cost.alias("cost_minor"), F.lit(number).alias("upload")
    )


UPLOADS = ((1, 1, "2024-01-01", None, 60), (2, 2, "2024-03-01", "2024-05-01", 70), (3, 3, "2024-02-01", "2024-04-01", 55))

SHEET_SQL = """WITH up(n, every, f, t, share) AS (VALUES (1, 1, DATE '2024-01-01', DATE '9999-12-31', 60), (2, 2, DATE '2024-03-01', DATE '2024-05-01', 70), (3, 3, DATE '2024-02-01', DATE '2024-04-01', 55)),
sg(a, z) AS (VALUES (DATE '2024-01-01', DATE '2024-02-01'), (DATE '2024-02-01', DATE '2024-03-01'), (DATE '2024-03-01', DATE '2024-04-01'), (DATE '2024-04-01', DATE '2024-05-01'), (DATE '2024-05-01', DATE '9999-12-31')),
w AS (SELECT p_partkey, a, z, max(n) AS n FROM part JOIN up ON p_partkey % every = 0 JOIN sg ON f <= a AND a < t GROUP BY 1, 2, 3),
i AS (SELECT *, sum(CASE WHEN n = was THEN 0 ELSE 1 END) OVER (PARTITION BY p_partkey ORDER BY a) AS run FROM (SELECT *, lag(n) OVER (PARTITION BY p_partkey ORDER BY a) AS was FROM w)),
bd AS (SELECT p_partkey, n, min(a) AS valid_from, max(z) AS z FROM i GROUP BY p_partkey, run, n)
SELECT 'b' || CAST(p_partkey % 3 AS VARCHAR) AS brand_id, p_partkey AS sku, valid_from, CASE WHEN z < DATE '9999-12-31' THEN z END AS valid_to, CAST(round(p_retailprice * 100) AS BIGINT) * share // 100 AS cost_minor, n AS upload
FROM bd JOIN up USING (n) JOIN part USING (p_partkey)"""


@query("q_cost_sheet_corrections", SHEET_SQL)
def cost_sheet_corrections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A cost sheet after three uploads that overlap, one of them a correction in the past: open bands are closed and split."""
    first, *later = (part_sheet(spark, sf_dir, *u) for u in UPLOADS)
    for upload in later:
        first = C.correct(first, upload, ["brand_id", "sku"])
    return first


@query(
    "q_cost_sheet_refusals",
    """SELECT 'b' || CAST(p_partkey % 3 AS VARCHAR) AS brand_id, p_partkey AS sku, CASE WHEN p_partkey % 2 = 0 THEN 'overlaps a stored band' ELSE 'taken' END AS outcome,
  CASE WHEN p_partkey % 2 = 0 THEN 60 ELSE 80 END * CAST(round(p_retailprice * 100) AS BIGINT) // 100 AS cost_minor FROM part""",
)
def cost_sheet_refusals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Uploads that overlap are refused, those of a known start restate it: each part's cost afterwards."""
    key = ["brand_id", "sku"]
    sheet = part_sheet(spark, sf_dir, 1, 1, "2024-01-01", None, 60)
    again = part_sheet(spark, sf_dir, 2, 1, "2024-01-01", None, 80).where(F.col("sku") % 2 == 1)
    clash = part_sheet(spark, sf_dir, 2, 2, "2024-03-01", "2024-05-01", 70)
    kept, refused = C.refuse_overlaps(sheet, again.unionByName(clash), key)
    return kept.join(refused.select(*key, "reason"), key, "left").select(*key, F.coalesce("reason", F.lit("taken")).alias("outcome"), "cost_minor")


@query(
    "f11_ordered_parity",
    sql("""
, rt AS (SELECT order_id, CASE WHEN order_id % 1000 <> 7 THEN amount_minor END AS amount_minor FROM o WHERE NOT is_cancelled),
lt AS (SELECT order_id, amount_minor FROM o WHERE order_id % 3 <> 0),
dl AS (SELECT concat_ws('|', CAST(order_id AS VARCHAR), CAST(amount_minor AS VARCHAR)) AS t, (row_number() OVER (ORDER BY order_id) - 1) // 4096 AS c, order_id FROM lt WHERE order_id IN (SELECT order_id FROM rt)),
dr AS (SELECT concat_ws('|', CAST(order_id AS VARCHAR), CAST(amount_minor AS VARCHAR)) AS t, (row_number() OVER (ORDER BY order_id) - 1) // 4096 AS c, order_id FROM rt WHERE order_id IN (SELECT order_id FROM lt)),
ml AS (SELECT c, md5(string_agg(t, chr(10) ORDER BY order_id)) AS d FROM dl GROUP BY 1), mr AS (SELECT c, md5(string_agg(t, chr(10) ORDER BY order_id)) AS d FROM dr GROUP BY 1),
xl AS (SELECT CASE WHEN count(*) = 1 THEN min(d) ELSE md5(string_agg(d, chr(10) ORDER BY c)) END AS d FROM ml), xr AS (SELECT CASE WHEN count(*) = 1 THEN min(d) ELSE md5(string_agg(d, chr(10) ORDER BY c)) END AS d FROM mr)
SELECT count(*) FILTER (rt.order_id IS NULL) AS only_left, count(*) FILTER (lt.order_id IS NULL) AS only_right, count(*) FILTER (lt.order_id = rt.order_id AND lt.amount_minor IS DISTINCT FROM rt.amount_minor) AS different,
  count(*) FILTER (lt.order_id = rt.order_id AND lt.amount_minor IS NOT DISTINCT FROM rt.amount_minor) AS equal, (SELECT d FROM xl) AS left_digest, (SELECT d FROM xr) AS right_digest, (SELECT d FROM xl) = (SELECT d FROM xr) AS same_order
FROM lt FULL OUTER JOIN rt ON lt.order_id = rt.order_id"""),
)
def ordered_parity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F11 with digests of both sides in key order over the keys they share."""
    o = orders(spark, sf_dir)
    right = o.where(~F.col("is_cancelled")).select("order_id", F.when(F.col("order_id") % 1000 != 7, F.col("amount_minor")).alias("amount_minor"))
    return U.ordered_parity(o.where(F.col("order_id") % 3 != 0).select("order_id", "amount_minor"), right, ["order_id"])


@query(
    "x_erasure_by_path",
    sql("SELECT event_id FROM e WHERE NOT coalesce(visitor_id % 10 = 3 AND k % 2 = 0, false) AND NOT coalesce(visitor_id % 10 = 4 AND k % 3 = 0, false) AND NOT coalesce(visitor_id % 7 = 5 AND event_type = 'view', false)"),
)
def erasure_by_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The raw log after subjects were erased whom its payloads name at several paths; run twice."""
    v, mark = F.col("visitor_id"), lambda p, on: F.when(on, F.concat(F.lit(p), F.col("visitor_id").cast("string")))
    rows = touches(spark, sf_dir)
    envelope = F.struct(
        "brand_id", mark("h", F.col("k") % 2 == 0).alias("hashed_user_id"),
        F.struct(mark("h", F.col("k") % 3 == 0).alias("hashed_email"), mark("a", F.col("event_type") == "view").alias("anon_id")).alias("properties"),
    )
    log = rows.select("event_id", F.to_json(envelope).alias("payload"))
    people = rows.select("brand_id", v).distinct()
    named = lambda kind, p, on: people.where(on).select("brand_id", F.lit(kind).alias("kind"), F.concat(F.lit(p), v.cast("string")).alias("value"))
    # Of ten visitors one is named by user id alone, one by mail alone: paths of a kind are alike, so each is given where it can be met.
    subjects = named("user", "h", v % 10 == 3).unionByName(named("mail", "h", v % 10 == 4)).unionByName(named("anon", "a", v % 7 == 5))
    held = StoredTable(spark, scratch(spark, "log"), ["event_id"], 8)
    held.replace(log)
    paths = {"user": ["hashed_user_id"], "mail": ["properties.hashed_email"], "anon": ["properties.anon_id"]}
    X.erase_payloads(held, subjects, "brand_id", paths)
    if X.erase_payloads(held, subjects, "brand_id", paths):
        raise AssertionError("a second run erased more")
    return held.read().select("event_id")
