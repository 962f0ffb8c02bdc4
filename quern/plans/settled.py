"""Settlements with every field, bound to orders: payments, refunds and disputes, some of them delivered twice."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.operators import silver as V
from quern.plans.catalogue import query
from quern.plans.folds import TEXT_TIME, pj, text
from quern.plans.shop import orders, sql


def settlement_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One event an order, and for every fourth order a later version that is processed and carries its reconciliation."""
    key = F.col("order_id")
    o = orders(spark, sf_dir).where(F.col("payment_method") == "prepaid")
    o = o.select("*", F.explode(F.sequence(F.lit(0), F.when(key % 4 == 0, 1).otherwise(0))).alias("version"))
    hashed = lambda there, mark: F.when(there, F.sha2(F.concat(F.lit(mark), text(key)), 256))
    disputed = key % 10 == 0
    kind = F.when(disputed, "dispute").when(F.col("is_refunded"), "refund").otherwise("payment")
    fields = {
        "source": F.lit("gateway"), "entity_type": kind, "settlement_id": F.concat(F.lit("s"), text(key)), "order_id": text(key), "payment_id_hash": hashed(F.lit(True), "p"), "utr_hash": hashed(key % 3 != 1, "u"),
        "refund_id_hash": hashed(F.col("is_refunded") & ~disputed, "r"), "dispute_id_hash": hashed(disputed, "d"), "dispute_lifecycle": F.when(disputed, F.when(key % 20 == 0, "won").otherwise("open")),
        "dispute_direction": F.when(disputed, F.when(key % 20 == 0, "credit").otherwise("debit")), "status": F.when(F.col("version") == 1, "processed").otherwise("created"), "reconciliation_type": F.when(F.col("version") == 1, "matched"),
        "amount_minor": F.when(key % 17 == 0, "x1").otherwise(text("amount_minor")), "fee_minor": text(F.expr("amount_minor * 2 div 100")), "currency_code": F.when(key % 5 != 0, F.col("currency_code")),
        "settlement_at": F.when(key % 19 == 0, "soon").otherwise(F.date_format("placed_at", TEXT_TIME)),
    }
    arrived = F.col("placed_at") + F.make_dt_interval(F.col("version"))
    return o.select("brand_id", key.alias("event_id"), F.col("placed_at").alias("occurred_at"), arrived.alias("ingested_at"), pj(**fields))


@query(
    "s15_settlement_details",
    sql("""SELECT brand_id, order_id AS event_id, 'gateway' AS source, CASE WHEN order_id % 10 = 0 THEN 'dispute' WHEN is_refunded THEN 'refund' ELSE 'payment' END AS entity_type, 's' || CAST(order_id AS VARCHAR) AS settlement_id, CAST(order_id AS VARCHAR) AS order_id,
  sha256('p' || CAST(order_id AS VARCHAR)) AS payment_id_hash, CASE WHEN order_id % 3 <> 1 THEN sha256('u' || CAST(order_id AS VARCHAR)) END AS utr_hash, CASE WHEN is_refunded AND order_id % 10 <> 0 THEN sha256('r' || CAST(order_id AS VARCHAR)) END AS refund_id_hash,
  CASE WHEN order_id % 10 = 0 THEN sha256('d' || CAST(order_id AS VARCHAR)) END AS dispute_id_hash, CASE WHEN order_id % 20 = 0 THEN 'won' WHEN order_id % 10 = 0 THEN 'open' END AS dispute_lifecycle,
  CASE WHEN order_id % 20 = 0 THEN 'credit' WHEN order_id % 10 = 0 THEN 'debit' END AS dispute_direction, CASE WHEN order_id % 4 = 0 THEN 'processed' ELSE 'created' END AS status, CASE WHEN order_id % 4 = 0 THEN 'matched' END AS reconciliation_type,
  CASE WHEN order_id % 17 = 0 THEN 0 ELSE amount_minor END AS amount_minor, amount_minor * 2 // 100 AS fee_minor, CAST(0 AS BIGINT) AS tax_minor, CASE WHEN order_id % 5 = 0 THEN 'INR' ELSE currency_code END AS currency_code,
  CASE WHEN order_id % 19 <> 0 THEN placed_at END AS settlement_at, placed_at AS occurred_at, placed_at + CASE WHEN order_id % 4 = 0 THEN INTERVAL 1 DAY ELSE INTERVAL 0 DAY END AS ingested_at FROM o WHERE payment_method = 'prepaid'"""),
)
def settlement_details(spark: SparkSession, sf_dir: str) -> DataFrame:
    """S15 with every field: the last version of each settlement."""
    return V.settlement_details(settlement_events(spark, sf_dir))
