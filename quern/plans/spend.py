"""Advertising spend with all its measures, over events made of clicks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.operators import silver as V
from quern.plans.catalogue import query
from quern.plans.folds import pj, text
from quern.plans.shop import sql, touches

# A measure is present in every third (counts) or fourth (ratios) value of k, a text in every fifth.
KEYS = [n for n in V.SPEND_TEXTS if n != "breakdown_key"]
_SQL = ", ".join(
    [f"CASE WHEN (k + {i}) % 5 = 0 THEN '{n}' || CAST(k % 3 AS VARCHAR) END AS {n}" for i, n in enumerate(KEYS)]
    + [f"CASE WHEN (k + {i}) % 3 = 0 THEN k * {i} END AS {n}" for i, n in enumerate(V.SPEND_COUNTS)]
    + [f"CASE WHEN (k + {i}) % 4 = 0 THEN (k + {i}) / 8.0 END AS {n}" for i, n in enumerate(V.SPEND_RATIOS)]
)


@query(
    "s17_spend_measures",
    sql(f"""
, sv AS (SELECT *, 'sp' || CAST(visitor_id AS VARCHAR) || '-' || CAST(k % 10 AS VARCHAR) AS spend_event_id FROM e WHERE event_type = 'click' AND k % 6 <> 0),
sw AS (SELECT *, row_number() OVER (PARTITION BY brand_id, spend_event_id ORDER BY event_id DESC) AS i FROM sv)
SELECT brand_id, spend_event_id, NULL AS breakdown_key, CAST(seen_at AS DATE) AS stat_date, value_minor AS spend_minor, CASE WHEN k % 2 = 0 THEN k ELSE 0 END AS impressions, 0 AS clicks, seen_at AS occurred_at, {_SQL} FROM sw WHERE i = 1 AND k % 23 <> 0"""),
)
def spend_measures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spend at base grain with every measure, the latest ingested version of each event."""
    k = F.col("k")
    shift = lambda i: k + F.lit(i)
    told = {n: F.when(shift(i) % 5 == 0, F.concat(F.lit(n), text(k % 3))) for i, n in enumerate(KEYS)}
    told |= {n: F.when(shift(i) % 3 == 0, text(k * F.lit(i))).otherwise("n/a") for i, n in enumerate(V.SPEND_COUNTS)}
    told |= {n: F.when(shift(i) % 4 == 0, text(shift(i) / 8)) for i, n in enumerate(V.SPEND_RATIOS)}
    clicks = touches(spark, sf_dir).where(F.col("event_type") == "click")
    events = clicks.select(
        "brand_id", F.concat(F.lit("sp"), text("visitor_id"), F.lit("-"), text(k % 10)).alias("event_id"), F.col("seen_at").alias("occurred_at"), F.timestamp_seconds("event_id").alias("ingested_at"),
        pj(**told, breakdown_key=F.when(k % 6 == 0, "age").otherwise(""), stat_date=F.when(k % 23 == 0, "n/a").otherwise(F.date_format("seen_at", "yyyy-MM-dd")), spend_minor=text("value_minor"), impressions=F.when(k % 2 == 0, text(k))),
    )
    return V.spend_measures(events).withColumn("breakdown_key", F.nullif(F.col("breakdown_key"), F.lit("")))
