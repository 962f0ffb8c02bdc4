"""Submitted forms, match confidence, previews of saved segments and acquisition members, bound to events and profiles."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.operators import confidence as C
from quern.operators import identity as I
from quern.operators import profile as P
from quern.operators import segments as G
from quern.operators import silver as V
from quern.plans.catalogue import query
from quern.plans.folds import pj, text
from quern.plans.profiles import PROFILE_SQL, identity_bands, whole_profile
from quern.plans.shop import sql, touches

FORM_SQL = "'f' || CAST(visitor_id AS VARCHAR) || '-' || CAST(k % 10 AS VARCHAR)"


def form_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Forms made of clicks; some are delivered again with the same id, and all say what was entered."""
    k, v = F.col("k"), text("visitor_id")
    device = F.when(k % 7 != 0, F.struct(F.lit("mobile").alias("ua_class"), F.when(k % 2 == 0, "390x844").alias("viewport")))
    return touches(spark, sf_dir).where(F.col("event_type") == "click").select(
        "brand_id", F.concat(F.lit("f"), v, F.lit("-"), text(k % 10)).alias("event_id"), F.col("seen_at").alias("occurred_at"), F.timestamp_seconds("event_id").alias("ingested_at"),
        pj(form_id=F.concat(F.lit("form"), text(k % 4)), form_name=F.when(k % 3 != 0, F.concat(F.lit("Form "), text(k % 4))), landing_path=F.concat(F.lit("/l/"), text(k % 5)), referrer=F.when(k % 2 == 0, "r"),
           session_id=F.concat(F.lit("ss"), v), brain_anon_id=F.concat(F.lit("a"), v), device=device, fields=F.struct(F.lit("entered").alias("email"))),
    )


@query(
    "s16_form_submissions",
    sql(f"""
, fe AS (SELECT *, {FORM_SQL} AS form_event, row_number() OVER (PARTITION BY brand_id, {FORM_SQL} ORDER BY event_id DESC) AS i FROM e WHERE event_type = 'click')
SELECT brand_id, form_event AS event_id, 'form' || CAST(k % 4 AS VARCHAR) AS form_id, CASE WHEN k % 3 <> 0 THEN 'Form ' || CAST(k % 4 AS VARCHAR) END AS form_name, '/l/' || CAST(k % 5 AS VARCHAR) AS page,
  CASE WHEN k % 2 = 0 THEN 'r' END AS referrer, 'ss' || CAST(visitor_id AS VARCHAR) AS session_id, 'a' || CAST(visitor_id AS VARCHAR) AS brain_anon_id, CASE WHEN k % 7 <> 0 THEN 'mobile' END AS device_class,
  CASE WHEN k % 7 <> 0 AND k % 2 = 0 THEN '390x844' END AS viewport, seen_at AS occurred_at, make_timestamp(CAST(event_id AS BIGINT) * 1000000) AS ingested_at FROM fe WHERE i = 1"""),
)
def form_submissions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Submitted forms, one row an event."""
    return V.form_submissions(form_events(spark, sf_dir))


@query(
    "i_confidence",
    sql("""
, wk AS (SELECT event_id, brand_id, k, least(95, pts + CASE WHEN hits >= 2 THEN 15 ELSE 0 END) AS w FROM (SELECT event_id, brand_id, k,
    CAST(k % 2 = 0 AS INTEGER) * 45 + CAST(k % 11 = 0 AS INTEGER) * 35 + CAST(k % 7 = 0 AS INTEGER) * 15 AS pts, CAST(k % 2 = 0 AS INTEGER) + CAST(k % 11 = 0 AS INTEGER) + CAST(k % 7 = 0 AS INTEGER) AS hits FROM e)),
sc AS (SELECT *, CASE WHEN k % 5 = 0 THEN CASE WHEN k % 20 = 0 THEN 99 ELSE 100 END WHEN k % 3 = 0 AND k % 6 <> 0 THEN CASE brand_id WHEN 'b1' THEN 99 ELSE 60 END WHEN w > 0 THEN w ELSE 0 END AS score FROM wk)
SELECT event_id, score, CASE WHEN score >= 100 THEN 'exact' WHEN score >= 80 THEN 'high' WHEN score >= CASE brand_id WHEN 'b2' THEN 70 ELSE 50 END THEN 'medium' WHEN score >= 1 THEN 'low' ELSE 'none' END AS band,
  CASE WHEN k % 5 = 0 THEN CASE WHEN k % 20 = 0 THEN 'review' WHEN k % 15 = 0 THEN 'merge' ELSE 'link' END WHEN k % 3 = 0 AND k % 6 <> 0 THEN 'adopt' WHEN w > 0 THEN 'review' ELSE 'mint' END AS decision,
  CASE WHEN k % 5 = 0 THEN 'strong_match' || CASE WHEN k % 15 = 0 THEN ',several_profiles' ELSE '' END || CASE WHEN k % 20 = 0 THEN ',conflict' ELSE '' END
    WHEN k % 3 = 0 AND k % 6 <> 0 THEN CASE brand_id WHEN 'b1' THEN 'adoption_clamped,' ELSE '' END || 'medium_match' WHEN w > 0 THEN 'weak_match' WHEN k % 6 = 0 THEN 'ambiguous,no_match' ELSE 'no_match' END AS reasons FROM sc"""),
)
def confidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Score, band and decision of each event's match, by its brand's settings."""
    k, v = F.col("k"), F.col("visitor_id")
    weak = I.weak_score({"device_fingerprint": k % 2 == 0, "cookie_id": k % 11 == 0, "ip": k % 7 == 0})
    evidence = touches(spark, sf_dir).select(
        "event_id", "brand_id", F.when(k % 15 == 0, F.array(v, v + 1)).when(k % 5 == 0, F.array(v, v)).alias("strong_ids"), F.when(k % 6 == 0, F.array(v + 2, v + 3)).when(k % 3 == 0, F.array(v + 2)).alias("medium_ids"),
        weak.alias("weak_score"), F.when(k % 4 == 0, F.lit(True)).alias("conflict"),
    )
    settings = spark.createDataFrame([("b1", None, 100), ("b2", 70, None)], "brand_id string, medium int, adoption int")
    return C.assessed(evidence, settings).select("event_id", "score", "band", "decision", F.array_join("reasons", ",").alias("reasons"))


LIVE_SQL = PROFILE_SQL + ", lv AS (SELECT * FROM pf WHERE NOT (profile_id % 28 = 0 OR profile_id % 33 = 0))\n"

SAVED = (
    ("b0", "busy", {"all": [{"field": "lifetime_orders", "op": "ge", "value": 3}, {"any": [{"field": "churn_risk", "op": "eq", "value": "high"}, {"field": "preferred_channel", "op": "in", "value": ["email", "referral"]}]}]}),
    ("b1", "known", {"not": {"field": "acquisition_source", "op": "missing"}}),
    ("b2", "middling", {"all": [{"field": "lifetime_value_minor", "op": "between", "value": [100_000, 50_000_000]}, {"not": {"field": "preferred_device", "op": "eq", "value": "d1"}}]}),
    ("b9", "nobody", {"field": "lifetime_orders", "op": "ge", "value": 1}),
)


def live_profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.without_merged(whole_profile(spark, sf_dir), identity_bands(spark, sf_dir))


@query(
    "q_segment_preview",
    sql(LIVE_SQL + """
SELECT 'b0' AS brand_id, 'busy' AS segment_id, 'has_data' AS state, count(*) FILTER (WHERE lifetime_orders >= 3 AND (churn_risk = 'high' OR preferred_channel IN ('email', 'referral'))) AS matched, count(*) AS total FROM lv WHERE brand_id = 'b0'
UNION ALL SELECT 'b1', 'known', 'has_data', count(acquisition_source), count(*) FROM lv WHERE brand_id = 'b1'
UNION ALL SELECT 'b2', 'middling', 'has_data', count(*) FILTER (WHERE lifetime_value_minor BETWEEN 100000 AND 50000000 AND preferred_device IS DISTINCT FROM 'd1'), count(*) FROM lv WHERE brand_id = 'b2'
UNION ALL SELECT 'b9', 'nobody', 'no_data', NULL, NULL"""),
)
def segment_preview(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many profiles each saved rule matches, all rules in one pass."""
    saved = spark.createDataFrame([(b, s, json.dumps(d)) for b, s, d in SAVED], "brand_id string, segment_id string, definition string")
    return G.preview(live_profiles(spark, sf_dir), saved)


@query("q_acquisition_members", sql(LIVE_SQL + "SELECT profile_id FROM lv WHERE brand_id = 'b0' AND acquisition_source = 'email'"))
def acquisition_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Profiles that came by one acquisition source."""
    return G.acquired_by(live_profiles(spark, sf_dir), "b0", " email ")
