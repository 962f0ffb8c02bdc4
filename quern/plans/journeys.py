"""Sessions, touches, journeys, paths, funnels and channel attribution, bound to ``events``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quern.functions.hashing import murmur3
from quern.functions.scalars import deterministic_id
from quern.operators import attribution as A
from quern.operators import ledger as L
from quern.operators import marts as M
from quern.operators import sessions as S
from quern.plans.catalogue import query
from quern.plans.revenue import total
from quern.plans.shop import sql, touches
from quern.session import stored

VISITOR = ["brand_id", "visitor_id"]
STAGES = ("view", "click", "signup", "purchase")


def is_type(name: str) -> Column:
    return F.col("event_type") == name


def sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.sessionize(touches(spark, sf_dir), VISITOR, "seen_at", "event_id")


@query(
    "s4_touchpoint",
    sql("""SELECT brand_id, visitor_id, event_id, session_seq, touch_seq, touch_seq = 1 AS is_first_touch, touch_back = 1 AS is_last_touch, channel,
  event_type = 'purchase' AND coalesce(CAST(floor(epoch(seen_at)) AS BIGINT) - CAST(floor(epoch(lag(seen_at) OVER
    (PARTITION BY visitor_id, event_type ORDER BY seen_at, event_id))) AS BIGINT) <= 86400, false) AS is_composite FROM s"""),
)
def touchpoint(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sessions by a gap of 30 minutes, touch order, channel ladder, repeats of a transaction."""
    rows = S.repeats_within(sessions(spark, sf_dir), [*VISITOR, "event_type"], "seen_at", "event_id", 86_400)
    composite = (is_type("purchase") & F.col("is_composite")).alias("is_composite")
    return rows.select("brand_id", "visitor_id", "event_id", "session_seq", "touch_seq", "is_first_touch", "is_last_touch", "channel", composite)


@query("s4a_session_key")
def session_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A signed 32-bit hash names each session; only sessions are hashed, not touches."""
    each = sessions(spark, sf_dir).select(*VISITOR, "session_seq").distinct()
    return each.withColumn("session_key", murmur3(F.concat_ws("|", "brand_id", "visitor_id", "session_seq")))


@query(
    "s5_sessions",
    sql("""SELECT brand_id, visitor_id, session_seq, count(*) AS touches, min(seen_at) AS started_at, max(seen_at) AS ended_at,
  arg_min(channel, touch_seq) AS first_channel, arg_max(channel, touch_seq) AS last_channel, arg_min(event_type, touch_seq) AS first_type, arg_max(event_type, touch_seq) AS last_type,
  bool_or(event_type = 'purchase') AS converted, CAST(floor(epoch(max(seen_at))) AS BIGINT) - CAST(floor(epoch(min(seen_at))) AS BIGINT) AS duration_s, count(*) = 1 AS bounced
  FROM s GROUP BY 1, 2, 3"""),
)
def session_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per session."""
    return S.rollup_sessions(sessions(spark, sf_dir), VISITOR, "seen_at", {"channel": "channel", "type": "event_type"}, is_type("purchase"))


@query(
    "s6_journey",
    sql("""SELECT brand_id, visitor_id, count(*) AS touches, max(session_seq) AS sessions, arg_min(channel, touch_seq) AS first_channel,
  arg_max(channel, touch_seq) AS last_channel, bool_or(event_type = 'purchase') AS converted,
  date_diff('day', CAST(min(seen_at) AS DATE), CAST(min(seen_at) FILTER (WHERE event_type = 'purchase') AS DATE)) AS days_to_convert FROM s GROUP BY 1, 2"""),
)
def journey(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per visitor with days to the first conversion."""
    bought = F.min(F.when(is_type("purchase"), F.col("seen_at")))
    return (
        sessions(spark, sf_dir)
        .groupBy(*VISITOR)
        .agg(
            F.count("*").alias("touches"), F.max("session_seq").alias("sessions"), F.min_by("channel", "touch_seq").alias("first_channel"),
            F.max_by("channel", "touch_seq").alias("last_channel"), F.bool_or(is_type("purchase")).alias("converted"),
            F.date_diff(bought, F.min("seen_at")).cast("bigint").alias("days_to_convert"),
        )
    )


@query(
    "s7_page_view",
    sql("""SELECT brand_id, event_id, CASE event_type WHEN 'view' THEN 'page' WHEN 'click' THEN 'product' ELSE 'other' END AS page_event,
  CASE WHEN k % 10 = 8 THEN 'site.example' END AS referrer_host, channel FROM e WHERE event_type IN ('view', 'click')"""),
)
def page_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Page facts with the referrer's host, without its www."""
    referrer = F.when(F.col("k") % 10 == 8, F.lit("https://www.site.example/a"))
    host = F.nullif(F.regexp_extract(referrer, r"^[a-z]+://(?:www\.)?([^/:?#]+)", 1), F.lit(""))
    kind = F.when(is_type("view"), "page").when(is_type("click"), "product").otherwise("other")
    return touches(spark, sf_dir).where(F.col("event_type").isin("view", "click")).select("brand_id", "event_id", kind.alias("page_event"), host.alias("referrer_host"), "channel")


@query(
    "s4_order_match",
    sql("""SELECT p.event_id AS purchase_id, c.event_id AS click_id FROM (SELECT * FROM e WHERE event_type = 'purchase') p
  LEFT JOIN (SELECT * FROM e WHERE event_type = 'click') c ON c.brand_id = p.brand_id AND abs(epoch_us(c.seen_at) - epoch_us(p.seen_at)) <= 60000000"""),
)
def order_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Purchases with the clicks of their tenant within 60 seconds on either side."""
    rows = touches(spark, sf_dir)
    bought = rows.where(is_type("purchase")).select("brand_id", F.col("event_id").alias("purchase_id"), "seen_at")
    clicks = rows.where(is_type("click")).select("brand_id", F.col("event_id").alias("click_id"), F.col("seen_at").alias("clicked_at"))
    return S.near_in_time(bought, clicks, ["brand_id"], "seen_at", "clicked_at", 60).select("purchase_id", "click_id")


def paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per visitor the channels up to the last purchase (all, if there is none), in order, and whether one came."""
    rows = sessions(spark, sf_dir)
    last = F.max(F.when(is_type("purchase"), F.col("touch_seq"))).over(Window.partitionBy(*VISITOR))
    used = rows.withColumn("_last", last).where(F.col("_last").isNull() | (F.col("touch_seq") <= F.col("_last")))
    return used.groupBy(*VISITOR).agg(S.ordered("channel", "touch_seq").alias("path"), F.bool_or(F.col("_last").isNotNull()).alias("converted"))


PATHS_SQL = """
, lp AS (SELECT *, max(CASE WHEN event_type = 'purchase' THEN touch_seq END) OVER (PARTITION BY visitor_id) AS last_buy FROM s),
up AS (SELECT *, lag(channel) OVER (PARTITION BY visitor_id ORDER BY touch_seq) AS before FROM lp WHERE last_buy IS NULL OR touch_seq <= last_buy),
cp AS (SELECT brand_id, visitor_id, list(channel ORDER BY touch_seq) FILTER (WHERE before IS NULL OR before <> channel) AS path, bool_or(last_buy IS NOT NULL) AS converted
  FROM up GROUP BY 1, 2)
"""


@query("g30_attribution_paths", sql(PATHS_SQL + "SELECT brand_id, visitor_id, array_to_string(path, ' > ') AS path, len(path) AS steps, converted FROM cp"))
def attribution_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each visitor's channels in order, repeats collapsed."""
    p = paths(spark, sf_dir).withColumn("path", S.collapse(F.col("path")))
    return p.select("brand_id", "visitor_id", F.array_join("path", " > ").alias("path"), F.size("path").cast("bigint").alias("steps"), "converted")


@query(
    "g36_journey_paths",
    sql(PATHS_SQL + """, sg AS (SELECT brand_id, array_to_string(path[1:3], ' > ') AS signature, count(*) AS visitors, count(*) FILTER (WHERE converted) AS conversions FROM cp GROUP BY 1, 2)
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY brand_id ORDER BY visitors DESC, signature) AS rank FROM sg) WHERE rank <= 50"""),
)
def journey_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 50 most frequent path signatures of each tenant (paths cut at three steps)."""
    p = paths(spark, sf_dir).withColumn("path", F.slice(S.collapse(F.col("path")), 1, 3))
    n = p.groupBy("brand_id", F.array_join("path", " > ").alias("signature")).agg(F.count("*").alias("visitors"), F.count_if(F.col("converted")).alias("conversions"))
    return M.top_n(n, ["brand_id"], [F.desc("visitors"), F.asc("signature")], 50)


@query(
    "g36_journey_paths_whole",
    sql(PATHS_SQL + """, sg AS (SELECT brand_id, array_to_string(path[1:12], ' > ') AS signature, count(*) AS visitors, count(*) FILTER (WHERE converted) AS conversions FROM cp GROUP BY 1, 2)
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY brand_id ORDER BY visitors DESC, signature) AS rank FROM sg) WHERE rank <= 50"""),
)
def journey_paths_whole(spark: SparkSession, sf_dir: str) -> DataFrame:
    """G36 as in the reference: path signatures of up to twelve steps."""
    p = paths(spark, sf_dir).withColumn("path", F.slice(S.collapse(F.col("path")), 1, 12))
    n = p.groupBy("brand_id", F.array_join("path", " > ").alias("signature")).agg(F.count("*").alias("visitors"), F.count_if(F.col("converted")).alias("conversions"))
    return M.top_n(n, ["brand_id"], [F.desc("visitors"), F.asc("signature")], 50)


@query(
    "q_journey_edges",
    sql(PATHS_SQL + """, ed AS (SELECT brand_id, i AS step, path[i] AS from_channel, path[i + 1] AS to_channel FROM (SELECT *, unnest(range(1, least(len(path), 12))) AS i FROM cp))
SELECT brand_id, step, from_channel, to_channel, count(*) AS n FROM ed GROUP BY 1, 2, 3, 4"""),
)
def journey_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Moves between channels by step, of paths cut at twelve steps (for a flow diagram)."""
    p = paths(spark, sf_dir).select("brand_id", F.slice(S.collapse(F.col("path")), 1, 12).alias("path"))
    return p.select("brand_id", F.inline(S.edges(F.col("path")))).groupBy("brand_id", "step", "from_channel", "to_channel").agg(F.count("*").alias("n"))


@query(
    "g11_funnel",
    sql("""SELECT brand_id, CAST(seen_at AS DATE) AS day, count(DISTINCT visitor_id || '|' || session_seq) FILTER (WHERE event_type = 'view') AS view,
  count(DISTINCT visitor_id || '|' || session_seq) FILTER (WHERE event_type = 'click') AS click, count(DISTINCT visitor_id || '|' || session_seq) FILTER (WHERE event_type = 'signup') AS signup,
  count(DISTINCT visitor_id || '|' || session_seq) FILTER (WHERE event_type = 'purchase') AS purchase FROM s GROUP BY 1, 2"""),
)
def funnel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct sessions by stage and day, by two plain aggregates in place of four DISTINCT counts."""
    rows = sessions(spark, sf_dir).withColumn("day", F.col("seen_at").cast("date"))
    return M.stage_counts(rows, ["brand_id", "day"], F.struct("visitor_id", "session_seq"), {s: is_type(s) for s in STAGES})


@query(
    "g12_funnel_user",
    sql("""SELECT *, CASE WHEN purchase THEN 'purchase' WHEN signup THEN 'signup' WHEN click THEN 'click' WHEN view THEN 'view' ELSE 'none' END AS furthest FROM (
  SELECT brand_id, visitor_id, bool_or(event_type = 'view') AS view, bool_or(event_type = 'click') AS click, bool_or(event_type = 'signup') AS signup,
  bool_or(event_type = 'purchase') AS purchase FROM e GROUP BY 1, 2)"""),
)
def funnel_user(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The furthest stage of each visitor."""
    return M.furthest_stage(touches(spark, sf_dir), VISITOR, {s: is_type(s) for s in STAGES})


@query(
    "g13_abandoned_cart",
    sql("""SELECT brand_id, CAST(seen_at AS DATE) AS day, count(DISTINCT session_seq || '|' || visitor_id) FILTER (WHERE event_type = 'signup') AS cart_sessions,
  count(*) FILTER (WHERE event_type = 'error') AS abandoned, CAST(coalesce(sum(value_minor) FILTER (WHERE event_type = 'error'), 0) AS BIGINT) AS abandoned_minor
  FROM s GROUP BY 1, 2"""),
)
def abandoned_cart(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cart sessions against abandoned checkouts and their value."""
    each = (
        sessions(spark, sf_dir)
        .groupBy("brand_id", F.col("seen_at").cast("date").alias("day"), "visitor_id", "session_seq")
        .agg(F.bool_or(is_type("signup")).alias("cart"), F.count_if(is_type("error")).alias("n"), total(F.when(is_type("error"), F.col("value_minor"))).alias("v"))
    )
    return each.groupBy("brand_id", "day").agg(F.count_if("cart").alias("cart_sessions"), F.sum("n").alias("abandoned"), total("v").alias("abandoned_minor"))


@query(
    "g14_behavior",
    sql("""SELECT brand_id, CAST(seen_at AS DATE) AS day, event_type, count(*) AS views, count(DISTINCT visitor_id || '|' || session_seq) AS sessions,
  count(DISTINCT visitor_id) AS visitors FROM s GROUP BY 1, 2, 3"""),
)
def behavior(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Views, sessions and visitors by day and page type, through nested aggregates."""
    by = ["brand_id", "day", "event_type"]
    each = sessions(spark, sf_dir).withColumn("day", F.col("seen_at").cast("date")).groupBy(*by, "visitor_id", "session_seq").agg(F.count("*").alias("views"))
    each = each.groupBy(*by, "visitor_id").agg(F.sum("views").alias("views"), F.count("*").alias("sessions"))
    return each.groupBy(*by).agg(F.sum("views").alias("views"), F.sum("sessions").alias("sessions"), F.count("*").alias("visitors"))


@query(
    "g15_conversion_feedback",
    sql("""SELECT f.brand_id, f.day, f.submissions, coalesce(p.payments, 0) AS payments, coalesce(p.paid_minor, 0) AS paid_minor FROM
  (SELECT brand_id, CAST(seen_at AS DATE) AS day, count(*) AS submissions FROM e WHERE event_type = 'signup' GROUP BY 1, 2) f LEFT JOIN
  (SELECT brand_id, CAST(seen_at AS DATE) AS day, count(*) AS payments, CAST(sum(value_minor) AS BIGINT) AS paid_minor FROM e WHERE event_type = 'purchase' GROUP BY 1, 2) p
  USING (brand_id, day)"""),
)
def conversion_feedback(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Form submissions beside the day's payments; both sides come from one aggregate."""
    rows = touches(spark, sf_dir).where(F.col("event_type").isin("signup", "purchase"))
    out = rows.groupBy("brand_id", F.col("seen_at").cast("date").alias("day")).agg(
        F.count_if(is_type("signup")).alias("submissions"), F.count_if(is_type("purchase")).alias("payments"), total(F.when(is_type("purchase"), F.col("value_minor"))).alias("paid_minor")
    )
    return out.where(F.col("submissions") > 0)


@query(
    "g34_utm_source",
    sql("""SELECT brand_id, first_channel, count(*) AS visitors, count(*) FILTER (WHERE converted) AS conversions, CAST(sum(paid) AS BIGINT) AS revenue_minor,
  CAST(sum(paid) AS BIGINT) // nullif(count(*) FILTER (WHERE converted), 0) AS ltv_minor FROM (
  SELECT brand_id, visitor_id, arg_min(channel, touch_seq) AS first_channel, bool_or(event_type = 'purchase') AS converted,
  coalesce(sum(value_minor) FILTER (WHERE event_type = 'purchase'), 0) AS paid FROM s GROUP BY 1, 2) GROUP BY 1, 2"""),
)
def utm_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Visitors, conversions and revenue by channel of the first touch."""
    each = (
        touches(spark, sf_dir)
        .groupBy(*VISITOR)
        .agg(
            F.min_by("channel", F.struct("seen_at", "event_id")).alias("first_channel"), F.bool_or(is_type("purchase")).alias("converted"),
            total(F.when(is_type("purchase"), F.col("value_minor"))).alias("paid"),
        )
    )
    out = each.groupBy("brand_id", "first_channel").agg(F.count("*").alias("visitors"), F.count_if("converted").alias("conversions"), total("paid").alias("revenue_minor"))
    return out.withColumn("ltv_minor", F.expr("revenue_minor div nullif(conversions, 0L)"))


@query(
    "g39_recent_events",
    sql("""SELECT brand_id, event_id, event_type, rank FROM (SELECT *, row_number() OVER (PARTITION BY brand_id ORDER BY seen_at DESC, event_id DESC) AS rank FROM e) WHERE rank <= 200"""),
)
def recent_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The newest 200 events of each tenant; Spark keeps 200 rows a task before the shuffle."""
    return M.top_n(touches(spark, sf_dir), ["brand_id"], [F.desc("seen_at"), F.desc("event_id")], 200).select("brand_id", "event_id", "event_type", "rank")


def journeys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Touches of visitors who purchased, up to the first purchase, with its amount."""
    rows = sessions(spark, sf_dir)
    w = Window.partitionBy(*VISITOR)
    bought = F.min(F.when(is_type("purchase"), F.struct("touch_seq", "seen_at", "value_minor"))).over(w)
    used = rows.withColumn("_b", bought).where(F.col("touch_seq") <= F.col("_b.touch_seq"))
    return used.select(*VISITOR, "touch_seq", "event_id", "channel", F.col("_b.value_minor").alias("amount_minor"), F.col("_b.seen_at").alias("bought_at"))


JOURNEY_SQL = """
, fb AS (SELECT *, min(CASE WHEN event_type = 'purchase' THEN touch_seq END) OVER (PARTITION BY visitor_id) AS buy_seq FROM s),
tj AS (SELECT f.*, b.value_minor AS amount_minor, b.seen_at AS bought_at, f.buy_seq AS n
  FROM fb f JOIN s b ON b.visitor_id = f.visitor_id AND b.touch_seq = f.buy_seq WHERE f.touch_seq <= f.buy_seq),
mw AS (SELECT t.*, m.model, CASE m.model WHEN 'first_touch' THEN CAST(touch_seq = 1 AS BIGINT) WHEN 'last_touch' THEN CAST(touch_seq = n AS BIGINT) WHEN 'linear' THEN 1
    WHEN 'position_based' THEN CASE WHEN n <= 2 THEN 1 WHEN touch_seq IN (1, n) THEN 2 * (n - 2) ELSE 1 END
    ELSE CASE WHEN n - touch_seq > 60 THEN 0 ELSE CAST(1 AS BIGINT) << CAST(60 - (n - touch_seq) AS BIGINT) END END AS raw
  FROM tj t CROSS JOIN (VALUES ('first_touch'), ('last_touch'), ('linear'), ('position_based'), ('time_decay')) AS m(model)),
w1 AS (SELECT *, sum(CAST(raw AS HUGEINT)) OVER (PARTITION BY visitor_id, model) AS total, CAST(100000000 AS HUGEINT) * raw AS product FROM mw),
w2 AS (SELECT *, product // total AS part, product % total AS rest FROM w1),
w3 AS (SELECT *, CAST(part AS BIGINT) + CASE WHEN row_number() OVER (PARTITION BY visitor_id, model ORDER BY rest DESC,
    CASE WHEN touch_seq = 1 THEN 0 WHEN touch_seq = n THEN 1 ELSE touch_seq END) <= 100000000 - sum(part) OVER (PARTITION BY visitor_id, model) THEN 1 ELSE 0 END AS weight FROM w2),
c1 AS (SELECT *, CAST(abs(amount_minor) AS HUGEINT) * weight // 100000000 AS cpart, CAST(abs(amount_minor) AS HUGEINT) * weight % 100000000 AS crest FROM w3),
cr AS (SELECT *, CAST(CAST(sign(amount_minor) AS HUGEINT) * (cpart + CASE WHEN row_number() OVER (PARTITION BY visitor_id, model ORDER BY crest DESC, touch_seq)
    <= abs(amount_minor) - sum(cpart) OVER (PARTITION BY visitor_id, model) THEN 1 ELSE 0 END) AS BIGINT) AS credit_minor FROM c1)
"""


def credited(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.credits(A.weights(journeys(spark, sf_dir), VISITOR, "touch_seq"), VISITOR, "amount_minor", "touch_seq")


@query(
    "g28_attribution_credit",
    sql(JOURNEY_SQL + """SELECT sha256(concat_ws(chr(0), brand_id, CAST(visitor_id AS VARCHAR), CAST(event_id AS VARCHAR), model)) AS credit_id, brand_id, visitor_id, event_id, model, channel,
  weight // 100000000 || '.' || lpad(CAST(weight % 100000000 AS VARCHAR), 8, '0') AS weight_fraction, credit_minor FROM cr"""),
)
def attribution_credit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact credits of five models; weights add up to one and credits to the amount."""
    key = deterministic_id(F.col("brand_id"), F.col("visitor_id"), F.col("event_id"), F.col("model"))
    return credited(spark, sf_dir).select(key.alias("credit_id"), *VISITOR, "event_id", "model", "channel", A.weight_text(F.col("weight")).alias("weight_fraction"), "credit_minor")


CHANGED_SQL = JOURNEY_SQL.replace("b.value_minor AS amount_minor", "b.value_minor + CASE WHEN f.visitor_id % 3 = 0 THEN 777 ELSE 0 END AS amount_minor").strip().removeprefix(",")

LEDGER_SQL = JOURNEY_SQL + f"""
, cc AS (WITH {CHANGED_SQL} SELECT * FROM cr),
bo AS (SELECT a.brand_id, a.visitor_id, a.event_id, a.model, a.touch_seq, a.credit_minor AS was, b.credit_minor AS now, b.weight, b.amount_minor, a.credit_minor = b.credit_minor AND a.weight = b.weight AS same FROM cr a JOIN cc b USING (brand_id, visitor_id, event_id, model)),
cl AS (SELECT *, -greatest(0, least(amount_minor // 2, sum(now) OVER (PARTITION BY visitor_id, model))) AS back FROM bo WHERE visitor_id % 5 = 0),
c3 AS (SELECT *, CAST(abs(back) AS HUGEINT) * weight // 100000000 AS kpart, CAST(abs(back) AS HUGEINT) * weight % 100000000 AS krest FROM cl)
SELECT visitor_id, event_id, model, 'credit' AS row_kind, CAST(1 AS BIGINT) AS occurrence, was AS credit_minor FROM bo UNION ALL SELECT visitor_id, event_id, model, 'reversal', 1, -was FROM bo WHERE NOT same UNION ALL SELECT visitor_id, event_id, model, 'credit', 2, now FROM bo WHERE NOT same
UNION ALL SELECT visitor_id, event_id, model, 'clawback', 1, CAST(sign(back) * (kpart + CASE WHEN row_number() OVER (PARTITION BY visitor_id, model ORDER BY krest DESC, touch_seq)
  <= abs(back) - sum(kpart) OVER (PARTITION BY visitor_id, model) THEN 1 ELSE 0 END) AS BIGINT) FROM c3
"""


@query("g28_credit_ledger", sql(LEDGER_SQL))
def credit_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """G28 as a ledger: a fold, a refold where a third of the journeys changed, the same once more, then refunds, delivered twice."""
    key = deterministic_id(F.col("brand_id"), F.col("visitor_id"), F.col("event_id"), F.col("model"))
    columns = [*VISITOR, "touch_seq", "event_id", "channel", "amount_minor", "bought_at"]
    more = F.col("amount_minor") + F.when(F.col("visitor_id") % 3 == 0, 777).otherwise(0)

    def fold(rows: DataFrame) -> DataFrame:
        out = A.credits(A.weights(rows.select(*columns), VISITOR, "touch_seq"), VISITOR, "amount_minor", "touch_seq")
        return out.withColumn("credit_id", key).withColumn("place", F.struct("touch_seq", "event_id")).select(*VISITOR, "model", "place", "credit_id", "weight", "credit_minor")

    base = journeys(spark, sf_dir)
    changed = base.withColumn("amount_minor", more.cast("bigint"))
    ledger = stored(fold(base).transform(lambda f: L.refold(L.empty(f, VISITOR, "place"), f, VISITOR, "place")))
    for again in (changed, changed):
        ledger = stored(ledger.unionByName(L.refold(ledger, fold(again), VISITOR, "place")))
    refunds = changed.where(F.col("visitor_id") % 5 == 0).groupBy(*VISITOR).agg(F.expr("first(amount_minor) div 2").alias("refund_minor")).withColumn("refund_id", F.lit("r1"))
    for _ in range(2):
        ledger = stored(ledger.unionByName(L.claw_back(ledger, refunds, VISITOR, "place")))
    return ledger.select("visitor_id", "place.event_id", "model", "row_kind", "occurrence", "credit_minor")


@query(
    "g29_marketing_attribution",
    sql(JOURNEY_SQL + "SELECT brand_id, model, channel, CAST(sum(credit_minor) AS BIGINT) AS credit_minor, count(*) AS touches FROM cr GROUP BY 1, 2, 3"),
)
def marketing_attribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Credits by channel and model."""
    return credited(spark, sf_dir).groupBy("brand_id", "model", "channel").agg(total("credit_minor").alias("credit_minor"), F.count("*").alias("touches"))


@query(
    "a_clawback",
    sql(JOURNEY_SQL + """, k1 AS (SELECT *, -least(amount_minor // 2, sum(credit_minor) OVER (PARTITION BY visitor_id, model)) AS back FROM cr),
k2 AS (SELECT *, CAST(abs(back) AS HUGEINT) * weight // 100000000 AS kpart, CAST(abs(back) AS HUGEINT) * weight % 100000000 AS krest FROM k1)
SELECT visitor_id, event_id, model, CAST(sign(back) * (kpart + CASE WHEN row_number() OVER (PARTITION BY visitor_id, model ORDER BY krest DESC, touch_seq)
  <= abs(back) - sum(kpart) OVER (PARTITION BY visitor_id, model) THEN 1 ELSE 0 END) AS BIGINT) AS credit_minor FROM k2"""),
)
def clawback(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clawbacks: half of each amount refunded, split by the saved weights."""
    rows = credited(spark, sf_dir)
    refunds = rows.groupBy(*VISITOR).agg(F.expr("first(amount_minor) div 2").alias("refund_minor"))
    return A.clawbacks(rows, refunds, VISITOR, "touch_seq").select("visitor_id", "event_id", "model", "credit_minor")


@query(
    "a_confidence",
    sql(JOURNEY_SQL + """SELECT brand_id, visitor_id, CASE WHEN bool_and(channel <> 'direct') THEN 'strong' WHEN bool_or(channel <> 'direct') THEN 'partial' ELSE 'weak' END AS confidence,
  CASE WHEN bool_and(channel <> 'direct') THEN 1.0::DOUBLE WHEN bool_or(channel <> 'direct') THEN 0.7::DOUBLE ELSE 0.4::DOUBLE END AS confidence_weight FROM tj GROUP BY 1, 2"""),
)
def attribution_confidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Confidence grade of each journey."""
    return A.confidence(journeys(spark, sf_dir), VISITOR, F.col("channel") != "direct")


@query(
    "a_reconciliation",
    sql(JOURNEY_SQL + """SELECT brand_id, CAST(sum(value_minor) AS BIGINT) AS realized_minor, any_value(a) AS attributed_minor, any_value(a) * 10000 // CAST(sum(value_minor) AS BIGINT) AS rate_bps,
  CAST(sum(value_minor) AS BIGINT) - any_value(a) AS unattributed_minor FROM e JOIN (SELECT brand_id, CAST(sum(credit_minor) AS BIGINT) AS a FROM cr WHERE model = 'linear' GROUP BY 1) USING (brand_id)
  WHERE event_type = 'purchase' GROUP BY 1"""),
)
def reconciliation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Attributed amounts against all purchases."""
    whole = touches(spark, sf_dir).where(is_type("purchase")).groupBy("brand_id").agg(total("value_minor").alias("realized_minor"))
    return A.reconcile(credited(spark, sf_dir).where(F.col("model") == "linear"), whole, ["brand_id"])


def spend(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spend facts: click events stand for daily campaign spend."""
    return touches(spark, sf_dir).where(is_type("click")).select("brand_id", "channel", F.col("seen_at").cast("date").alias("day"), F.col("value_minor").alias("spend_minor"), "k", "event_id")


@query(
    "g31_channel_roas",
    sql(JOURNEY_SQL + """SELECT coalesce(a.brand_id, p.brand_id) AS brand_id, coalesce(a.channel, p.channel) AS channel, coalesce(a.day, p.day) AS day, coalesce(attributed_minor, 0) AS attributed_minor,
  coalesce(spend_minor, 0) AS spend_minor, coalesce(attributed_minor, 0) * 10000 // nullif(coalesce(spend_minor, 0), 0) AS roas_bps FROM
  (SELECT brand_id, channel, CAST(bought_at AS DATE) AS day, CAST(sum(credit_minor) AS BIGINT) AS attributed_minor FROM cr WHERE model = 'position_based' GROUP BY 1, 2, 3) a FULL OUTER JOIN
  (SELECT brand_id, channel, CAST(seen_at AS DATE) AS day, CAST(sum(value_minor) AS BIGINT) AS spend_minor FROM e WHERE event_type = 'click' GROUP BY 1, 2, 3) p
  ON a.brand_id = p.brand_id AND a.channel = p.channel AND a.day = p.day"""),
)
def channel_roas(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Attributed value beside spend by channel and day."""
    a = credited(spark, sf_dir).where(F.col("model") == "position_based")
    a = a.groupBy("brand_id", "channel", F.col("bought_at").cast("date").alias("day")).agg(total("credit_minor").alias("attributed_minor"))
    p = spend(spark, sf_dir).groupBy("brand_id", "channel", "day").agg(total("spend_minor").alias("spend_minor"))
    return A.with_spend(a, p, ["brand_id", "channel", "day"])


@query(
    "g32_campaign_performance",
    sql("""SELECT brand_id, channel, k % 7 AS campaign_id, count(*) FILTER (WHERE event_type = 'view') AS impressions, count(*) FILTER (WHERE event_type = 'click') AS clicks,
  CAST(coalesce(sum(value_minor) FILTER (WHERE event_type = 'click'), 0) AS BIGINT) AS spend_minor,
  count(*) FILTER (WHERE event_type = 'click') * 10000 // nullif(count(*) FILTER (WHERE event_type = 'view'), 0) AS ctr_bps,
  CAST(coalesce(sum(value_minor) FILTER (WHERE event_type = 'click'), 0) AS BIGINT) // nullif(count(*) FILTER (WHERE event_type = 'click'), 0) AS cpc_minor FROM e GROUP BY 1, 2, 3"""),
)
def campaign_performance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Impressions, clicks, spend and ratios by campaign."""
    out = (
        touches(spark, sf_dir)
        .groupBy("brand_id", "channel", (F.col("k") % 7).alias("campaign_id"))
        .agg(F.count_if(is_type("view")).alias("impressions"), F.count_if(is_type("click")).alias("clicks"), total(F.when(is_type("click"), F.col("value_minor"))).alias("spend_minor"))
    )
    return out.withColumn("ctr_bps", F.expr("clicks * 10000 div nullif(impressions, 0L)")).withColumn("cpc_minor", F.expr("spend_minor div nullif(clicks, 0L)"))


@query("a_markov_removal")
def markov_removal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Data-driven attribution: removal effects of channels from transition counts of collapsed paths."""
    p = paths(spark, sf_dir).withColumn("path", S.collapse(F.col("path")))
    return A.removal_effects(A.transitions(p, ["brand_id"], "path", "converted"), ["brand_id"])


@query(
    "a_transitions",
    sql(PATHS_SQL + """, full_path AS (SELECT brand_id, list_concat(['(start)'], path, [CASE WHEN converted THEN '(conversion)' ELSE '(null)' END]) AS p FROM cp)
SELECT brand_id, p[i] AS source, p[i + 1] AS target, count(*) AS n FROM (SELECT *, unnest(range(1, len(p))) AS i FROM full_path) GROUP BY 1, 2, 3"""),
)
def transitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of channel moves, with start and end states."""
    p = paths(spark, sf_dir).withColumn("path", S.collapse(F.col("path")))
    return A.transitions(p, ["brand_id"], "path", "converted")


@query("q_first_touch_mix", sql("SELECT brand_id, channel, count(*) AS visitors, count(*) * 10000 // CAST(sum(count(*)) OVER (PARTITION BY brand_id) AS BIGINT) AS share_bps FROM s WHERE touch_seq = 1 GROUP BY 1, 2"))
def first_touch_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Share of channels among first touches."""
    first = touches(spark, sf_dir).groupBy(*VISITOR).agg(F.min_by("channel", F.struct("seen_at", "event_id")).alias("channel"))
    n = first.groupBy("brand_id", "channel").agg(F.count("*").alias("visitors"))
    return n.withColumn("_t", F.sum("visitors").over(Window.partitionBy("brand_id"))).withColumn("share_bps", F.expr("visitors * 10000 div _t")).drop("_t")


@query(
    "q_stitch_hit_rate",
    sql("SELECT brand_id, count(DISTINCT visitor_id) AS visitors, count(DISTINCT visitor_id) FILTER (WHERE event_type = 'signup') AS stitched FROM e GROUP BY 1"),
)
def stitch_hit_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Visitors that identify themselves at some time."""
    return M.stage_counts(touches(spark, sf_dir), ["brand_id"], F.col("visitor_id"), {"visitors": F.lit(True), "stitched": is_type("signup")})


@query(
    "q_journey_list_page",
    sql("""SELECT visitor_id, touches, last_at FROM (SELECT visitor_id, count(*) AS touches, max(seen_at) AS last_at FROM e WHERE brand_id = 'b1' GROUP BY 1)
  WHERE (last_at, visitor_id) < (TIMESTAMP '2024-01-30', 0) ORDER BY last_at DESC, visitor_id DESC LIMIT 21"""),
)
def journey_list_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A keyset page of one tenant's visitors: rows after a cursor, one more than the page shows."""
    each = touches(spark, sf_dir).where(F.col("brand_id") == "b1").groupBy("visitor_id").agg(F.count("*").alias("touches"), F.max("seen_at").alias("last_at"))
    cursor = F.struct(F.lit("2024-01-30").cast("timestamp").alias("last_at"), F.lit(0).cast("bigint").alias("visitor_id"))
    return each.where(F.struct("last_at", "visitor_id") < cursor).orderBy(F.desc("last_at"), F.desc("visitor_id")).limit(21)


@query(
    "q_ad_spend_timeseries",
    sql("SELECT brand_id, channel, CAST(date_trunc('week', seen_at) AS DATE) AS week, CAST(sum(value_minor) AS BIGINT) AS spend_minor, count(*) AS clicks FROM e WHERE event_type = 'click' GROUP BY 1, 2, 3"),
)
def ad_spend_timeseries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weekly spend by channel."""
    week = F.date_trunc("week", "day").cast("date").alias("week")
    return spend(spark, sf_dir).groupBy("brand_id", "channel", week).agg(total("spend_minor").alias("spend_minor"), F.count("*").alias("clicks"))
