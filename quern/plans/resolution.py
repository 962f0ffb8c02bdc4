"""Identity decisions over orders: resolver, log with its compensations, and replays in other orders of arrival."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.operators import resolver as R
from quern.plans.catalogue import query
from quern.plans.shop import orders, sql
from quern.session import stored, table

THRESHOLD = 2
FIRST, SECOND = "2024-01-01", "2024-02-01"


def _identifiers(*parts: tuple[str, str, Column, Column]) -> Column:
    """An array of (type, hash, tier) of those parts whose condition holds."""
    told = [F.when(when, F.struct(F.lit(t).alias("identifier_type"), h.alias("identifier_hash"), F.lit(tier).alias("tier"))) for t, tier, h, when in parts]
    return F.explode(F.filter(F.array(*told), lambda x: x.isNotNull())).alias("_i")


def mark(letter: str, number: Column | str) -> Column:
    n = F.expr(number) if isinstance(number, str) else number
    return F.concat(F.lit(letter), n.cast("string"))


def order_identifiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Identifiers of orders: shared mail and phone of neighbouring customers, the shop's own id, a device."""
    n = F.col("order_id")
    parts = _identifiers(
        ("email", "strong", mark("e", "customer_id div 6"), n % 5 != 0), ("phone", "strong", mark("t", "customer_id div 12"), n % 3 == 0),
        ("storefront_customer_id", "strong_on_link", mark("s", "customer_id"), n % 4 == 1), ("device", "medium", mark("d", n % 50), n % 7 < 5),
    )
    return orders(spark, sf_dir).select("brand_id", n.alias("event_id"), parts).select("brand_id", "event_id", "_i.*")


def known_links(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(links that were there before, profiles that were merged away)."""
    c = F.col("c_custkey")
    people = table(spark, sf_dir, "customer").select(F.concat(F.lit("b"), (c % 3).cast("string")).alias("brand_id"), F.concat(F.lit("P"), F.lpad(c.cast("string"), 9, "0")).alias("profile_id"), "c_custkey")
    parts = _identifiers(
        ("email", "strong", mark("e", "c_custkey div 6"), c % 4 != 3), ("phone", "strong", mark("t", "c_custkey div 12"), c % 2 == 1),
        ("storefront_customer_id", "strong_on_link", mark("s", "c_custkey"), c % 5 != 0), ("device", "medium", mark("d", c % 50), c % 7 == 0),
    )
    return people.select("brand_id", "profile_id", parts).select("brand_id", "profile_id", "_i.*"), people.where(c % 20 == 1).select("brand_id", "profile_id")


RESOLVE_SQL = """
, ids AS (SELECT brand_id, order_id AS event_id, x.* FROM o CROSS JOIN LATERAL (VALUES ('email', 'e' || CAST(customer_id // 6 AS VARCHAR), 'strong', order_id % 5 <> 0), ('phone', 't' || CAST(customer_id // 12 AS VARCHAR), 'strong', order_id % 3 = 0),
    ('storefront_customer_id', 's' || CAST(customer_id AS VARCHAR), 'strong_on_link', order_id % 4 = 1), ('device', 'd' || CAST(order_id % 50 AS VARCHAR), 'medium', order_id % 7 < 5)) AS x(t, h, tier, holds) WHERE holds),
lk AS (SELECT 'b' || CAST(c_custkey % 3 AS VARCHAR) AS brand_id, 'P' || lpad(CAST(c_custkey AS VARCHAR), 9, '0') AS p, c_custkey % 20 = 1 AS gone, x.* FROM customer CROSS JOIN LATERAL (VALUES ('email', 'e' || CAST(c_custkey // 6 AS VARCHAR), 'strong', c_custkey % 4 <> 3),
    ('phone', 't' || CAST(c_custkey // 12 AS VARCHAR), 'strong', c_custkey % 2 = 1), ('storefront_customer_id', 's' || CAST(c_custkey AS VARCHAR), 'strong_on_link', c_custkey % 5 <> 0), ('device', 'd' || CAST(c_custkey % 50 AS VARCHAR), 'medium', c_custkey % 7 = 0)) AS x(t, h, tier, holds) WHERE holds),
ow AS (SELECT *, bool_or(tier <> 'medium') OVER (PARTITION BY brand_id, p) AS owned FROM lk),
hd AS (SELECT brand_id, t, h, min(p) AS lo, max(p) AS hi, count(DISTINCT p) AS n, min(p) FILTER (NOT owned) AS flo, max(p) FILTER (NOT owned) AS fhi FROM ow GROUP BY 1, 2, 3),
mt AS (SELECT ids.*, n, lo, hi, flo, fhi, ids.t = 'phone' AND coalesce(n, 0) + 1 > 2 AS sup FROM ids LEFT JOIN hd USING (brand_id, t, h)),
pe AS (SELECT brand_id, event_id, min(lo) FILTER (tier <> 'medium' AND NOT sup) AS lo, max(hi) FILTER (tier <> 'medium' AND NOT sup) AS hi, bool_or(tier <> 'medium' AND NOT sup AND n IS NULL) AS fresh,
    min(lo) FILTER (tier = 'medium') AS mlo, max(hi) FILTER (tier = 'medium') AS mhi, min(flo) FILTER (tier = 'medium') AS flo, max(fhi) FILTER (tier = 'medium') AS fhi, count(*) FILTER (sup) AS suppressed, min(t || ':' || h) AS k FROM mt GROUP BY 1, 2),
p2 AS (SELECT *, coalesce(lo <> hi, false) AS merging, least(lo, CASE WHEN fresh THEN flo ELSE mlo END) AS ulo, greatest(hi, CASE WHEN fresh THEN fhi ELSE mhi END) AS uhi FROM pe),
p3 AS (SELECT *, coalesce(CASE WHEN NOT merging AND ulo = uhi THEN ulo END, lo) AS known FROM p2),
gn AS (SELECT DISTINCT p FROM lk WHERE gone),
de AS (SELECT brand_id, event_id, CASE WHEN merging AND (lo IN (SELECT p FROM gn) OR hi IN (SELECT p FROM gn)) THEN 'skipped' WHEN merging THEN 'merged' WHEN known IS NULL THEN 'minted' ELSE 'linked' END AS action,
    coalesce(known, sha256(concat_ws(chr(0), brand_id, k))) AS profile_id, CASE WHEN merging THEN hi END AS other_id, suppressed FROM p3),
nl AS (SELECT DISTINCT brand_id, event_id, mt.t, mt.h, profile_id FROM mt JOIN de USING (brand_id, event_id) WHERE action IN ('minted', 'linked') AND NOT (action = 'minted' AND mt.tier = 'medium' AND n IS NOT NULL)
    AND NOT EXISTS (SELECT 1 FROM lk WHERE lk.brand_id = mt.brand_id AND lk.t = mt.t AND lk.h = mt.h AND lk.p = de.profile_id))
"""


def decided(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    links, gone = known_links(spark, sf_dir)
    none = links.select(*R.KEY).limit(0)
    return R.decide(order_identifiers(spark, sf_dir), links, gone, none, THRESHOLD)


@query(
    "i_resolver",
    sql(RESOLVE_SQL + "SELECT brand_id, event_id, action, profile_id, other_id, suppressed, coalesce(c, 0) AS new_links FROM de LEFT JOIN (SELECT brand_id, event_id, count(*) AS c FROM nl GROUP BY 1, 2) USING (brand_id, event_id)"),
)
def resolver(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each order's identifiers do to the profiles known before: mint, link, merge, review; phones suppressed; links added."""
    decisions, new, _ = decided(spark, sf_dir)
    counts = new.groupBy(*R.EVENT).agg(F.count("*").alias("new_links"))
    return decisions.join(counts, R.EVENT, "left").withColumn("new_links", F.coalesce("new_links", F.lit(0).cast("bigint")))


LOG_SQL = RESOLVE_SQL + """
, lg AS (SELECT brand_id, 'profile' AS kind, profile_id AS a, NULL AS b FROM de WHERE action = 'minted' UNION SELECT brand_id, 'link', profile_id, t || ':' || h FROM nl UNION SELECT brand_id, 'merge', profile_id, other_id FROM de WHERE action = 'merged'
  UNION SELECT brand_id, 'review', profile_id, other_id FROM de WHERE action = 'skipped' UNION SELECT brand_id, 'suppression', t || ':' || h, NULL FROM mt WHERE sup),
un AS (SELECT *, kind = 'merge' AND TRY_CAST(substr(a, 2) AS BIGINT) % 2 = 0 AS undone, kind = 'merge' AND TRY_CAST(substr(a, 2) AS BIGINT) % 10 = 0 AS again FROM lg)
"""


def log_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Commands of all orders; half of the merges taken back, some of them made again, then all delivered twice."""
    at = lambda day: F.lit(day).cast("timestamp")
    first = stored(R.commands(*decided(spark, sf_dir), at(FIRST)))
    number = F.when(F.col("kind") == "merge", F.substr("a", F.lit(2)).cast("bigint"))
    undone = R.compensate(first, number % 2 == 0, at(SECOND))
    again = R.compensate(undone, (number % 10 == 0) & ~F.col("is_on"), at("2024-03-01"))
    return R.append(again, first)


@query(
    "i_decision_log",
    sql(LOG_SQL + "SELECT brand_id, kind, a, b, NOT undone OR again AS is_on, CAST(1 + undone::INT + again::INT AS BIGINT) AS commands FROM un"),
)
def decision_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The state that the command log tells after merges were taken back and made again: the last word on each subject."""
    return R.folded(log_of(spark, sf_dir))


def replay_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Strong identifiers of orders: mail of two neighbours, a phone that joins two pairs, and the shop's own id."""
    c = F.col("o_custkey")
    pad = lambda letter, n: F.concat(F.lit(letter), F.lpad(F.expr(n).cast("string"), 9, "0"))
    keys = F.array_compact(F.array(pad("e", "o_custkey div 2"), F.when((c % 4).isin(1, 2), pad("t", "o_custkey div 4")), F.when(F.col("o_orderkey") % 2 == 0, pad("s", "o_custkey"))))
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("event_id"), F.explode(keys).alias("key"))


@query(
    "i_replay_orders",
    """WITH k AS (SELECT o_custkey AS c, unnest([CAST(o_custkey // 2 AS VARCHAR), CASE WHEN o_custkey % 4 IN (1, 2) THEN CAST(o_custkey // 4 AS VARCHAR) END, CASE WHEN o_orderkey % 2 = 0 THEN CAST(o_custkey AS VARCHAR) END]) AS n, unnest(['e', 't', 's']) AS l FROM orders),
  m AS (SELECT DISTINCT c, l || lpad(n, 9, '0') AS key FROM k WHERE n IS NOT NULL),
  j AS (SELECT key, min(CASE WHEN c % 4 < 2 THEN c // 4 * 2 ELSE c // 4 * 2 + 1 END) AS half, bool_or(key[1] = 't') AS phone FROM m GROUP BY 1),
  b AS (SELECT c // 4 AS g, count(DISTINCT c % 4) FILTER (c % 4 IN (1, 2) AND key[1] = 't') = 2 AS whole FROM m GROUP BY 1),
  a AS (SELECT DISTINCT key, c // 4 AS g, CASE WHEN whole THEN 0 ELSE c % 4 // 2 END AS part FROM m JOIN b ON b.g = m.c // 4)
  SELECT min(key) AS component, count(*) AS identifiers, 1 AS partitions, 0 AS differences FROM a GROUP BY g, part""",
)
def replay_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same orders in three orders of arrival, in three batches each: one partition a component, and no identifier elsewhere."""
    events = stored(replay_events(spark, sf_dir))
    return R.order_report(events, R.replay(events, [1, 2, 3]))
