"""Products and order economics: lines, costs by date, fees, margins, apportioning, affinity."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quern.operators import economics as E
from quern.operators import marts as M
from quern.operators.upsert import as_of
from quern.plans.catalogue import query
from quern.plans.customers import order_lines
from quern.plans.revenue import states, total
from quern.plans.shop import lines, orders, sql
from quern.session import table


def product_costs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dated unit costs of parts: half the retail price before 1998, three fifths from then on."""
    price = F.round(F.col("p_retailprice") * 100).cast("bigint")
    day = lambda d: F.lit(d).cast("timestamp")
    bands = F.array(
        F.struct(F.call_function("div", price, F.lit(2).cast("bigint")).alias("cost_minor"), day("1990-01-01").alias("valid_from"), day("1998-01-01").alias("valid_to")),
        F.struct(F.call_function("div", price * 3, F.lit(5).cast("bigint")).alias("cost_minor"), day("1998-01-01").alias("valid_from"), F.lit(None).cast("timestamp").alias("valid_to")),
    )
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("product_id"), "p_type", F.inline(bands))


COST_SQL = """
, pc AS (SELECT p_partkey AS product_id, p_type, CAST(round(p_retailprice * 100) AS BIGINT) // 2 AS cost_minor, TIMESTAMP '1990-01-01' AS valid_from, TIMESTAMP '1998-01-01' AS valid_to FROM part
  UNION ALL SELECT p_partkey, p_type, CAST(round(p_retailprice * 100) AS BIGINT) * 3 // 5, TIMESTAMP '1998-01-01', NULL FROM part),
lc AS (SELECT lo.*, cost_minor, p_type FROM lo LEFT JOIN pc ON pc.product_id = lo.product_id AND valid_from <= placed_at AND (valid_to IS NULL OR valid_to > placed_at))
"""


def costed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.dated_lookup(order_lines(spark, sf_dir), product_costs(spark, sf_dir), ["product_id"], "placed_at")


@query(
    "s3_order_line",
    sql("""SELECT order_id, line_number, product_id, quantity, gross_minor, row_number() OVER (PARTITION BY order_id ORDER BY line_number, product_id, quantity, gross_minor, discount_minor) AS line_index FROM l"""),
)
def order_line(spark: SparkSession, sf_dir: str) -> DataFrame:
    """S3: lines of each order numbered by a full order of their fields."""
    w = Window.partitionBy("order_id").orderBy("line_number", "product_id", "quantity", "gross_minor", "discount_minor")
    return lines(spark, sf_dir).select("order_id", "line_number", "product_id", "quantity", "gross_minor", F.row_number().over(w).alias("line_index"))


@query("g22_product_costs", sql(COST_SQL + "SELECT product_id, cost_minor FROM pc WHERE valid_from <= TIMESTAMP '1997-06-01' AND (valid_to IS NULL OR valid_to > TIMESTAMP '1997-06-01')"))
def product_cost_as_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each product's cost at a time; band ends are excluded."""
    return as_of(product_costs(spark, sf_dir), F.lit("1997-06-01").cast("timestamp")).select("product_id", "cost_minor")


@query(
    "g23_measurement_costs",
    sql(COST_SQL + """SELECT order_id, kind, CAST(sum(amount_minor) AS BIGINT) AS amount_minor FROM (
  SELECT order_id, 'cogs' AS kind, cost_minor * quantity AS amount_minor FROM lc WHERE cost_minor IS NOT NULL
  UNION ALL SELECT order_id, 'forward_shipping', 500 FROM lc UNION ALL SELECT order_id, 'reverse_shipping', 700 FROM lc WHERE return_flag = 'R' UNION ALL SELECT order_id, 'packaging', 50 * quantity FROM lc)
  GROUP BY 1, 2 HAVING sum(amount_minor) <> 0"""),
)
def measurement_costs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cost lanes by order; lines meet their dated cost by key with the range as a residual."""
    back = F.when(F.col("return_flag") == "R", 700)
    rows = costed(spark, sf_dir).groupBy("order_id").agg(
        total(F.col("cost_minor") * F.col("quantity")).alias("cogs"), (F.count("*") * 500).alias("fwd"), total(back).alias("rev"), total(F.col("quantity") * 50).alias("pack")
    )
    return E.unpivot_amounts(rows, ["order_id"], {"cogs": "cogs", "forward_shipping": "fwd", "reverse_shipping": "rev", "packaging": "pack"})


@query(
    "g24_measurement_fees",
    sql("""SELECT order_id, 'fee' AS kind, amount_minor * 2 // 100 AS amount_minor FROM o WHERE payment_method = 'prepaid' AND amount_minor * 2 // 100 <> 0
  UNION ALL SELECT order_id, 'tax', amount_minor * 2 // 100 * 18 // 100 FROM o WHERE payment_method = 'prepaid' AND amount_minor * 2 // 100 * 18 // 100 <> 0"""),
)
def measurement_fees(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Settlement fees and taxes as rows."""
    rows = orders(spark, sf_dir).where(F.col("payment_method") == "prepaid").withColumn("fee", F.expr("amount_minor * 2 div 100")).withColumn("tax", F.expr("fee * 18 div 100"))
    return E.unpivot_amounts(rows, ["order_id"], {"fee": "fee", "tax": "tax"})


def economics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per order: net, costs, the day's marketing split over its orders by net, and margins."""
    cost = costed(spark, sf_dir).groupBy("order_id").agg(
        total(F.col("gross_minor") - F.col("discount_minor")).alias("net_minor"), total(F.col("cost_minor") * F.col("quantity")).alias("cogs_minor"),
        (F.count("*") * 500).alias("shipping_minor"), total(F.col("quantity") * 50).alias("packaging_minor"),
    )
    o = orders(spark, sf_dir).select("order_id", "brand_id", "customer_id", "currency_code", "placed_at", F.when(F.col("payment_method") == "prepaid", F.expr("amount_minor * 2 div 100")).otherwise(0).cast("bigint").alias("fee_minor"))
    rows = o.join(cost, "order_id").withColumn("_day", F.col("placed_at").cast("date")).withColumn("_spend", F.lit(100_000).cast("bigint"))
    rows = E.apportion(rows, ["brand_id", "_day"], "_spend", "net_minor", [F.col("order_id")], "marketing_minor")
    return E.margins(rows).drop("_day", "_spend")


ECONOMICS_SQL = COST_SQL + """
, oc AS (SELECT order_id, CAST(sum(gross_minor - discount_minor) AS BIGINT) AS net_minor, CAST(coalesce(sum(cost_minor * quantity), 0) AS BIGINT) AS cogs_minor, count(*) * 500 AS shipping_minor,
  CAST(sum(quantity * 50) AS BIGINT) AS packaging_minor FROM lc GROUP BY 1),
e1 AS (SELECT order_id, brand_id, customer_id, currency_code, placed_at, CASE WHEN payment_method = 'prepaid' THEN amount_minor * 2 // 100 ELSE 0 END AS fee_minor, net_minor, cogs_minor, shipping_minor, packaging_minor,
  CAST(sum(net_minor) OVER (PARTITION BY brand_id, CAST(placed_at AS DATE)) AS HUGEINT) AS w, CAST(100000 AS HUGEINT) * net_minor AS product FROM o JOIN oc USING (order_id)),
e2 AS (SELECT *, product // w AS part, product % w AS rest FROM e1),
e3 AS (SELECT *, CAST(part + CASE WHEN row_number() OVER (PARTITION BY brand_id, CAST(placed_at AS DATE) ORDER BY rest DESC, order_id) <= 100000 - sum(part) OVER (PARTITION BY brand_id, CAST(placed_at AS DATE)) THEN 1 ELSE 0 END AS BIGINT) AS marketing_minor FROM e2),
oe AS (SELECT *, net_minor - cogs_minor AS cm1_minor, net_minor - cogs_minor - shipping_minor - packaging_minor - fee_minor AS cm2_minor,
  net_minor - cogs_minor - shipping_minor - packaging_minor - fee_minor - marketing_minor AS cm3_minor FROM e3)
"""


@query("g25_order_economics", sql(ECONOMICS_SQL + "SELECT brand_id, order_id, net_minor, cogs_minor, shipping_minor, packaging_minor, fee_minor, marketing_minor, cm1_minor, cm2_minor, cm3_minor, order_id = first_value(order_id) OVER (PARTITION BY customer_id ORDER BY placed_at, order_id) AS is_new_customer FROM oe"))
def order_economics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Margins of each order, with day spend split exactly, and whether it is the customer's first."""
    rows = economics(spark, sf_dir)
    # The first of all orders that have lines, as the fold sees them.
    first = F.row_number().over(Window.partitionBy("customer_id").orderBy("placed_at", "order_id")) == 1
    keep = ["brand_id", "order_id", "net_minor", "cogs_minor", "shipping_minor", "packaging_minor", "fee_minor", "marketing_minor", "cm1_minor", "cm2_minor", "cm3_minor"]
    return rows.withColumn("is_new_customer", first).select(*keep, "is_new_customer")


@query(
    "g26_product_economics",
    sql(ECONOMICS_SQL + """, pl AS (SELECT lo.order_id, lo.product_id, lo.line_number, lo.gross_minor, lo.discount_minor, lo.quantity, oe.brand_id, oe.cm2_minor, CAST(sum(lo.gross_minor) OVER (PARTITION BY lo.order_id) AS BIGINT) AS w FROM lo JOIN oe USING (order_id)),
p2 AS (SELECT *, CAST(cm2_minor * gross_minor // w AS BIGINT) AS p FROM pl),
p3 AS (SELECT *, p + CASE WHEN row_number() OVER (PARTITION BY order_id ORDER BY gross_minor DESC, line_number, product_id, quantity, discount_minor) = 1 THEN cm2_minor - sum(p) OVER (PARTITION BY order_id) ELSE 0 END AS share FROM p2)
SELECT brand_id, product_id, CAST(sum(gross_minor - discount_minor) AS BIGINT) AS net_minor, CAST(sum(share) AS BIGINT) AS cm2_minor, count(*) AS n_lines FROM p3 GROUP BY 1, 2"""),
)
def product_economics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An order's margin apportioned to its lines by gross value, the rest to the largest line."""
    rows = lines(spark, sf_dir).join(economics(spark, sf_dir).select("order_id", "brand_id", "cm2_minor"), "order_id")
    order = [F.desc("gross_minor"), F.asc("line_number"), F.asc("product_id"), F.asc("quantity"), F.asc("discount_minor")]
    rows = E.apportion_to_top(rows, ["order_id"], "cm2_minor", "gross_minor", order, "share")
    return rows.groupBy("brand_id", "product_id").agg(total(F.col("gross_minor") - F.col("discount_minor")).alias("net_minor"), total("share").alias("cm2_minor"), F.count("*").alias("n_lines"))


@query(
    "g27_contribution_margin",
    sql(ECONOMICS_SQL + """SELECT brand_id, currency_code, CAST(sum(net_minor) AS BIGINT) AS net_minor, CAST(sum(cm1_minor) AS BIGINT) AS cm1_minor, CAST(sum(cm2_minor) AS BIGINT) AS cm2_minor, CAST(sum(cm3_minor) AS BIGINT) AS cm3_minor,
  CAST(sum(cm2_minor) AS BIGINT) * 10000 // nullif(CAST(sum(net_minor) AS BIGINT), 0) AS cm2_bps, CASE WHEN bool_and(cogs_minor > 0) THEN 'actual' WHEN bool_or(cogs_minor > 0) THEN 'partial' ELSE 'estimated' END AS cost_confidence FROM oe GROUP BY 1, 2"""),
)
def contribution_margin(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Margins by currency with a tier of cost confidence."""
    known = F.col("cogs_minor") > 0
    tier = F.when(F.bool_and(known), "actual").when(F.bool_or(known), "partial").otherwise("estimated")
    sums = [total(f"{c}_minor").alias(f"{c}_minor") for c in ("net", "cm1", "cm2", "cm3")]
    out = economics(spark, sf_dir).groupBy("brand_id", "currency_code").agg(*sums, tier.alias("cost_confidence"))
    return out.withColumn("cm2_bps", F.expr("cm2_minor * 10000 div nullif(net_minor, 0L)"))


@query(
    "g20_product_detail",
    sql("""SELECT product_id, count(*) AS purchases, CAST(sum(quantity) AS BIGINT) AS units, count(*) FILTER (WHERE return_flag = 'R') AS returns, CAST(sum(gross_minor - discount_minor) AS BIGINT) AS net_minor,
  count(*) FILTER (WHERE return_flag = 'R') * 10000 // count(*) AS return_bps, count(DISTINCT order_id) AS orders FROM l GROUP BY 1"""),
)
def product_detail(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Purchases, returns and rates of each product."""
    r = F.count_if(F.col("return_flag") == "R")
    out = lines(spark, sf_dir).groupBy("product_id").agg(
        F.count("*").alias("purchases"), total("quantity").alias("units"), r.alias("returns"), total(F.col("gross_minor") - F.col("discount_minor")).alias("net_minor"), F.count_distinct("order_id").alias("orders")
    )
    return out.withColumn("return_bps", F.expr("returns * 10000 div purchases"))


@query(
    "g21_product_affinity",
    sql("""
, it AS (SELECT DISTINCT brand_id, order_id, product_id % 50 AS item FROM lo),
n1 AS (SELECT brand_id, item, count(*) AS n FROM it GROUP BY 1, 2), nb AS (SELECT brand_id, count(DISTINCT order_id) AS baskets FROM it GROUP BY 1),
pr AS (SELECT a.brand_id, a.item AS item_a, b.item AS item_b, count(*) AS together FROM it a JOIN it b ON a.order_id = b.order_id AND a.item < b.item GROUP BY 1, 2, 3),
rk AS (SELECT pr.*, x.n AS n_a, y.n AS n_b, baskets, round(together * 100.0::DOUBLE / baskets, 4) AS support_pct, row_number() OVER (PARTITION BY pr.brand_id, item_a ORDER BY together DESC, item_b) AS rank
  FROM pr JOIN n1 x ON x.brand_id = pr.brand_id AND x.item = item_a JOIN n1 y ON y.brand_id = pr.brand_id AND y.item = item_b JOIN nb ON nb.brand_id = pr.brand_id)
SELECT * FROM rk WHERE rank <= 10"""),
)
def product_affinity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items bought together, ten partners of each; pairs come from each basket's own list."""
    rows = order_lines(spark, sf_dir).select("brand_id", "order_id", (F.col("product_id") % 50).alias("item"))
    return M.affinity(rows, ["brand_id"], "order_id", "item", 10)


@query(
    "g21_product_affinity_whole",
    sql("""
, it AS (SELECT DISTINCT brand_id, order_id, product_id AS item FROM lo),
n1 AS (SELECT brand_id, item, count(*) AS n FROM it GROUP BY 1, 2), nb AS (SELECT brand_id, count(DISTINCT order_id) AS baskets FROM it GROUP BY 1),
pr AS (SELECT a.brand_id, a.item AS item_a, b.item AS item_b, count(*) AS together FROM it a JOIN it b ON a.order_id = b.order_id AND a.item < b.item GROUP BY 1, 2, 3),
rk AS (SELECT pr.*, x.n AS n_a, y.n AS n_b, baskets, round(together * 100.0::DOUBLE / baskets, 4) AS support_pct, row_number() OVER (PARTITION BY pr.brand_id, item_a ORDER BY together DESC, item_b) AS rank
  FROM pr JOIN n1 x ON x.brand_id = pr.brand_id AND x.item = item_a JOIN n1 y ON y.brand_id = pr.brand_id AND y.item = item_b JOIN nb ON nb.brand_id = pr.brand_id)
SELECT * FROM rk WHERE rank <= 50"""),
)
def product_affinity_whole(spark: SparkSession, sf_dir: str) -> DataFrame:
    """G21 as in the reference: the products themselves, fifty partners of each."""
    rows = order_lines(spark, sf_dir).select("brand_id", "order_id", F.col("product_id").alias("item"))
    return M.affinity(rows, ["brand_id"], "order_id", "item", 50)


@query("q_top_products", sql("SELECT product_id, CAST(sum(gross_minor - discount_minor) AS BIGINT) AS net_minor, count(*) AS n FROM l GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 20"))
def top_products(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 products of the greatest net value."""
    n = lines(spark, sf_dir).groupBy("product_id").agg(total(F.col("gross_minor") - F.col("discount_minor")).alias("net_minor"), F.count("*").alias("n"))
    return n.orderBy(F.desc("net_minor"), "product_id").limit(20)


@query(
    "q_shipment_outcomes",
    sql("""SELECT courier, count(*) AS shipments, count(*) FILTER (WHERE line_status = 'F') AS delivered, count(*) FILTER (WHERE return_flag = 'R') AS returned,
  count(*) FILTER (WHERE return_flag = 'R') * 10000 // count(*) AS return_bps FROM l GROUP BY 1"""),
)
def shipment_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Outcomes by courier."""
    n = lines(spark, sf_dir).groupBy("courier").agg(F.count("*").alias("shipments"), F.count_if(F.col("line_status") == "F").alias("delivered"), F.count_if(F.col("return_flag") == "R").alias("returned"))
    return n.withColumn("return_bps", F.expr("returned * 10000 div shipments"))


@query(
    "v_semantic_order",
    sql(ECONOMICS_SQL + """SELECT os.order_id, os.state, os.realized_minor, oe.cm2_minor, a.n_lines, a.couriers FROM os LEFT JOIN oe ON oe.order_id = os.order_id LEFT JOIN
  (SELECT order_id, count(*) AS n_lines, array_to_string(list_sort(list(DISTINCT courier)), ',') AS couriers FROM l GROUP BY 1) a ON a.order_id = os.order_id"""),
)
def semantic_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The order entity: state, margin and line aggregates, one row each, so no join fans out."""
    agg = lines(spark, sf_dir).groupBy("order_id").agg(F.count("*").alias("n_lines"), F.array_join(F.array_sort(F.collect_set("courier")), ",").alias("couriers"))
    st = states(spark, sf_dir).select("order_id", "state", "realized_minor")
    return st.join(economics(spark, sf_dir).select("order_id", "cm2_minor"), "order_id", "left").join(agg, "order_id", "left")
