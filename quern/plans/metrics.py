"""The metric catalogue over orders, customers and spend, one query a metric."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quern.operators.metrics import CELL, Catalogue, Entity, Measure, Metric, bucket
from quern.operators.tables import StoredTable
from quern.plans.catalogue import query
from quern.plans.customers import facts
from quern.plans.journeys import spend
from quern.plans.products import ECONOMICS_SQL, economics
from quern.plans.revenue import states
from quern.plans.shop import sql
from quern.session import scratch


def _orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    first = F.row_number().over(Window.partitionBy("customer_id").orderBy("placed_at", "order_id")) == 1
    return states(spark, sf_dir).withColumn("is_new", first)


def _spend(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spend, moved back to the time of the orders."""
    currency = F.when(F.col("brand_id") == "b2", "KWD").otherwise("INR").alias("currency_code")
    return spend(spark, sf_dir).select("brand_id", currency, F.date_sub("day", 8766).alias("day"), "spend_minor")


def _customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return facts(spark, sf_dir).withColumn("currency_code", F.when(F.col("brand_id") == "b2", "KWD").otherwise("INR"))


MEASURES = {
    "n_orders": Measure("order"),
    "gross": Measure("order", "amount_minor"),
    "realized": Measure("order", "realized_minor"),
    "refunded": Measure("order", "amount_minor", "state = 'refunded'"),
    "n_refunded": Measure("order", where="state = 'refunded'"),
    "n_rto": Measure("order", where="state = 'rto'"),
    "n_identified": Measure("order", where="customer_id % 4 <> 0"),
    "n_new": Measure("order", where="is_new"),
    "new_realized": Measure("order", "realized_minor", "is_new"),
    "net": Measure("margin", "net_minor"),
    "m1": Measure("margin", "cm1_minor"),
    "m2": Measure("margin", "cm2_minor"),
    "m3": Measure("margin", "cm3_minor"),
    "spent": Measure("spend", "spend_minor"),
    "n_customers": Measure("customer"),
    "n_repeat": Measure("customer", where="orders >= 2"),
    "customer_value": Measure("customer", "value_minor"),
}


def _ratio(a: str, b: str, scale: int = 10_000) -> str:
    return f"{a} * {scale} div nullif({b}, 0L)"


METRICS = {
    m.name: m
    for m in (
        Metric("orders", ("n_orders",), "n_orders"),
        Metric("gross_revenue", ("gross",), "gross"),
        Metric("net_revenue", ("realized",), "realized"),
        Metric("refund_amount", ("refunded",), "refunded"),
        Metric("aov", ("gross", "n_orders"), _ratio("gross", "n_orders", 1)),
        Metric("cm1", ("m1",), "m1"),
        Metric("cm2", ("m2",), "m2"),
        Metric("cm3", ("m3",), "m3"),
        Metric("cm1_pct", ("m1", "net"), _ratio("m1", "net")),
        Metric("cm2_pct", ("m2", "net"), _ratio("m2", "net")),
        Metric("cm3_pct", ("m3", "net"), _ratio("m3", "net")),
        Metric("rto_rate", ("n_rto", "n_orders"), _ratio("n_rto", "n_orders")),
        Metric("return_rate", ("n_refunded", "n_orders"), _ratio("n_refunded", "n_orders")),
        Metric("identified_purchase_rate", ("n_identified", "n_orders"), _ratio("n_identified", "n_orders")),
        Metric("repeat_rate", ("n_repeat", "n_customers"), _ratio("n_repeat", "n_customers")),
        Metric("ltv_realized", ("customer_value", "n_customers"), _ratio("customer_value", "n_customers", 1)),
        Metric("ad_spend", ("spent",), "spent"),
        Metric("roas", ("gross", "spent"), _ratio("gross", "spent")),
        Metric("mer", ("realized", "spent"), _ratio("realized", "spent")),
        Metric("amer", ("new_realized", "spent"), _ratio("new_realized", "spent")),
        Metric("cac", ("spent", "n_orders"), _ratio("spent", "n_orders", 1)),
        Metric("cac_new", ("spent", "n_new"), _ratio("spent", "n_new", 1)),
    )
}


def catalogue(spark: SparkSession, sf_dir: str) -> Catalogue:
    entities = {
        "order": Entity(lambda: _orders(spark, sf_dir), "placed_at", "true", key=("order_id",)),
        "margin": Entity(lambda: economics(spark, sf_dir), "placed_at", "true", key=("order_id",)),
        "spend": Entity(lambda: _spend(spark, sf_dir), "day", "true", key=("brand_id", "day")),
        "customer": Entity(lambda: _customers(spark, sf_dir), "first_at", "true", key=("customer_id",)),
    }
    return Catalogue(entities, MEASURES, METRICS)


_SOURCES = {
    "order": "SELECT *, placed_at AS t, row_number() OVER (PARTITION BY customer_id ORDER BY placed_at, order_id) = 1 AS is_new FROM os",
    "margin": "SELECT *, placed_at AS t FROM oe",
    "spend": "SELECT brand_id, CASE brand_id WHEN 'b2' THEN 'KWD' ELSE 'INR' END AS currency_code, CAST(seen_at AS DATE) - 8766 AS t, value_minor AS spend_minor FROM e WHERE event_type = 'click'",
    "customer": "SELECT *, CASE brand_id WHEN 'b2' THEN 'KWD' ELSE 'INR' END AS currency_code, first_at AS t FROM cf",
}


def _oracle(metric: Metric) -> str:
    legs = {}
    for n in metric.measures:
        legs.setdefault(MEASURES[n].entity, []).append(n)
    parts = []
    for entity, names in legs.items():
        sums = [
            f"CAST(coalesce(sum({MEASURES[n].value}) FILTER (WHERE {MEASURES[n].where}), 0) AS BIGINT) AS {n}" if n in names else f"CAST(NULL AS BIGINT) AS {n}"
            for n in metric.measures
        ]
        parts.append(f"SELECT brand_id, currency_code, strftime(date_trunc('month', t), '%Y-%m-%d') AS bucket, {', '.join(sums)} FROM ({_SOURCES[entity]}) GROUP BY 1, 2, 3")
    both = " UNION ALL ".join(parts)
    total = ", ".join(f"CAST(coalesce(sum({n}), 0) AS BIGINT) AS {n}" for n in metric.measures)
    value = metric.expression.replace(" div ", " // ").replace("0L", "0")
    more = ECONOMICS_SQL if "margin" in legs else ""
    return sql(f"{more} SELECT brand_id, currency_code, bucket, {value} AS value FROM (SELECT brand_id, currency_code, bucket, {total} FROM ({both}) GROUP BY 1, 2, 3)")


def _register(metric: Metric) -> None:
    @query(f"m_{metric.name}", _oracle(metric))
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return catalogue(spark, sf_dir).compile(metric.name)


for _metric in METRICS.values():
    _register(_metric)


@query("m_aov_from_preaggregate", _oracle(METRICS["aov"]))
def aov_from_preaggregate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A metric served from a stored aggregate of finer dimensions (order states)."""
    c = catalogue(spark, sf_dir)
    out = c.from_preaggregate(c.aggregate("aov", "month", ("state",)), "aov")
    assert out is not None
    return out


@query("m_aov_from_stored", _oracle(METRICS["aov"]))
def aov_from_stored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A metric from a stored pre-aggregate: built before a tenth of the orders had come, then kept up for the cells they fall into."""
    late = F.col("order_id") % 10 == 0
    full = catalogue(spark, sf_dir)
    before = catalogue(spark, sf_dir)
    before.entities["order"] = replace(before.entities["order"], load=lambda: _orders(spark, sf_dir).where(~late))
    held = StoredTable(spark, scratch(spark, "aov"), CELL, 16)
    before.rebuild(held, "aov", "month", ("state",))
    full.upkeep(held, _orders(spark, sf_dir).where(late).withColumn("bucket", bucket("placed_at", "month")))
    out = full.from_preaggregate(held.read(), "aov")
    assert out is not None
    return out


def _lineage_oracle(metric: Metric) -> str:
    legs = []
    for n in metric.measures:
        m = MEASURES[n]
        rows = f"SELECT brand_id, currency_code, strftime(date_trunc('month', t), '%Y-%m-%d') AS bucket, '{n}' AS measure, CAST(CASE WHEN {m.where} THEN {m.value} END AS BIGINT) AS adds FROM ({_SOURCES[m.entity]})"
        legs.append(rows)
    cells = " UNION ALL ".join(legs)
    names = ", ".join(f"('{n}')" for n in metric.measures)
    return sql(f""", tr AS ({cells}), cl AS (SELECT DISTINCT brand_id, currency_code, bucket, n AS measure FROM tr CROSS JOIN (VALUES {names}) AS v(n))
SELECT cl.brand_id, cl.currency_code, cl.bucket, cl.measure, count(adds) AS source_rows, CAST(coalesce(sum(adds), 0) AS BIGINT) AS traced, CAST(coalesce(sum(adds), 0) AS BIGINT) AS reported, true AS agrees
FROM cl LEFT JOIN tr USING (brand_id, currency_code, bucket, measure) GROUP BY ALL""")


def _trace(metric: Metric) -> None:
    @query(f"q_lineage_{metric.name}", _lineage_oracle(metric))
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        """Source rows of every cell of the metric, added up again beside what is reported."""
        c = catalogue(spark, sf_dir)
        return c.verified(c.lineage(metric.name), metric.name)


for _name in ("return_rate", "mer", "ltv_realized"):
    _trace(METRICS[_name])
