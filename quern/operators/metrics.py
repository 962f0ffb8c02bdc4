"""Declared metrics compiled to DataFrames: measures of an entity, grain, blends of two entities, pre-aggregates."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.operators.tables import StoredTable

GRAINS = ("day", "week", "month", "all")
CELL = ["brand_id", "currency_code", "bucket"]


@dataclass(frozen=True)
class Measure:
    """An additive sum or count of SQL expressions over an entity's rows."""

    entity: str
    value: str = "1"
    where: str = "true"
    additive: bool = True

    def column(self) -> Column:
        kept = F.when(F.expr(self.where), F.expr(self.value).cast("bigint"))
        return F.coalesce(F.sum(kept), F.lit(0)).cast("bigint") if self.additive else F.count_distinct(F.when(F.expr(self.where), F.expr(self.value)))


@dataclass(frozen=True)
class Metric:
    """A metric: its measures and the integer expression over their names."""

    name: str
    measures: tuple[str, ...]
    expression: str
    dimensions: tuple[str, ...] = ()


@dataclass(frozen=True)
class Entity:
    """A relation with the tenant's column, a time, a currency and the predicate that makes its rows final."""

    load: Callable[[], DataFrame]
    time: str
    final: str | None = None
    dimensions: tuple[str, ...] = field(default=())
    key: tuple[str, ...] = ()


def bucket(time: str, grain: str) -> Column:
    if grain not in GRAINS:
        raise ValueError(f"unknown grain {grain}")
    return F.lit("all") if grain == "all" else F.date_format(F.date_trunc(grain, time), "yyyy-MM-dd")


class Catalogue:
    """Entities, measures and metrics of a domain; compiles a metric for a grain, dimensions and tenant."""

    def __init__(self, entities: dict[str, Entity], measures: dict[str, Measure], metrics: dict[str, Metric]) -> None:
        self.entities, self.measures, self.metrics = entities, measures, metrics

    def _legs(self, names: tuple[str, ...]) -> dict[str, list[str]]:
        legs: dict[str, list[str]] = {}
        for n in names:
            legs.setdefault(self.measures[n].entity, []).append(n)
        return legs

    def _leg(self, entity: str, names: list[str], grain: str, dimensions: tuple[str, ...], brand: str | None, only: DataFrame | None = None) -> DataFrame:
        e = self.entities[entity]
        rows = e.load()
        if e.final is None:
            raise ValueError(f"{entity} declares no predicate for final rows")
        rows = rows.where(e.final)
        if brand is not None:
            rows = rows.where(F.col("brand_id") == brand)
        missing = set(dimensions) - set(rows.columns)
        if missing:
            raise ValueError(f"{entity} lacks dimensions {sorted(missing)}")
        rows = rows.withColumn("bucket", bucket(e.time, grain))
        if only is not None:
            rows = rows.join(only, CELL, "left_semi")
        return rows.groupBy(*CELL, *dimensions).agg(*[self.measures[n].column().alias(n) for n in names])

    def aggregate(self, metric: str, grain: str, dimensions: tuple[str, ...] = (), brand: str | None = None, only: DataFrame | None = None) -> DataFrame:
        """The metric's measures by tenant, currency, bucket and dimensions.

        Legs of different entities are aggregated by themselves, padded with nulls and summed: no join
        of facts, so neither side fans out.
        """
        legs = [self._leg(e, names, grain, dimensions, brand, only) for e, names in self._legs(self.metrics[metric].measures).items()]
        if len(legs) == 1:
            return legs[0]
        out = legs[0]
        for leg in legs[1:]:
            out = out.unionByName(leg, allowMissingColumns=True)
        names = self.metrics[metric].measures
        return out.groupBy("brand_id", "currency_code", "bucket", *dimensions).agg(*[F.coalesce(F.sum(n), F.lit(0)).cast("bigint").alias(n) for n in names])

    def compile(self, metric: str, grain: str = "month", dimensions: tuple[str, ...] = (), brand: str | None = None) -> DataFrame:
        m = self.metrics[metric]
        return self.aggregate(metric, grain, dimensions, brand).select("brand_id", "currency_code", "bucket", *dimensions, F.expr(m.expression).alias("value"))

    def from_preaggregate(self, stored: DataFrame, metric: str, dimensions: tuple[str, ...] = ()) -> DataFrame | None:
        """The metric from a stored aggregate of finer dimensions, or None where it can't serve it.

        Distinct counts don't add up, so a metric that has one is served only at the stored grain.
        """
        m = self.metrics[metric]
        keys = ["brand_id", "currency_code", "bucket", *dimensions]
        if not set([*keys, *m.measures]) <= set(stored.columns):
            return None
        coarser = set(stored.columns) - set(keys) - set(self.measures)
        if coarser and not all(self.measures[n].additive for n in m.measures):
            return None
        rows = stored.groupBy(*keys).agg(*[F.sum(n).cast("bigint").alias(n) for n in m.measures]) if coarser else stored
        return rows.select(*keys, F.expr(m.expression).alias("value"))

    def rebuild(self, table: StoredTable, metric: str, grain: str = "month", dimensions: tuple[str, ...] = ()) -> None:
        """The metric's measures stored anew; readers see the old ones until all is written."""
        table.replace(self.aggregate(metric, grain, dimensions), metric=metric, grain=grain, dimensions=",".join(dimensions))

    def upkeep(self, table: StoredTable, changed: DataFrame) -> None:
        """The stored measures of changed cells (tenant, currency, bucket) reckoned again, from those cells' source rows alone.

        A cell whose source rows are gone loses its rows. ``table`` must be keyed by the cell.
        """
        facts = table.facts()
        cells = changed.select(*CELL).distinct()
        dimensions = tuple(d for d in facts["dimensions"].split(",") if d)
        table.swap(self.aggregate(facts["metric"], facts["grain"], dimensions, only=cells), cells)

    def lineage(self, metric: str, grain: str = "month", brand: str | None = None) -> DataFrame:
        """Each source row that a cell of the metric is made of: cell, measure, entity, the row's id and what it adds.

        One pass a leg, without a shuffle: rows become one row for each measure that they count in. The
        contributions of a cell add up to its measures (``verified`` tells whether they do).
        """
        out = None
        for entity, names in self._legs(self.metrics[metric].measures).items():
            e = self.entities[entity]
            if not e.key or not all(self.measures[n].additive for n in names):
                raise ValueError(f"rows of {entity} can't be traced: it declares no key, or a measure isn't a sum")
            rows = e.load().where(e.final or "true").withColumn("bucket", bucket(e.time, grain))
            rows = rows if brand is None else rows.where(F.col("brand_id") == brand)
            parts = [F.when(F.expr(self.measures[n].where), F.struct(F.lit(n).alias("measure"), F.expr(self.measures[n].value).cast("bigint").alias("adds"))) for n in names]
            told = F.explode(F.filter(F.array(*parts), lambda x: x.isNotNull() & x["adds"].isNotNull())).alias("_m")
            leg = rows.select(*CELL, F.lit(entity).alias("entity"), F.concat_ws(":", *[F.col(k).cast("string") for k in e.key]).alias("source_id"), told)
            leg = leg.select(*CELL, "_m.measure", "entity", "source_id", "_m.adds")
            out = leg if out is None else out.unionByName(leg)
        return out

    def verified(self, traced: DataFrame, metric: str, grain: str = "month") -> DataFrame:
        """Per cell and measure: source rows, their sum, the reported measure, and whether the two agree."""
        names = self.metrics[metric].measures
        reported = self.aggregate(metric, grain).select(*CELL, F.inline(F.array(*[F.struct(F.lit(n).alias("measure"), F.col(n).alias("reported")) for n in names])))
        sums = traced.groupBy(*CELL, "measure").agg(F.count("*").alias("source_rows"), F.sum("adds").alias("traced"), F.count_distinct("entity").alias("entities"))
        zero = F.lit(0).cast("bigint")
        both = reported.join(sums, [*CELL, "measure"], "full_outer")
        both = both.select(*CELL, "measure", F.coalesce("source_rows", zero).alias("source_rows"), F.coalesce("traced", zero).alias("traced"), "reported")
        return both.withColumn("agrees", F.col("traced").eqNullSafe(F.col("reported")))
