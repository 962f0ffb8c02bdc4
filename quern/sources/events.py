"""Raw event logs: reading, lifting JSON envelopes to columns, and admission to the typed event table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from quern.functions.scalars import event_category, identify_denied

ENVELOPE = ("event_id", "brand_id", "event_name", "occurred_at", "ingested_at", "schema_version", "correlation_id")


def prop(column: str, path: str) -> Column:
    """A string at ``$.properties.<path>`` of a JSON column."""
    return F.get_json_object(column, f"$.properties.{path}")


def field(column: str, path: str) -> Column:
    return F.get_json_object(column, f"$.{path}")


def read_log(spark: SparkSession, path: str, schema: StructType | None = None) -> DataFrame:
    """An append-only log of Parquet files; columns that later files add are null in earlier ones."""
    reader = spark.read.option("mergeSchema", "true")
    return (reader.schema(schema) if schema else reader).parquet(path)


def or_empty(spark: SparkSession, path: str, schema: str | StructType) -> DataFrame:
    """A stored table, or an empty one of the declared schema where none has been written yet."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    there = hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(hadoop)
    return spark.read.schema(schema).parquet(path) if there else spark.createDataFrame([], schema)


LIFTED = ", ".join(f"{f} string" for f in ENVELOPE) + ", consent_flags string, properties struct<consent_state string, install_token string>"


def lift(raw: DataFrame, payload: str = "payload") -> DataFrame:
    """Envelope fields as columns; ``pj`` keeps the JSON for fields that single jobs read.

    A row is parsed once, by a declared schema. The generator keeps filters above the parse, where pushing them
    below would repeat it.
    """
    rows = raw.select(F.col(payload).alias("pj"), F.inline(F.array(F.from_json(payload, LIFTED))))
    consent = [field("consent_flags", c).alias(f"consent_{c}") for c in ("analytics", "marketing")]
    return rows.select(*ENVELOPE, *consent, "consent_flags", "properties.consent_state", "properties.install_token", "pj")


def admit(raw: DataFrame, tokens: DataFrame, server_names: tuple[str, ...], dropped_names: tuple[str, ...] = (), payload: str = "payload") -> DataFrame:
    """The admission gate.

    Events without id, tenant or time are dropped, and those of ``dropped_names``. Events that
    servers send keep the tenant that they claim. Pixel events need a consent object, must not be
    denied, and their token must belong to the tenant that they claim (a left join with the token
    table, so both lanes are one pass).
    """
    rows = lift(raw, payload)
    rows = rows.where(F.col("event_id").isNotNull() & F.col("brand_id").isNotNull() & F.try_to_timestamp("occurred_at").isNotNull())
    rows = rows.where(~F.coalesce(F.col("event_name").isin(*dropped_names), F.lit(False)) if dropped_names else F.lit(True))
    rows = rows.withColumn("occurred_at", F.try_to_timestamp("occurred_at")).withColumn("ingested_at", F.try_to_timestamp("ingested_at"))
    server = F.coalesce(F.col("event_name").isin(*server_names), F.lit(False))
    denied = identify_denied(F.col("event_name"), F.col("consent_state"), F.col("consent_analytics"))
    known = tokens.select("install_token", "brand_id").distinct().withColumn("_known", F.lit(True))
    pixel = F.col("consent_flags").isNotNull() & ~denied & F.coalesce(F.col("_known"), F.lit(False))
    lane = F.when(server, "server").when(pixel, "pixel")
    out = rows.join(known, ["install_token", "brand_id"], "left").withColumn("lane", lane).where(F.col("lane").isNotNull())
    return out.select(*rows.columns, "lane").withColumn("category", event_category(F.col("event_name")))


def scan(events: DataFrame, names: list[str], window: tuple = (None, None)) -> DataFrame:
    """Admitted events of some names, in an ingest window whose both ends count."""
    rows = events.where(F.col("event_name").isin(*names))
    low, high = window
    rows = rows if low is None else rows.where(F.col("ingested_at") >= F.lit(low))
    return rows if high is None else rows.where(F.col("ingested_at") <= F.lit(high))
