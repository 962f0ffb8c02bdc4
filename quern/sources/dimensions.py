"""Small dimension tables from a database, or a declared default where it can't be read."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def read_dimension(spark: SparkSession, url: str, query: str, schema: str, *, fail_closed: bool = True, rows: list[tuple] | None = None, properties: dict[str, str] | None = None) -> DataFrame:
    """Rows of a JDBC query. With ``fail_closed`` a failure to read is raised; else ``rows`` stand in.

    Reading is tried at once, for a lazy failure would come too late to fall back.
    """
    try:
        df = spark.read.format("jdbc").options(url=url, query=query, **(properties or {})).load()
        df.limit(1).count()
        return df
    except Exception:  # any driver or network failure, as the caller has chosen
        if fail_closed:
            raise
        return spark.createDataFrame(rows or [], schema)
