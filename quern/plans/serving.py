"""Tenant-scoped reads: a guarded SELECT over filtered views, and JSON-safe results."""

from __future__ import annotations

import math
import re
import threading
from collections.abc import Iterator
from datetime import date, datetime
from decimal import Decimal

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_QUOTED = re.compile(r"'(?:[^'\\]|''|\\.)*'|\"(?:[^\"]|\"\")*\"|`[^`]*`|--[^\n]*|/\*.*?\*/", re.S)
_WRITES = re.compile(r"\b(insert|update|delete|merge|drop|alter|create|truncate|attach|copy|set|reset|call|use|refresh|cache|uncache|load|add)\b", re.I)
SAFE_INTEGER = 2**53


def guard(statement: str) -> str:
    """The statement if it is one SELECT or WITH; literals and comments don't count as its words."""
    bare = _QUOTED.sub(" ", statement).strip().rstrip(";").strip()
    if not bare:
        raise ValueError("empty statement")
    if ";" in bare:
        raise ValueError("one statement only")
    if not re.match(r"(select|with)\b", bare, re.I):
        raise ValueError("only SELECT and WITH are allowed")
    if _WRITES.search(bare):
        raise ValueError("the statement writes or changes settings")
    return statement.strip().rstrip(";")


def for_brand(df: DataFrame, brand: str | None) -> DataFrame:
    """The rows of one tenant; without a tenant nothing is read."""
    if not brand:
        raise PermissionError("a tenant is needed")
    return df.where(F.col("brand_id") == brand)


def serve(spark: SparkSession, statement: str, views: dict[str, DataFrame], brand: str, timeout_s: float = 25.0, limit: int = 10_000) -> list[dict]:
    """Rows of a guarded statement over tenant-filtered views, within a time and a row limit."""
    statement = guard(statement)
    for name, df in views.items():
        for_brand(df, brand).createOrReplaceTempView(name)
    tag = f"serve-{threading.get_ident()}"
    timer = threading.Timer(timeout_s, lambda: spark.sparkContext.cancelJobsWithTag(tag))
    spark.sparkContext.addJobTag(tag)
    timer.start()
    try:
        return list(safe_rows(spark.sql(statement).limit(limit)))
    finally:
        timer.cancel()
        spark.sparkContext.removeJobTag(tag)
        for name in views:
            spark.catalog.dropTempView(name)


def safe(value):
    """A value as JSON can carry it: large integers and decimals as text, no NaN or infinities."""
    if isinstance(value, bool) or value is None or isinstance(value, str):
        return value
    if isinstance(value, int):
        return str(value) if abs(value) > SAFE_INTEGER else value
    if isinstance(value, float):
        return value if math.isfinite(value) else None
    if isinstance(value, Decimal):
        return str(value)
    if isinstance(value, (datetime, date)):
        return value.isoformat()
    if isinstance(value, dict):
        return {str(k): safe(v) for k, v in value.items()}
    if hasattr(value, "asDict"):
        return safe(value.asDict())
    if isinstance(value, (list, tuple)):
        return [safe(v) for v in value]
    return value.hex() if isinstance(value, (bytes, bytearray)) else str(value)


def safe_rows(df: DataFrame) -> Iterator[dict]:
    for row in df.toLocalIterator():
        yield safe(row)
