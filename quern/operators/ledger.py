"""An insert-only ledger of attribution credits: refolds that supersede, and clawbacks by the saved weights.

A row is a credit, the reversal of one, or a clawback of one; nothing is changed or deleted. ``refold`` compares a fresh
fold with the credits that stand: of groups (a journey and model) that the fold emits, credits that are gone or differ are
reversed, credits that are new or differ are appended, and equal ones aren't touched. Row ids follow from content and from how often
its credit was written, so a rerun over the same ledger adds nothing. A credit that was clawed back is never
reversed, as its clawback tells its weight. Ledger and fold meet in one grouping by credit; only the rows to append come out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern.functions.scalars import deterministic_id
from quern.operators.economics import apportion

CREDIT, REVERSAL, CLAWBACK = "credit", "reversal", "clawback"


def empty(fold: DataFrame, keys: list[str], seq: str) -> DataFrame:
    """A ledger without rows for folds of these columns."""
    return _credits(fold.limit(0).withColumn("occurrence", F.lit(0).cast("bigint")), keys, seq).limit(0)


def _credits(rows: DataFrame, keys: list[str], seq: str) -> DataFrame:
    own = deterministic_id(F.col("credit_id"), F.col("weight"), F.col("credit_minor"), F.col("occurrence"))
    return rows.select(
        *keys, "model", seq, "credit_id", "weight", "credit_minor", F.lit(CREDIT).alias("row_kind"), "occurrence", own.alias("row_id"), F.lit(None).cast("string").alias("reversed_of"), F.lit(None).cast("string").alias("refund_id")
    )


def standing(ledger: DataFrame, keys: list[str], seq: str, extra: list[Column] | None = None) -> DataFrame:
    """Each credit's last row (``held``), whether it stands (``live``), how often it was written, and what was clawed back of it."""
    is_ = lambda k: F.col("row_kind") == k
    row = F.struct(seq, "weight", "credit_minor", "row_id")
    return (
        ledger.groupBy(*keys, "model", "credit_id")
        .agg(
            F.max_by(F.when(is_(CREDIT), row), F.when(is_(CREDIT), F.col("occurrence"))).alias("held"), F.count_if(is_(CREDIT)).alias("written"), F.count_if(is_(REVERSAL)).alias("_off"),
            F.coalesce(F.sum(F.when(is_(CLAWBACK), F.col("credit_minor"))), F.lit(0)).cast("bigint").alias("clawed"), *(extra or []),
        )
        .withColumn("live", F.col("written") > F.col("_off"))
        .drop("_off")
    )


def refold(ledger: DataFrame, fold: DataFrame, keys: list[str], seq: str) -> DataFrame:
    """The rows that a fresh fold (keys, model, seq, credit_id, weight, credit_minor) appends to the ledger."""
    fresh = fold.select(*keys, "model", seq, "credit_id", "weight", "credit_minor", F.lit("fresh").alias("row_kind"))
    now = F.max(F.when(F.col("row_kind") == "fresh", F.struct(seq, "weight", "credit_minor"))).alias("now")
    met = standing(ledger.unionByName(fresh, allowMissingColumns=True), keys, seq, [now])
    folded = F.bool_or(F.col("now").isNotNull()).over(Window.partitionBy(*keys, "model"))
    at = lambda side: F.struct(F.col(f"{side}.weight").alias("w"), F.col(f"{side}.credit_minor").alias("c"))
    same = F.col("live") & F.col("now").isNotNull() & (at("held") == at("now"))
    clawed = F.col("live") & (F.col("clawed") != 0)
    met = met.withColumn("_back", F.col("live") & folded & ~same & ~clawed).withColumn("_add", F.col("now").isNotNull() & ~same & ~clawed)
    back = met.where("_back").select(
        *keys, "model", f"held.{seq}", "credit_id", "held.weight", (-F.col("held.credit_minor")).alias("credit_minor"), F.lit(REVERSAL).alias("row_kind"), F.col("written").alias("occurrence"),
        deterministic_id(F.lit(REVERSAL), F.col("held.row_id")).alias("row_id"), F.col("held.row_id").alias("reversed_of"), F.lit(None).cast("string").alias("refund_id"),
    )
    add = met.where("_add").select(*keys, "model", "now.*", "credit_id", (F.col("written") + 1).alias("occurrence"))
    return back.unionByName(_credits(add, keys, seq))


def claw_back(ledger: DataFrame, refunds: DataFrame, keys: list[str], seq: str) -> DataFrame:
    """The rows that refunds (keys, refund_id, refund_minor) append: negative credits by the standing credits' weights.

    Refunds of one journey are taken in order of their ids; together, and with those before, they take back
    what was credited at most. A refund that the ledger has adds nothing.
    """
    group = Window.partitionBy(*keys, "model")
    stand = standing(ledger, keys, seq).where("live").select(*keys, "model", "credit_id", "held.*", "clawed")
    stand = stand.withColumn("_left", F.sum("credit_minor").over(group) + F.sum("clawed").over(group)).drop("clawed")
    known = ledger.where(F.col("row_kind") == CLAWBACK).select(*keys, "refund_id").distinct()
    new = refunds.join(known, [*keys, "refund_id"], "left_anti")
    before = Window.partitionBy(*keys).orderBy("refund_id").rowsBetween(Window.unboundedPreceding, -1)
    new = new.select(*keys, "refund_id", "refund_minor", F.coalesce(F.sum("refund_minor").over(before), F.lit(0)).alias("_before"))
    rows = stand.drop("credit_minor").join(new, keys)
    zero = F.lit(0).cast("bigint")
    rows = rows.withColumn("_back", -F.least(F.col("refund_minor"), F.greatest(zero, F.col("_left") - F.col("_before"))).cast("bigint"))
    split = apportion(rows, [*keys, "model", "refund_id"], "_back", "weight", [F.col(seq)], "credit_minor")
    return split.select(
        *keys, "model", seq, "credit_id", "weight", "credit_minor", F.lit(CLAWBACK).alias("row_kind"), F.lit(1).cast("bigint").alias("occurrence"),
        deterministic_id(F.col("refund_id"), F.col("row_id")).alias("row_id"), F.col("row_id").alias("reversed_of"), F.col("refund_id").cast("string").alias("refund_id"),
    )
