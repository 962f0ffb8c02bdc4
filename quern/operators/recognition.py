"""Revenue recognition: an order becomes signed ledger events, and those fold to its state."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Event, sign, lifecycle state, whether terminal, rank among events at one time.
EVENTS = (
    ("provisional_recognition", 1, "placed", False, 10),
    ("finalization", 1, "confirmed", False, 20),
    ("cod_delivery_confirmed", 1, "delivered", True, 90),
    ("cod_rto_clawback", -1, "rto", True, 85),
    ("cancellation", -1, "cancelled", True, 80),
    ("refund", -1, "refunded", True, 70),
)


def recognise(orders: DataFrame, *, as_of: str, horizon_days: int | Column = 7) -> DataFrame:
    """All ledger events of all orders, from one scan.

    Orders have placed_at, amount_minor, payment_method, terminal_class, is_cancelled and is_refunded.
    Each event is an array element that is null unless its condition holds, so no union re-reads
    the input. ``horizon_days`` may be a column (a tenant's own horizon).
    """
    days = horizon_days if isinstance(horizon_days, Column) else F.lit(horizon_days)
    final_at = F.col("placed_at") + F.make_dt_interval(days)
    cod = F.col("payment_method") == "cod"
    dead = F.col("is_cancelled") | F.col("is_refunded")
    holds = {
        "provisional_recognition": F.lit(True),
        "finalization": (F.col("payment_method") == "prepaid") & (final_at < F.to_timestamp(F.lit(as_of))) & ~dead,
        "cod_delivery_confirmed": cod & (F.col("terminal_class") == "delivered"),
        "cod_rto_clawback": cod & (F.col("terminal_class") == "rto"),
        "cancellation": F.col("is_cancelled"),
        "refund": F.col("is_refunded"),
    }
    events = [
        F.when(
            holds[kind],
            F.struct(
                F.lit(kind).alias("event_type"),
                (final_at if kind == "finalization" else F.col("placed_at")).alias("effective_at"),
                (F.lit(sign) * F.col("amount_minor")).alias("signed_minor"),
                F.lit(state).alias("state"),
                F.lit(terminal).alias("terminal"),
                F.lit(rank).alias("rank"),
            ),
        )
        for kind, sign, state, terminal, rank in EVENTS
    ]
    return orders.select("*", F.inline(F.filter(F.array(*events), lambda e: e.isNotNull())))


def order_state(events: DataFrame, keys: list[str]) -> DataFrame:
    """Per order: winning state (terminal first, then latest, then by rank), realised value, times.

    One aggregate that combines before its shuffle, in place of a window over all events.
    """
    provisional = F.col("event_type") == "provisional_recognition"
    return events.groupBy(*keys).agg(
        F.max_by("state", F.struct("terminal", "effective_at", "rank")).alias("state"),
        F.bool_or("terminal").alias("is_terminal"),
        F.coalesce(F.sum(F.when(~provisional, F.col("signed_minor"))), F.lit(0)).cast("bigint").alias("realized_minor"),
        F.min("placed_at").alias("placed_at"),
        F.max("effective_at").alias("last_at"),
        F.max(F.when(provisional, F.col("signed_minor"))).alias("amount_minor"),
    )


def composition(ledger: DataFrame, as_of: str) -> DataFrame:
    """What realised revenue is made of up to and with a day: signed sums by tenant, event and currency, without provisional ones."""
    rows = ledger.where((F.col("effective_at").cast("date") <= F.lit(as_of).cast("date")) & (F.col("event_type") != "provisional_recognition"))
    return rows.groupBy("brand_id", "event_type", "currency_code").agg(F.coalesce(F.sum("signed_minor"), F.lit(0)).cast("bigint").alias("amount_minor"))
