"""Saved segments: stored rules turned into predicates over customer profiles, previews of many rules in one pass, member lists."""

from __future__ import annotations

import json
from functools import reduce
from operator import and_, or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Saved rules that one preview takes. They are read by the driver; a longer list is an error.
MOST = 200

_TESTS = {
    "eq": lambda c, v: c == v,
    "ne": lambda c, v: c != v,
    "lt": lambda c, v: c < v,
    "le": lambda c, v: c <= v,
    "gt": lambda c, v: c > v,
    "ge": lambda c, v: c >= v,
    "in": lambda c, v: c.isin(v),
    "between": lambda c, v: c.between(*v),
    "missing": lambda c, v: c.isNull(),
}


def predicate(rule: dict, columns: list[str]) -> Column:
    """The condition of a rule: ``all`` or ``any`` of rules, ``not`` a rule, or a field, an op and a value.

    A test of a missing value fails, whatever the op (but ``missing``), so its ``not`` holds: a condition is never null.
    No rules at all make ``all`` true and ``any`` false. Unknown fields and ops are errors.
    """
    parts = [n for n in ("all", "any", "not", "field") if n in rule]
    if len(parts) != 1:
        raise ValueError(f"a rule is one of all, any, not and field: {rule}")
    if parts == ["not"]:
        return ~predicate(rule["not"], columns)
    if parts != ["field"]:
        both, none = (and_, True) if parts == ["all"] else (or_, False)
        return reduce(both, [predicate(r, columns) for r in rule[parts[0]]], F.lit(none))
    if rule["field"] not in columns:
        raise ValueError(f"profiles have no {rule['field']}")
    if rule.get("op") not in _TESTS:
        raise ValueError(f"no such test: {rule.get('op')}")
    return F.coalesce(_TESTS[rule["op"]](F.col(f"`{rule['field']}`"), rule.get("value")), F.lit(False))


def preview(profiles: DataFrame, segments: DataFrame, most: int = MOST) -> DataFrame:
    """How many of its brand's profiles each saved segment (brand_id, segment_id, definition as JSON) matches, of how many.

    Profiles are read once for all segments and counted by partial aggregates. A brand without profiles has state
    ``no_data`` and no counts. A segment never counts another brand's profiles.
    """
    saved = segments.select("brand_id", "segment_id", "definition").limit(most + 1).collect()
    if len(saved) > most:
        raise ValueError(f"more than {most} segments in one preview")
    found = segments.select("brand_id", "segment_id")
    if not saved:
        return found.select("*", F.lit("no_data").alias("state"), F.lit(None).cast("bigint").alias("matched"), F.lit(None).cast("bigint").alias("total"))
    fits = [predicate(json.loads(s["definition"]), profiles.columns) & (F.col("brand_id") == s["brand_id"]) for s in saved]
    counts = profiles.where(F.col("brand_id").isin(sorted({s["brand_id"] for s in saved}))).groupBy("brand_id")
    counts = counts.agg(F.count("*").alias("total"), *[F.count_if(fit).alias(f"_{i}") for i, fit in enumerate(fits)])
    one = lambda i, s: F.struct(F.lit(s["brand_id"]).alias("_brand"), F.lit(s["segment_id"]).alias("segment_id"), F.col(f"_{i}").alias("matched"))
    counts = counts.select("brand_id", "total", F.inline(F.array(*[one(i, s) for i, s in enumerate(saved)]))).where(F.col("_brand") == F.col("brand_id"))
    state = F.when(F.col("total").isNull(), "no_data").otherwise("has_data").alias("state")
    return found.join(counts.drop("_brand"), ["brand_id", "segment_id"], "left").select("brand_id", "segment_id", state, "matched", "total")


def acquired_by(profiles: DataFrame, brand_id: str, source: str | None, most: int | None = None) -> DataFrame:
    """Profiles of a brand that came by an acquisition source; none for a blank one. ``most`` keeps the smallest ids."""
    wanted = (source or "").strip()
    members = profiles.where((F.col("brand_id") == brand_id) & (F.col("acquisition_source") == wanted) & F.lit(bool(wanted)) & F.col("profile_id").isNotNull()).select("profile_id")
    return members if most is None else members.orderBy("profile_id").limit(most)
