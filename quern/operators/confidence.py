"""How sure an identity match is: a score, its band and what may be done, from strong, medium and weak evidence.

Strong keys decide first, then the adoption of a single profile by medium keys, then weak signals, which only ever ask
for review. Whatever isn't a strong match stays below the band ``exact``, and only that band may merge.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.functions.scalars import ladder

# The least score of each band, the score of an adoption, the score of a strong match.
SETTINGS = {"exact": 100, "high": 80, "medium": 50, "low": 1, "adoption": 60}
STRONG = 100


def assessed(evidence: DataFrame, settings: DataFrame | None = None) -> DataFrame:
    """``evidence`` with score, band, decision and reasons.

    Evidence has brand_id, ``strong_ids`` and ``medium_ids`` (arrays of the profiles met; null is none), ``weak_score`` and
    ``conflict`` (null is false). ``settings`` has a row for each brand that overrides some of SETTINGS; null keeps the default.
    Several profiles met by medium keys alone are ambiguous and adopt none.
    """
    rows = evidence
    if settings is not None:
        own = settings.select(F.col("brand_id").alias("_brand"), *[F.col(n).alias(f"_{n}") for n in SETTINGS if n in settings.columns])
        rows = rows.join(own, F.col("brand_id") == F.col("_brand"), "left")
    value = {n: F.coalesce(F.col(f"_{n}"), F.lit(d)) if f"_{n}" in rows.columns else F.lit(d) for n, d in SETTINGS.items()}
    met = lambda c: F.coalesce(F.size(F.array_distinct(F.array_compact(c))), F.lit(0))
    n_strong, n_medium = F.greatest(met("strong_ids"), F.lit(0)), F.greatest(met("medium_ids"), F.lit(0))
    below = value["exact"] - 1
    weak, conflict = F.coalesce("weak_score", F.lit(0)), F.coalesce("conflict", F.lit(False))
    strong = (n_strong > 0) & (value["exact"] <= STRONG)
    adopts, ambiguous = (n_strong == 0) & (n_medium == 1), (n_strong == 0) & (n_medium > 1)
    clamped = value["adoption"] >= value["exact"]
    score = F.when(strong, F.when(conflict, below).otherwise(value["exact"])).when(adopts, F.least(value["adoption"], below)).when(weak > 0, F.least(weak, below)).otherwise(0)
    decision = F.when(strong, F.when(conflict, "review").when(n_strong > 1, "merge").otherwise("link")).when(adopts, "adopt").when(weak > 0, "review").otherwise("mint")
    reasons = F.array_compact(F.array(
        F.when(strong, "strong_match"), F.when(strong & (n_strong > 1), "several_profiles"), F.when(strong & conflict, "conflict"), F.when(~strong & adopts & clamped, "adoption_clamped"),
        F.when(~strong & adopts, "medium_match"), F.when(~strong & ~adopts & (weak > 0), "weak_match"), F.when(~strong & ~adopts & (weak <= 0) & ambiguous, "ambiguous"), F.when(~strong & ~adopts & (weak <= 0), "no_match"),
    ))
    out = rows.select(*[F.col(f"`{c}`") for c in evidence.columns], score.cast("int").alias("score"), decision.alias("decision"), reasons.alias("reasons"), F.struct(*[value[n].alias(n) for n in SETTINGS]).alias("_s"))
    band = ladder([(F.col("score") >= F.col(f"_s.{b}"), b) for b in ("exact", "high", "medium", "low")], "none")
    return out.withColumn("band", band).drop("_s")
