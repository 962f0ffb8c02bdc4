"""Valid-time cost sheets: uploads that are refused where they overlap, or that split the bands they correct.

A sheet has keys, valid_from, valid_to (null while open, else exclusive), values and upload, the number of the upload that a
band is from. Bands of a key don't overlap. All work is by key: equi-joins, and windows over a key's bands.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SPAN = ["valid_from", "valid_to"]


def _ends(span: Column) -> Column:
    """An end that compares: an open one comes after all."""
    return F.coalesce(span, F.lit("9999-12-31").cast("date"))


def refuse_overlaps(sheet: DataFrame, upload: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame]:
    """(sheet, refused rows with reason): a row of a known key and start restates its band; any other must not overlap.

    Within an upload the first row of a key and start counts, and rows that overlap one that starts before them are refused; so is a
    band that doesn't end after its start. A restated band may change its values and end.
    """
    values = [c for c in upload.columns if c not in (*keys, *SPAN)]
    start = Window.partitionBy(*keys, "valid_from").orderBy(_ends(F.col("valid_to")), F.struct(*values))
    before = Window.partitionBy(*keys).orderBy("valid_from").rowsBetween(Window.unboundedPreceding, -1)
    rows = upload.withColumn("_rank", F.row_number().over(start))
    rows = rows.withColumn("_met", F.max(F.when(F.col("_rank") == 1, _ends(F.col("valid_to")))).over(before))
    held = sheet.select(*keys, F.col("valid_from").alias("_f"), F.col("valid_to").alias("_t"))
    clash = (F.col("_f") < _ends(F.col("valid_to"))) & (F.col("valid_from") < _ends(F.col("_t"))) & (F.col("_f") != F.col("valid_from"))
    met = rows.join(held, keys, "left").groupBy(*rows.columns).agg(F.bool_or(F.coalesce(clash, F.lit(False))).alias("_clash"))
    reason = (
        F.when(F.col("valid_to") <= F.col("valid_from"), "ends before it starts")
        .when(F.col("_rank") > 1, "given twice")
        .when(F.col("_met") > F.col("valid_from"), "overlaps a row of this upload")
        .when(F.col("_clash"), "overlaps a stored band")
    )
    told = met.withColumn("reason", reason)
    taken = told.where(F.col("reason").isNull()).select(*upload.columns)
    kept = sheet.join(taken.select(*keys, "valid_from"), [*keys, "valid_from"], "left_anti")
    return kept.unionByName(taken), told.where(F.col("reason").isNotNull()).select(*upload.columns, "reason")


def correct(sheet: DataFrame, upload: DataFrame, keys: list[str]) -> DataFrame:
    """The sheet after an upload that counts wherever it holds: bands that it covers in part are closed or split, the rest stays.

    Both are cut at all their starts and ends; each piece goes to the latest upload that holds it (of one upload the
    band that starts later, then the greater values), and neighbouring pieces of one band are one again.
    """
    values = [c for c in sheet.columns if c not in (*keys, *SPAN, "upload")]
    rows = sheet.unionByName(upload).where(_ends(F.col("valid_to")) > F.col("valid_from"))
    cuts = rows.select(*keys, F.explode(F.array("valid_from", _ends(F.col("valid_to")))).alias("_at")).distinct()
    by_key = Window.partitionBy(*keys).orderBy("_at")
    pieces = cuts.withColumn("_to", F.lead("_at").over(by_key)).where(F.col("_to").isNotNull())
    band = F.struct("upload", F.col("valid_from").alias("start"), F.struct(*values).alias("values"))
    held = pieces.join(rows, keys).where((F.col("valid_from") <= F.col("_at")) & (F.col("_at") < _ends(F.col("valid_to"))))
    won = held.groupBy(*keys, "_at", "_to").agg(F.max(band).alias("_b"))
    fresh = ~F.coalesce((F.lag("_b").over(by_key) == F.col("_b")) & (F.lag("_to").over(by_key) == F.col("_at")), F.lit(False))
    run = won.withColumn("_new", fresh.cast("int")).withColumn("_run", F.sum("_new").over(by_key))
    whole = run.groupBy(*keys, "_run").agg(F.min("_at").alias("valid_from"), F.max("_to").alias("_end"), F.max("_b").alias("_b"))
    end = F.when(F.col("_end") < F.lit("9999-12-31").cast("date"), F.col("_end")).alias("valid_to")
    return whole.select(*keys, "valid_from", end, "_b.values.*", F.col("_b.upload").alias("upload")).select(*sheet.columns)
