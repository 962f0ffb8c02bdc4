"""G36 and G21 over the reference's whole job."""

from __future__ import annotations

from pyspark.sql import functions as F

from quern.plans import catalogue


def test_signatures_have_more_than_three_steps(spark, tables):
    steps = catalogue.QUERIES["g36_journey_paths_whole"](spark, tables).select(F.max(F.size(F.split("signature", " > ")))).first()[0]
    assert 3 < steps <= 12


def test_affinity_pairs_products_themselves(spark, tables):
    assert catalogue.QUERIES["g21_product_affinity_whole"](spark, tables).select(F.max("item_b")).first()[0] >= 50
