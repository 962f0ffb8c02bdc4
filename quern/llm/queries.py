"""The corpus operators' registered queries and, where SQL has one, the DuckDB statement that must agree."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.llm import bpe, decontaminate, fim, language, licenses, mixing, neardup, personal, quality, secrets, sharding, sortmeans, topk
from quern.llm.common import Query, documents, table


def op1_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.classes(documents(spark, sf_dir))


def op3_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.digest(documents(spark, sf_dir))


def op9_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.digest(documents(spark, sf_dir))


def op8_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.digest(documents(spark, sf_dir))


def op10_hilbert_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.digest(documents(spark, sf_dir))


def op2_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.scores(documents(spark, sf_dir), table(spark, sf_dir, "labels"))


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.predict(documents(spark, sf_dir))


def op6_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.matches(documents(spark, sf_dir), table(spark, sf_dir, "benchmark"))


def op7_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


def op5_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return personal.digest(documents(spark, sf_dir))


def op11_sort_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sortmeans.digest(table(spark, sf_dir, "embeddings"))


def op12_byte_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digest(documents(spark, sf_dir), bpe.public_path())


def op13_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fim.digest(documents(spark, sf_dir))


QUERIES: dict[str, Query] = {
    "op1_near_duplicates": op1_near_duplicates,
    "op2_quality_classifier": op2_quality_classifier,
    "op3_secret_scan": op3_secret_scan,
    "op4_language_id": op4_language_id,
    "op5_personal_data": op5_personal_data,
    "op6_decontaminate": op6_decontaminate,
    "op7_exact_top_k": op7_exact_top_k,
    "op8_mix_sources": op8_mix_sources,
    "op9_license_scan": op9_license_scan,
    "op10_hilbert_shards": op10_hilbert_shards,
    "op11_sort_means": op11_sort_means,
    "op12_byte_pairs": op12_byte_pairs,
    "op13_fill_in_middle": op13_fill_in_middle,
}

def _assigned(name: str, centroids: str) -> str:
    """Each vector's nearest centroid, by distances to all of them."""
    return f"""{name} AS MATERIALIZED (
  SELECT i, min(v) AS v, min({{'d': d, 'c': c}}) AS best FROM (
    SELECT e.i, e.v, k.c, CAST(list_sum(list_transform(list_zip(e.v, k.v), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS BIGINT) AS d FROM e CROSS JOIN {centroids} AS k
  ) GROUP BY i
)"""


def _moved(name: str, centroids: str, assigned: str) -> str:
    """Floors of the means of each centroid's vectors."""
    return f"""{name} AS MATERIALIZED (
  SELECT k.c, coalesce(m.v, k.v) AS v FROM {centroids} AS k LEFT JOIN (
    SELECT c, list((s - ((s % n) + n) % n) // n ORDER BY dim) AS v FROM (
      SELECT best.c AS c, dim, CAST(sum(v[dim]) AS BIGINT) AS s, count(*) AS n FROM {assigned} CROSS JOIN range(1, 65) AS r(dim) GROUP BY 1, 2
    ) GROUP BY c
  ) AS m USING (c)
)"""


_SORT_MEANS = f"""
WITH e AS MATERIALIZED (
  SELECT row_number() OVER () AS i, vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), c0 AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY h, v) - 1 AS c, v FROM (
    SELECT sha256('1:' || CAST(vec_id AS VARCHAR)) AS h, v FROM e WHERE vec_id IS NOT NULL ORDER BY h, v LIMIT 16)
), {_assigned("a0", "c0")}, {_moved("c1", "c0", "a0")}, {_assigned("a1", "c1")}, {_moved("c2", "c1", "a1")}, {_assigned("a2", "c2")}, {_moved("c3", "c2", "a2")}, {_assigned("a3", "c3")}
SELECT e.vec_id, CAST(a.best.c AS INTEGER) AS cluster, a.best.d AS distance, CAST(sum(a.best.d) OVER (PARTITION BY a.best.c) AS BIGINT) AS cluster_inertia,
  CAST(sum(a.best.d) OVER () AS BIGINT) AS inertia, sha256(array_to_string(c3.v, ',')) AS centroid_sha256
FROM a3 AS a JOIN e USING (i) JOIN c3 ON c3.c = a.best.c
"""

_FILL_IN_MIDDLE = """
WITH h AS (
  SELECT doc_id, coalesce(text, '') AS t, sha256('7:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents
), u AS (
  SELECT doc_id, t, regexp_extract_all(t, '[^\n]*\n|[^\n]+') AS units, list_transform([1, 9, 17, 25], lambda i: CAST('0x' || substr(h, i, 8) AS BIGINT)) AS x FROM h
), n AS (
  SELECT *, len(units) AS n, t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') AS plain, least(x[1] % (len(units) + 1), x[2] % (len(units) + 1)) AS a, greatest(x[1] % (len(units) + 1), x[2] % (len(units) + 1)) AS b FROM u
), p AS (
  SELECT *, coalesce(array_to_string(units[1:a], ''), '') AS prefix, coalesce(array_to_string(units[a + 1:b], ''), '') AS middle, coalesce(array_to_string(units[b + 1:n], ''), '') AS suffix FROM n
)
SELECT doc_id, n, CASE WHEN plain THEN 'plain' WHEN x[4] % 100 < 50 THEN 'spm' ELSE 'psm' END AS form, CASE WHEN NOT plain THEN length(prefix) END AS prefix_chars, CASE WHEN NOT plain THEN length(middle) END AS middle_chars,
  sha256(CASE WHEN plain THEN t WHEN x[4] % 100 < 50 THEN '<S>' || suffix || '<P>' || prefix || '<M>' || middle ELSE '<P>' || prefix || '<S>' || suffix || '<M>' || middle END) AS output_sha256, sha256(t) AS restored_sha256
FROM p
"""

ORACLES: dict[str, str] = {
    "op11_sort_means": _SORT_MEANS,
    "op13_fill_in_middle": _FILL_IN_MIDDLE,
    "op7_exact_top_k": """
WITH e AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, e.vec_id, CAST(list_dot_product(q.v, e.v) AS BIGINT) AS score
  FROM e AS q JOIN e ON e.vec_id <> q.vec_id AND len(e.v) = len(q.v) WHERE q.vec_id % 50 = 0
)
SELECT query_id, CAST(row_number() OVER w AS INTEGER) AS "rank", vec_id, score
FROM s WINDOW w AS (PARTITION BY query_id ORDER BY score DESC, vec_id) QUALIFY row_number() OVER w <= 5
""",
}
