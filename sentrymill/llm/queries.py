"""Queries of the llm problems (p3, p5 to p8) and their SQL twins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sentrymill.llm import bpe, overlap
from sentrymill.llm.mixture import Mixture
from sentrymill.llm.quota_sample import QuotaSample
from sentrymill.llm.residue import Residue, without_residue
from sentrymill.sources.tables import bounded_broadcast, table


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return overlap.pairs(overlap.overlaps(table(spark, d, "combined_dataset")))


def p3_report(spark: SparkSession, d: str) -> DataFrame:
    records = table(spark, d, "combined_dataset")
    names = bounded_broadcast(table(spark, d, "dataset_catalog").select("dataset_id", F.col("dataset_name").alias("source")))
    found = overlap.overlaps(records)
    return overlap.report(records.select("record_id", "split", "dataset_id").join(names, "dataset_id", "left"), found, "source")


def p3_coverage(spark: SparkSession, d: str) -> DataFrame:
    records = table(spark, d, "combined_dataset")
    names = bounded_broadcast(table(spark, d, "dataset_catalog").select("dataset_id", F.col("dataset_name").alias("source")))
    found = overlap.overlaps(records)
    return overlap.coverage(records.select("record_id", "split", "dataset_id").join(names, "dataset_id", "left"), found, "source")


def _quota(spark: SparkSession, d: str) -> QuotaSample:
    return QuotaSample(table(spark, d, "combined_dataset"), table(spark, d, "dataset_catalog"), table(spark, d, "sample_targets"))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return _quota(spark, d).unmet()


def p5_report(spark: SparkSession, d: str) -> DataFrame:
    return _quota(spark, d).report()


def p5_sample(spark: SparkSession, d: str) -> DataFrame:
    return _quota(spark, d).sample()


def p6_ids(spark: SparkSession, d: str) -> DataFrame:
    return bpe.encoded(table(spark, d, "documents"), "doc_id", "text")


def _mixture(spark: SparkSession, d: str) -> Mixture:
    return Mixture(table(spark, d, "documents"), table(spark, d, "mix_targets"))


def p7_mix(spark: SparkSession, d: str) -> DataFrame:
    return _mixture(spark, d).mix()


def p7_shares(spark: SparkSession, d: str) -> DataFrame:
    return _mixture(spark, d).shares()


def p7_limits(spark: SparkSession, d: str) -> DataFrame:
    return _mixture(spark, d).limits()


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return Residue(table(spark, d, "documents")).found()


def p8_documents(spark: SparkSession, d: str) -> DataFrame:
    return without_residue(table(spark, d, "documents"))


QUERIES = {
    f.__name__: f
    for f in (p3_found, p3_report, p3_coverage, p5_found, p5_report, p5_sample, p6_ids, p7_mix, p7_shares, p7_limits, p8_found, p8_documents)
}

_AGREE = " + ".join(
    f"(CASE WHEN (a.{m} IS NULL AND b.{m} IS NULL) OR abs(a.{m} - b.{m}) <= 0.01 * greatest(abs(a.{m}), abs(b.{m})) THEN 1 ELSE 0 END)"
    for m in overlap.MEASUREMENTS
)
_P3 = f"""
agreed AS (
  SELECT a.record_id AS s, b.record_id AS h, {_AGREE} AS n
  FROM combined_dataset a JOIN combined_dataset b ON a.split = 'train' AND b.split IN ('valid', 'test')),
found AS (SELECT * FROM agreed WHERE n >= 13)
"""
_P5 = """
size AS (SELECT count(*) // 10 AS s FROM combined_dataset),
there AS (SELECT c.dataset_name, d.label_family, count(*) AS n FROM combined_dataset d JOIN dataset_catalog c USING (dataset_id) GROUP BY 1, 2),
needs AS (
  SELECT t.dataset_name, t.label_family, coalesce(there.n, 0) AS available,
         greatest(t.min_rows, CAST(floor(CAST(t.target_share AS DECIMAL(18, 9)) * s + 0.5) AS BIGINT)) AS need
  FROM sample_targets t CROSS JOIN size LEFT JOIN there ON there.dataset_name = t.dataset_name AND there.label_family = t.label_family)
"""

# The size that shares leave over is spread by one factor on all shares, clamped to each cell's bounds: the total is piecewise linear in it.
_QUOTAS = """
cells AS (
  SELECT n.dataset_name, n.label_family, t.target_share, CAST(t.min_rows AS BIGINT) AS min_rows, n.need, n.available, least(t.min_rows, n.available) AS low,
         row_number() OVER (ORDER BY n.dataset_name, n.label_family) AS i, (SELECT s FROM size) AS s
  FROM needs n JOIN sample_targets t USING (dataset_name, label_family)),
steps AS (
  SELECT low / target_share AS f FROM cells WHERE target_share > 0 UNION SELECT available / target_share FROM cells WHERE target_share > 0 UNION SELECT 0.0),
totals AS (SELECT f, sum(greatest(low, least(available, f * target_share))) AS total, any_value(s) AS s FROM steps, cells GROUP BY f),
below AS (SELECT max(f) AS f, max(total) AS total, any_value(s) AS s FROM totals WHERE total <= s),
above AS (SELECT min(f) AS f, min(total) AS total FROM totals WHERE total >= s),
factor AS (
  SELECT CASE WHEN above.f IS NULL THEN 1e30 WHEN below.f IS NULL THEN 0.0 WHEN above.total = below.total THEN below.f
              ELSE below.f + (s - below.total) * (above.f - below.f) / (above.total - below.total) END AS f FROM below, above),
ideal AS (
  SELECT c.*, greatest(low, least(available, factor.f * target_share)) AS x, factor.f * target_share > low AND factor.f * target_share < available AS free FROM cells c, factor),
floored AS (SELECT *, CAST(floor(x + 1e-9) AS BIGINT) AS base FROM ideal),
ranked_cells AS (SELECT *, row_number() OVER (PARTITION BY free ORDER BY x - base DESC, i) AS place, s - (SELECT sum(base) FROM floored) AS short FROM floored),
quota AS (
  SELECT dataset_name, label_family, target_share, min_rows, need, available,
         base + CASE WHEN free AND place <= short THEN 1 ELSE 0 END AS quota, greatest(0, need - available) AS shortfall FROM ranked_cells)
"""

SQL = {
    "p3_found": f"WITH {_P3} SELECT least(s, h) AS record_a, greatest(s, h) AS record_b FROM found",
    "p3_report": f"""WITH {_P3},
best AS (SELECT h, count(*) AS partners, max(n) / 16.0 AS coverage FROM found GROUP BY h)
SELECT d.split, c.dataset_name AS source, count(*) AS records, count(coverage) AS overlapping, CAST(coalesce(sum(partners), 0) AS BIGINT) AS pairs, round(avg(coverage), 6) AS mean_coverage
FROM combined_dataset d LEFT JOIN dataset_catalog c USING (dataset_id) LEFT JOIN best ON best.h = d.record_id
WHERE d.split IN ('valid', 'test') GROUP BY 1, 2""",
    "p3_coverage": f"""WITH {_P3}
SELECT d.record_id, d.split, c.dataset_name AS source, tc.dataset_name AS train_source, count(*) AS partners, round(max(n) / 16.0, 6) AS coverage
FROM found f JOIN combined_dataset d ON d.record_id = f.h LEFT JOIN dataset_catalog c USING (dataset_id)
JOIN combined_dataset t ON t.record_id = f.s LEFT JOIN dataset_catalog tc ON tc.dataset_id = t.dataset_id
GROUP BY 1, 2, 3, 4""",
    "p7_limits": r"""
SELECT regexp_replace(lower(trim(d.source)), '[\s_\-]+', '_', 'g') AS source, count(*) AS documents, true AS even, true AS within_cap
FROM documents d JOIN (SELECT DISTINCT regexp_replace(lower(trim(source)), '[\s_\-]+', '_', 'g') AS source FROM mix_targets) m
  ON m.source = regexp_replace(lower(trim(d.source)), '[\s_\-]+', '_', 'g') GROUP BY 1""",
    "p5_report": f"WITH {_P5}, {_QUOTAS} SELECT * FROM quota",
    "p5_sample": f"""WITH {_P5}, {_QUOTAS},
taken AS (
  SELECT d.*, q.quota, row_number() OVER (PARTITION BY c.dataset_name, d.label_family ORDER BY md5('42:' || d.record_id), d.record_id) AS place
  FROM combined_dataset d JOIN dataset_catalog c USING (dataset_id) JOIN quota q ON q.dataset_name = c.dataset_name AND q.label_family = d.label_family)
SELECT * EXCLUDE (quota, place) FROM taken WHERE place <= quota""",
    "p5_found": f"WITH {_P5} SELECT dataset_name, label_family FROM needs WHERE need > available",
}
