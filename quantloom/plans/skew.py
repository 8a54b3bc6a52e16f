"""Queries of the skew-proof per-key results."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quantloom.operators.skew import arrival_delays, first_level_codes, heavy_keys, keyed_quantiles

SHARES = {"ids": 0.015, "codes": 0.04}


def _both(spark: SparkSession, sf_dir: str, **options) -> tuple[DataFrame, DataFrame]:
    delays = arrival_delays(spark.read.parquet(f"{sf_dir}/interactions.parquet"))
    codes = first_level_codes(spark.read.parquet(f"{sf_dir}/codes.parquet"))
    rows = [delays.select(F.lit("ids").alias("field"), "key_value", "value", F.col("interaction_id").alias("unit")), codes.select(F.lit("codes").alias("field"), "key_value", "value", F.col("item_id").alias("unit"))]
    both = rows[0].unionByName(rows[1])
    total = both.select("field", "unit").distinct().groupBy("field").agg(F.count("*").alias("n"))
    share = F.when(F.col("field") == "ids", F.lit(SHARES["ids"])).otherwise(F.lit(SHARES["codes"]))
    return keyed_quantiles(both, ["field", "key_value"], "value", (0.5, 0.9), **options), total.withColumn("share", share)


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Heavy items and first-level codes, out of the full per-key results.

    Their counts alone decide which keys these are. A heavy key that has values but not all its quantiles
    stops the query: its result did not come out in full.
    """
    per_key, total = _both(spark, sf_dir)
    full = (F.col("n_values") == 0) | (F.col("q0").between(F.col("min_value"), F.col("q1")) & (F.col("q1") <= F.col("max_value")))
    key = F.when(full, F.col("key_value")).otherwise(F.raise_error(F.lit("a heavy key lacks its quantiles")))
    return heavy_keys(per_key, ["field"], total, "share").select("field", key.alias("key_value"))


def p3_quantiles(spark: SparkSession, sf_dir: str, **options) -> DataFrame:
    """Exact quantiles for every item (arrival delay in microseconds) and first-level code (second-level code)."""
    per_key, _ = _both(spark, sf_dir, **options)
    return per_key.select("field", "key_value", "n_rows", "n_values", "min_value", "max_value", F.col("q0").alias("q50"), F.col("q1").alias("q90"))


def p3_quantiles_salted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same without a broadcast, as it runs when there are too many keys for one: hot keys are salted."""
    return p3_quantiles(spark, sf_dir, broadcast_bytes=0)


_ROWS = """
WITH i AS (SELECT interaction_id AS unit, item_id AS key_value, min(epoch_us(arrived_at) - epoch_us(ts)) AS value
           FROM interactions WHERE interaction_id IS NOT NULL AND item_id >= 0 GROUP BY 1, 2),
     c AS (SELECT item_id AS unit, CAST(codes[1] AS BIGINT) AS key_value, min(CASE WHEN codes[2] >= 0 THEN CAST(codes[2] AS BIGINT) END) AS value
           FROM codes WHERE item_id IS NOT NULL AND codes[1] >= 0 GROUP BY 1, 2),
     r AS (SELECT 'ids' AS field, * FROM i UNION ALL SELECT 'codes', * FROM c)
"""

QUERIES = {"p3_found": p3_found, "p3_quantiles": p3_quantiles, "p3_quantiles_salted": p3_quantiles_salted}
ORACLES = {
    "p3_found": _ROWS
    + """, t AS (SELECT field, count(DISTINCT unit) AS n FROM r GROUP BY field), k AS (SELECT field, key_value, count(*) AS n FROM r GROUP BY 1, 2)
SELECT k.field, k.key_value FROM k JOIN t ON k.field = t.field WHERE k.n >= (CASE WHEN k.field = 'ids' THEN 0.015 ELSE 0.04 END) * t.n""",
    "p3_quantiles": _ROWS
    + """, o AS (SELECT *, row_number() OVER (PARTITION BY field, key_value ORDER BY value NULLS LAST) AS rk, count(value) OVER (PARTITION BY field, key_value) AS nv FROM r)
SELECT field, key_value, count(*) AS n_rows, max(nv) AS n_values, min(value) AS min_value, max(value) AS max_value,
       max(CASE WHEN rk = greatest(1, ceil(0.5 * nv - 1e-9)) THEN value END) AS q50, max(CASE WHEN rk = greatest(1, ceil(0.9 * nv - 1e-9)) THEN value END) AS q90
FROM o GROUP BY 1, 2""",
}
ORACLES["p3_quantiles_salted"] = ORACLES["p3_quantiles"]
