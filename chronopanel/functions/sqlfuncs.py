"""SQL functions and a table function for the session (plain SQL bodies, inlined by Catalyst)."""

from __future__ import annotations

from pyspark.sql import SparkSession

FUNCTIONS = {
    "cp_plateau_start(x INT) RETURNS INT": "((x - 1) div 3) * 3 + 1",
    "cp_annualized(a DOUBLE, b DOUBLE, days DOUBLE) RETURNS DOUBLE":
        "CASE WHEN a > 0 AND b > 0 THEN power(b / a, 1 / greatest(days / 365.25D, 1 / 365.25D)) - 1 ELSE -1D END",
    "cp_wilson_low(k BIGINT, n BIGINT) RETURNS DOUBLE":
        "CASE WHEN n <= 0 THEN 0D ELSE greatest(0D, (k / n + 3.8414588206941254D / (2 * n)) / (1 + 3.8414588206941254D / n) - 1.959963984540054D * "
        "sqrt((k / n * (1 - k / n) + 3.8414588206941254D / (4 * n)) / n) / (1 + 3.8414588206941254D / n)) END",
    "cp_shrink(local DOUBLE, whole DOUBLE, n DOUBLE, k DOUBLE) RETURNS DOUBLE":
        "CASE WHEN local IS NULL THEN whole ELSE n / (n + k) * local + (1 - n / (n + k)) * whole END",
    "cp_zero_probability(a DOUBLE, b DOUBLE, exposure DOUBLE) RETURNS DOUBLE": "power(b / (b + greatest(0D, exposure)), a)",
}

FOLDS = """
CREATE OR REPLACE TEMPORARY FUNCTION cp_folds(n BIGINT, train INT, valid INT, step INT, purge INT)
RETURNS TABLE(fold BIGINT, train_end BIGINT, valid_start BIGINT, valid_end BIGINT)
RETURN SELECT k, train + k * step - 1, train + purge + k * step, train + purge + k * step + valid - 1
FROM explode(if(n >= train + purge + valid, sequence(0L, (n - train - purge - valid) div step), cast(array() AS array<bigint>))) AS t(k)
"""


def register(spark: SparkSession) -> None:
    for signature, body in FUNCTIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {signature} RETURN {body}")
    spark.sql(FOLDS)
