"""Column functions, and their registration for SQL."""

from __future__ import annotations

from pyspark.sql import SparkSession


def register(spark: SparkSession) -> None:
    """Temporary SQL functions: token_estimate(text), prompt_jaccard(a, b) of word arrays, token_cost(tokens_in, tokens_out, usd_in, usd_out)."""
    for sql in (
        "token_estimate(t STRING) RETURNS BIGINT RETURN cast(ceil(length(t) / 4) AS BIGINT)",
        """prompt_jaccard(a ARRAY<STRING>, b ARRAY<STRING>) RETURNS DOUBLE
           RETURN CASE WHEN size(a) = 0 OR size(b) = 0 THEN 0D ELSE size(array_intersect(a, b)) / cast(size(array_union(a, b)) AS DOUBLE) END""",
        "token_cost(n BIGINT, m BIGINT, usd_in DOUBLE, usd_out DOUBLE) RETURNS DOUBLE RETURN n / 1e6 * usd_in + m / 1e6 * usd_out",
    ):
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {sql}")
