"""The functions under SQL names, as temporary SQL functions of a session: Catalyst inlines their bodies."""

from __future__ import annotations

from pyspark.sql import SparkSession

_SUM = "aggregate({0}, CAST(0 AS {1}), (s, x) -> s + x)"

#: Name, parameters, result type and body.
FUNCTIONS = [
    ("sp_hamming", "a BIGINT, b BIGINT", "BIGINT", "CAST(bit_count(a ^ b) AS BIGINT)"),
    ("sp_hamming_words", "a ARRAY<BIGINT>, b ARRAY<BIGINT>", "BIGINT", _SUM.format("zip_with(a, b, (x, y) -> CAST(bit_count(x ^ y) AS BIGINT))", "BIGINT")),
    ("sp_dot", "a ARRAY<DOUBLE>, b ARRAY<DOUBLE>", "DOUBLE", _SUM.format("zip_with(a, b, (x, y) -> x * y)", "DOUBLE")),
    ("sp_l1", "a ARRAY<DOUBLE>, b ARRAY<DOUBLE>", "DOUBLE", _SUM.format("zip_with(a, b, (x, y) -> abs(x - y))", "DOUBLE")),
    ("sp_norm", "a ARRAY<DOUBLE>", "DOUBLE", "sqrt(" + _SUM.format("transform(a, x -> x * x)", "DOUBLE") + ")"),
    ("sp_sigmoid", "x DOUBLE", "DOUBLE", "1 / (1 + exp(-x))"),
    ("sp_band", "d BIGINT, t BIGINT", "STRING", "CASE WHEN d <= t div 4 THEN 'Foveal' WHEN d <= t * 2 div 4 THEN 'Near' WHEN d <= t * 3 div 4 THEN 'Good' WHEN d <= t THEN 'Weak' ELSE 'Reject' END"),
    ("sp_expectation", "f DOUBLE, c DOUBLE", "DOUBLE", "c * (f - 0.5) + 0.5"),
    ("sp_revise", "a BIGINT, b BIGINT", "BIGINT", "(a + b) div 2"),
    ("sp_field", "state BIGINT, at INT, width INT", "BIGINT", "shiftrightunsigned(state, at) & (shiftleft(1L, width) - 1)"),
    ("sp_passes", "f DOUBLE, c DOUBLE, least DOUBLE", "BOOLEAN", "c * (f - 0.5) + 0.5 >= least"),
]


def register(spark: SparkSession) -> list[str]:
    """Makes all functions known to ``spark.sql``; returns their names."""
    for name, parameters, kind, body in FUNCTIONS:
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({parameters}) RETURNS {kind} RETURN {body}")
    return [f[0] for f in FUNCTIONS]
