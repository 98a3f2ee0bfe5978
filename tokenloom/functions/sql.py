"""Make the column functions callable from Spark SQL."""

from __future__ import annotations

from pyspark.sql import SparkSession

from tokenloom.functions.codecs import octet_encoder

# SQL bodies of the formulas; they stay ordinary Catalyst expressions.
SQL_FUNCTIONS = {
    "perplexity(loss DOUBLE) RETURNS DOUBLE": "exp(least(loss, 20.0D))",
    "format_duration(s DOUBLE) RETURNS STRING": (
        "CASE WHEN s < 60 THEN format_string('%.0fs', s) WHEN s < 3600 THEN format_string('%.0fm', s / 60) "
        "WHEN s / 3600 < 24 THEN format_string('%.1fh', s / 3600) "
        "ELSE format_string('%.1fd', s / 3600 / 24) END"),
    "decode_bytes(ids ARRAY<INT>) RETURNS STRING": (
        "make_valid_utf8(CAST(unhex(array_join(transform(ids, i -> lpad(hex(pmod(i, 256)), 2, '0')), '')) "
        "AS STRING))"),
    "decode_codepoints(ids ARRAY<INT>) RETURNS STRING":
        "array_join(transform(ids, i -> char(least(i, 255))), '')",
    "encode_codepoints(t STRING) RETURNS ARRAY<INT>":
        "transform(filter(split(t, ''), c -> c <> ''), c -> least(ascii(c), 255))",
}


def register_sql(spark: SparkSession) -> list[str]:
    """Register the functions for this session and return their names."""
    for signature, body in SQL_FUNCTIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {signature} RETURN {body}")

    spark.udf.register("encode_bytes", octet_encoder())
    return [s.split("(")[0] for s in SQL_FUNCTIONS] + ["encode_bytes"]
