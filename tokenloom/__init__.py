"""Token-corpus preparation and training-run analytics as Spark DataFrame operators."""
