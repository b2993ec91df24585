"""Network-flow telemetry analytics on Spark: DataFrame in, DataFrame out."""
