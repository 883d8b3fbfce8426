"""Document-provenance analytics on Spark: DataFrame in, DataFrame out."""
