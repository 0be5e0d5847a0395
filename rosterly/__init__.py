"""Co-membership analytics on Spark: DataFrame in, DataFrame out."""
