"""sievemark: DataFrame-in, DataFrame-out operators for checking, routing and scoring text on Spark."""
