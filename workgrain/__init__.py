"""Job-market analytics on Spark: DataFrame transforms and registered queries."""
