"""Market analytics on Spark: every analysis is a DataFrame or SQL query over plain tables."""
