"""millrace: composable row sources, operators, lookups, aggregations and sinks on Spark DataFrames."""
