"""Analytics operators for Spark DataFrames: staging, joins, aggregates,
windows, unions, incremental loads, marts, table gates and record work."""
