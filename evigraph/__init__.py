"""Evidence graphs from tables of identifiers and record snapshots, as Spark DataFrames."""
