"""Statement extraction, quorum voting and reconciliation over Spark DataFrames."""
