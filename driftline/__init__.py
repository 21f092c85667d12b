"""driftline: stream novelty detection and corpus preparation on Spark DataFrames."""
