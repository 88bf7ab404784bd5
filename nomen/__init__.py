"""nomen: program-graph name recovery and corpus jobs as plain Spark DataFrames."""
