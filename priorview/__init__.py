"""priorview: as-of evidence, cost-share ledgers and weighted scorecards on Spark DataFrames."""
