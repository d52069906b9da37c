"""tidemark: a streaming ledger engine on Spark DataFrames."""
