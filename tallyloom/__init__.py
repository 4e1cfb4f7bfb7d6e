"""tallyloom: ledger analytics and corpus preparation on Spark DataFrames."""
