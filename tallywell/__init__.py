"""Bulk message-to-ledger processing and ledger analytics on Spark DataFrames."""
