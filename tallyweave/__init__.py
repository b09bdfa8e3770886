"""Ledger analytics on Spark: narration enrichment, rollups, period and spend questions as DataFrames."""
