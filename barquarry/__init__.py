"""Screening and trade extraction over market-bar tables, on Spark DataFrames."""
