"""Tallyforge: ledger analytics and corpus processing on PySpark."""
