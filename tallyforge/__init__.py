"""Ledger analytics and corpus operators expressed as Spark DataFrame plans."""
