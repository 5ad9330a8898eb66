"""Tessella: a query and data-processing engine on PySpark DataFrames."""
