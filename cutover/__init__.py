"""Reconciliation, profiling and reporting for database migrations, on Spark.

Every operator takes DataFrames and parameters and returns a DataFrame.
"""
