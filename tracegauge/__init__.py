"""Declarative-constraint analytics over event logs, expressed with Spark DataFrames."""
