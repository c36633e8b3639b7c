"""Operators over evidence tables: plain functions from DataFrames to DataFrames."""
