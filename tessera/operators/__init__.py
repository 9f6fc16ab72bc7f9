"""Operators from DataFrames to DataFrames: overlays, matching, reconciliation, loads, cash and reports."""
