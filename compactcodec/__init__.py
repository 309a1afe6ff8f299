"""Compact text and binary notations of structured data as DataFrames."""
