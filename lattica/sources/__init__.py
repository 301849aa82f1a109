"""Stores, Parquet data sets and geometry columns."""
