"""Flood-hazard analytics as functions from DataFrames to DataFrames."""
