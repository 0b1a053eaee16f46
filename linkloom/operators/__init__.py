"""Joins, windows, aggregates, learning and decision operators for record linkage."""
