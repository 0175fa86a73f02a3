"""Operators over DataFrames: validation, views, scoring, redaction, notes, rendering."""
