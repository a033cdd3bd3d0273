"""Composite pipelines (Q1-Q7) and the query catalog used by the driver contract."""
