"""Pipelines, fixture views and the query catalogue."""
