"""Structured Streaming forms of the ingest and storm-detection steps."""
