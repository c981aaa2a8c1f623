"""Readers and writers: trace files, artifact listings, stage tables."""
