"""Incremental ingest of new corpus files."""
