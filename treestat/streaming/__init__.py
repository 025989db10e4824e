"""Structured Streaming ingest of listing batches."""
