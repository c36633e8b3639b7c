"""Structured Streaming forms of ingestion, journalling and delivery."""
