"""Streaming ingestion of alert files (Structured Streaming)."""
