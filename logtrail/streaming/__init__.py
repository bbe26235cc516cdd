"""Structured Streaming: continuous ingest and continuous burst alerts."""
