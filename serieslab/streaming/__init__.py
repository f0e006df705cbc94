"""Structured Streaming forms of polling, idempotent ingest, windows and idle flush."""
