"""Incremental ingest and ledger statistics with Structured Streaming."""
