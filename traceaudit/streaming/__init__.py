"""Structured Streaming forms of span ingestion, the judgment ledger and the verdicts."""
