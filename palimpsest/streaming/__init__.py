"""Structured Streaming counterparts of the append-only ledgers."""
