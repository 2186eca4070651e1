"""Whole plans made of operators: ingestion and context assembly."""
