"""Structured Streaming forms of the journal and index upkeep."""
