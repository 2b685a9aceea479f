"""Readers, the index store, embedding providers, ingestion and tools."""
