"""Operators over catalog tables: hierarchies, statistics, writes, ingestion and layout."""
