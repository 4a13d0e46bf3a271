"""Incremental ingestion of newly landed measurement files."""
