"""Incremental ingestion (an extension)."""
