"""Corpus-preparation operators: deduplication, packing, tagging, fingerprints and archive formats."""
