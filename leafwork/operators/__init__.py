"""Chapter detection, splitting and reporting as DataFrame transforms keyed by doc_id."""
