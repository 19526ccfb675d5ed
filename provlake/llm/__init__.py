"""Training-data operators: scans, near-duplicate search, scoring and packing of a document corpus."""
