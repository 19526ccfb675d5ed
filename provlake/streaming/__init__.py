"""provlake streaming."""
