"""provlake sources."""
