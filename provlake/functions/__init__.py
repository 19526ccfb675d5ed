"""provlake functions."""
