"""provlake operators."""
