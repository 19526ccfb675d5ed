"""provlake: Spark jobs over media-manipulation journals and training corpora."""
