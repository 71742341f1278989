"""Table scans, the source registry, sinks and the score store."""
