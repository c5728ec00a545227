"""Jobs chained end to end, and the registered query catalogue."""
