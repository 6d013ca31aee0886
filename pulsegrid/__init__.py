"""Analytics of signals recorded on a spatial grid, as Spark jobs."""
