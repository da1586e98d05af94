"""Transport on a reduced sphere grid, and its data work, as Spark jobs."""
