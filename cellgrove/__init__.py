"""cellgrove: terrain-mobility analytics and corpus preparation as Spark jobs."""
