"""waymark: analytics over large directories of places, written as Spark jobs."""
