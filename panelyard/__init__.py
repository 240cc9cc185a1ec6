"""Factor research over large entity-by-date panels, written as Spark DataFrame operations."""
