"""Search and analysis of council records on Spark."""
