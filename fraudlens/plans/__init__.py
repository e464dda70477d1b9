"""End-to-end plans and the query registry used by __spark_entry__."""
