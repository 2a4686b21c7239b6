"""Transport-file source, landing guard, and the load into tables."""
