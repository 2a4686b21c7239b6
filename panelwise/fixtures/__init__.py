"""Survey-shaped inputs that Spark derives from the sample tables."""
