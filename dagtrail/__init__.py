"""Task-history analytics as plain Spark DataFrame functions."""
