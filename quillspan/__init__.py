"""Document knowledge analytics as DataFrame -> DataFrame functions for Spark."""
