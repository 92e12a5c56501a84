"""Data profiling and business analytics as Spark DataFrame operators."""
