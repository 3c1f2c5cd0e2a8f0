"""Trace and experiment-log analytics as plain Spark DataFrame operators."""
