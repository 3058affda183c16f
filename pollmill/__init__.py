"""Survey-response analytics as Spark DataFrame operators."""
