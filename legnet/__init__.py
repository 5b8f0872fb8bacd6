"""legnet: survey-network analytics as plain Spark DataFrame operators."""
