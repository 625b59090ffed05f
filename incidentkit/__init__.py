"""Service-desk and back-office analytics as plain Spark DataFrame operators."""
