"""sentrymill: security-operations and messaging analytics as Spark DataFrame operators."""
