"""vspark: family-based genetic variant analytics as plain Spark DataFrame plans."""
