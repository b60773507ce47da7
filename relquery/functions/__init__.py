"""Names and expressions: validation and translation to Spark."""
