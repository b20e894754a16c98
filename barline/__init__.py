"""Market and news analytics as Spark DataFrame operators."""
