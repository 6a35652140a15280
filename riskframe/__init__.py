"""Credit-risk and data-quality analytics as Spark DataFrame operators."""
