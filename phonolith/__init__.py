"""Environmental-noise analytics as Spark DataFrame operators."""
