"""Election-archive analytics expressed as Spark DataFrame operators."""
