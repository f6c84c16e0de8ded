"""Purchase, receipt and possession analytics expressed as Spark DataFrame transformations."""
