"""lodestone: corpus-to-evaluation analytics expressed as Spark DataFrame plans."""
