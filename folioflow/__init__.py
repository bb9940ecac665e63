"""folioflow: the data work behind document-to-media production, as Spark DataFrame operators."""
