"""paperflow: curated digests from document feeds, expressed as Spark DataFrame plans."""
