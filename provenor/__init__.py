"""provenor: evidence scoring and entity resolution as Spark DataFrame plans."""
