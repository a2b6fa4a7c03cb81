"""tessera: reference extraction, package-metadata and corpus analytics as Spark DataFrame plans."""
