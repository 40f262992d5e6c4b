"""brindle: document-knowledge analytics as Spark DataFrame and SQL plans."""
