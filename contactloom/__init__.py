"""Business-contact analytics expressed as Spark plans."""
