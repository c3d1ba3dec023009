"""Query catalogue: Spark plans and their SQL oracles."""
