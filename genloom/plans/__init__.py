"""The query catalogue: one module per family, each with QUERIES and ORACLES."""
