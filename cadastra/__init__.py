"""A PySpark engine for regulatory evidence, usage ledgers and training-data preparation."""
