"""brindle: a Spark-first analytics workbench (SQL surface, catalog, profiling, encoding, rules)."""

__version__ = "0.1.0"
