"""Document analytics on PySpark: sources, functions, operators, rule sets and streams."""

__version__ = "0.1.0"
