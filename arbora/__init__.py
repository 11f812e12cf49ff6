"""arbora: source-repository graphs on Spark."""

__version__ = "0.1.0"
