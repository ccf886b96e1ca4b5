"""inkprint: writing-style features and author attribution as Spark jobs."""

__version__ = "0.1.0"
