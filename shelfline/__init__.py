"""Product-offer catalog and price comparison as Spark jobs."""

__version__ = "0.1.0"
