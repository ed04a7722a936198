"""hexnet: routing analytics on hexagonal-grid networks, with Spark DataFrames in and out."""

__version__ = "0.1.0"
