"""Checks written answers against a knowledge base, in batches and streams, on Spark."""

__version__ = "0.1.0"
