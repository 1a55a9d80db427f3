"""Harborline: an audited file-ingestion engine and corpus toolkit built on Spark DataFrames."""

__version__ = "0.1.0"
