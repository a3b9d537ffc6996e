"""Transcript analytics over coding-assistant session logs, written as Spark jobs."""

__version__ = "0.1.0"
