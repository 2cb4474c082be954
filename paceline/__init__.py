"""Cohort analytics for timed results, written as Spark DataFrame jobs."""

__version__ = "0.1.0"
