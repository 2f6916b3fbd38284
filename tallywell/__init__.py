"""Measure registries on Spark: records and slow sources in, one long table of measures out."""

__version__ = "0.1.0"
