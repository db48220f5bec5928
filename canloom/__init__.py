"""Measurement-log analytics as DataFrame plans: scan, classify, decode, aggregate, export and compare."""

__version__ = "0.1.0"
