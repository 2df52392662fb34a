"""Tidewheel: a DataFrame-first engine for time-stamped content and event streams."""

__version__ = "0.1.0"
