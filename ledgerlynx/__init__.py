"""Spark-native screening of public companies: filings, prices, insiders, risk."""

__version__ = "0.1.0"
