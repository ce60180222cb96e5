"""Spark-native lineage graphs and large-table data processing."""

__version__ = "0.1.0"
