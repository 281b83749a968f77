"""Queries: the catalogue over the web-analytics table, and one or more for each operator over the driver's tables."""
