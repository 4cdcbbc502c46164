"""Registered queries over views of the driver's tables, and their SQL."""
