"""Derived tables, the ten investigations and the summaries of their results."""
