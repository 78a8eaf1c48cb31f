"""Typed loading and result sinks."""
