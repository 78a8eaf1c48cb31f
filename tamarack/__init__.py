"""Batch fraud analytics on Spark DataFrames."""

from tamarack.session import build_session

__all__ = ["build_session"]
