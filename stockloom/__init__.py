"""Retail analytics operators on Spark DataFrames."""

from stockloom.session import build_session, scratch_dir

__all__ = ["build_session", "scratch_dir"]
