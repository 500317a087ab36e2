"""Batch and streaming analytics for voice-over production, on Spark DataFrames."""

from cuesheet.session import build_session, scratch_dir

__all__ = ["build_session", "scratch_dir"]
