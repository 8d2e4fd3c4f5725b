"""Grading and searching step-by-step answers as Spark DataFrame jobs."""

from veritrail.session import build_session

__all__ = ["build_session"]
