"""orderlens: retail order-line analytics as Spark DataFrame functions."""

from orderlens.session import build_session

__all__ = ["build_session"]
