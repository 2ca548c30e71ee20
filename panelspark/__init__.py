"""PySpark building blocks for live forecasting benchmarks over event data."""

from panelspark.session import configure, get_session

__all__ = ["configure", "get_session"]
