"""rollgrid: dimensional, event-time analytics expressed as Spark DataFrames."""

from rollgrid.session import get_session, read_table

__all__ = ["get_session", "read_table"]
