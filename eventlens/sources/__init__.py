"""Where events come from and results go."""

from eventlens.sources.tables import read_events, write_bucketed, write_result

__all__ = ["read_events", "write_bucketed", "write_result"]
