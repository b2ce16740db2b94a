"""Operators on whole DataFrames."""

from eventlens.operators.sessionize import session_count, sessionize
from eventlens.operators.streamed import large_chain_count, large_funnel, large_next_node

__all__ = ["large_chain_count", "large_funnel", "large_next_node", "session_count", "sessionize"]
