"""Behavioural analytics on event tables, as Spark expressions and DataFrame operators."""

from eventlens.functions import retention, sequence_count, sequence_match, sequence_match_events, sequence_next_node, window_funnel
from eventlens.operators import session_count, sessionize

__all__ = [
    "retention", "sequence_count", "sequence_match", "sequence_match_events", "sequence_next_node",
    "session_count", "sessionize", "window_funnel",
]
