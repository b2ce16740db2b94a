"""Aggregate functions over events, usable in any ``agg`` beside built-in ones."""

from eventlens.functions.funnel import window_funnel
from eventlens.functions.next_node import sequence_next_node
from eventlens.functions.retention import retention
from eventlens.functions.sequence import sequence_count, sequence_match, sequence_match_events

__all__ = ["retention", "sequence_count", "sequence_match", "sequence_match_events", "sequence_next_node", "window_funnel"]
