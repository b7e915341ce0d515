"""Structured Streaming: count windows, stateful processors, live tracks with silence, change feeds."""
