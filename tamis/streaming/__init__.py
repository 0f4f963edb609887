"""Arrival-driven intake on Structured Streaming."""
