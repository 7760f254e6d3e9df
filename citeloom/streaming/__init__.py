"""Structured Streaming forms of the keyed append flows."""
