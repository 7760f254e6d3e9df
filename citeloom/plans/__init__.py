"""Operators composed into end-to-end jobs."""
