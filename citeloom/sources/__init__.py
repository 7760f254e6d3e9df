"""Readers, derived tables, stores and writers."""
