"""Readers and converters."""
