"""Readers with an explicit order column, and sinks."""
