"""Readers, page parsers and text sinks."""
