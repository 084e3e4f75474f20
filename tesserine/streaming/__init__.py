"""Structured Streaming helpers: an extension beyond the table operators."""
