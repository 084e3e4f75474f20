"""Readers and writers of text, delimited and binary files."""
