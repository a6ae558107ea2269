"""Readers: fixtures, file-tree data source, decoding."""
