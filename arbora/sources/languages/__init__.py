"""Extraction of symbols and references from source files, a file a row."""
