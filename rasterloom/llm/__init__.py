"""Operators for large-scale text and media corpora; nothing else in the library imports this subpackage."""
