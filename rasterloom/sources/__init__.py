"""Readers and writers of frames, tables, catalogues and flows."""
