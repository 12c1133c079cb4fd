"""Readers and writers of the formats that archives and indexing runs come in."""
