"""Readers and writers: documents, stage tables, score sheets."""
