"""Readers and writers for files, stores, golden sets and transcripts."""
