"""Structured Streaming: incremental ingestion and repeat suppression."""
