"""Structured Streaming: incremental postings."""
