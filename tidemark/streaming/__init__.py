"""Structured Streaming: replayed documents, deduplication, decayed state, sinks."""
