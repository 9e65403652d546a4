"""Streams: result caches and counters."""
