"""Streams: incremental work, and answers as events."""
