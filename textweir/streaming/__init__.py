"""Structured Streaming forms of progress, counters, snapshots and incremental cache writes."""
