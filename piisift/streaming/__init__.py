"""Structured Streaming forms of the scan, counters and recent-findings sink."""
