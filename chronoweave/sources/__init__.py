"""Scans and sinks: benchmark files, tuples, score caches, reports. All declare their schemas."""
