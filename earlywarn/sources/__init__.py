"""Scans, fixtures derived from the driver tables, and sinks."""
