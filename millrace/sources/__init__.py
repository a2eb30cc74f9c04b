"""Readers and writers: tolerant CSV, JSON lines, traces, file listings, stages."""
