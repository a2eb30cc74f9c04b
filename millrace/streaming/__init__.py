"""Structured Streaming jobs over growing run logs."""
