"""Structured Streaming into frames."""
