"""Structured Streaming form of the live loop."""
