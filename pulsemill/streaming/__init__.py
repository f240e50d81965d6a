"""Structured Streaming over the same models."""
