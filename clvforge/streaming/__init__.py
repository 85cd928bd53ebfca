"""Structured Streaming scoring of arriving requests."""
