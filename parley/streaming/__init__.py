"""Stateless steps over Structured Streaming."""
